"""Samples from the event log of chained runs: the question and answer of each root run and the documents below it."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators.skew import join_spread
from gradeloom.session import cut

log = logging.getLogger(__name__)


def roots(runs: DataFrame) -> DataFrame:
    """(run_id, root_id) of every run of (run_id, parent_run_id) whose chain of parents ends in a root.

    Pointer doubling: each round joins every open run to its ancestor's ancestor, so the rounds grow with the logarithm
    of the depth. Finished runs leave the rounds and are only looked up. Runs with an unknown parent have no root and
    are left out. The rounds end when one finishes no run: what is then left leads into a cycle and is left out too.
    """
    x = runs.select("run_id", "parent_run_id").where("run_id is not null").distinct()
    up = cut(x.select("run_id", F.coalesce("parent_run_id", "run_id").alias("to"), F.col("parent_run_id").isNull().alias("done")))
    done = up.where("done").select("run_id", F.col("to").alias("root_id"))
    left = up.where("not done").select("run_id", "to")
    number = left.count()
    while number:
        to = left.select(F.col("run_id").alias("to"), F.col("to").alias("next"), F.lit(False).alias("ends"))
        known = to.unionByName(done.select(F.col("run_id").alias("to"), F.col("root_id").alias("next"), F.lit(True).alias("ends")))
        fan = left.groupBy("to").agg(F.count("*").alias("n"))
        got = cut(join_spread(left, known, ["to"], fan, F.col("run_id"), "inner"))
        done = done.unionByName(got.where("ends").select("run_id", F.col("next").alias("root_id")))
        left = got.where("not ends").select("run_id", F.col("next").alias("to"))
        before, number = number, left.count()
        if number == before:
            log.warning("%d runs lead into a cycle of parents", number)
            break
    return done


def first_key(payload: Column, *keys: str) -> Column:
    """The first of the named keys of a JSON object, else the object as text; plain text as it is."""
    v = F.try_parse_json(payload)
    found = F.coalesce(*[F.try_variant_get(v, f"$.{k}", "string") for k in keys])
    return F.coalesce(found, payload, F.lit(""))


def captured_samples(events: DataFrame) -> DataFrame:
    """(root_id, question, answer, contexts, metadata) of the events (run_id, parent_run_id, kind, seq, payload, metadata).

    kind ``chain_start`` and ``chain_end`` carry JSON inputs and outputs; ``documents`` an array of strings as JSON, in
    the order of seq. Repeated documents count once, at their first place. A root without an end has an empty answer.
    """
    mapped = events.join(roots(events), "run_id")
    root = F.col("run_id") == F.col("root_id")
    start, end, docs = F.col("kind") == "chain_start", F.col("kind") == "chain_end", F.col("kind") == "documents"
    got = mapped.groupBy("root_id").agg(
        F.max_by(F.when(root & start, first_key(F.col("payload"), "question", "query", "input")), F.when(root & start, F.col("seq"))).alias("question"),
        F.max_by(F.when(root & end, first_key(F.col("payload"), "answer", "result", "output")), F.when(root & end, F.col("seq"))).alias("answer"),
        F.max(F.when(root & start, F.col("metadata"))).alias("metadata"),
        F.array_sort(F.collect_list(F.when(docs, F.struct("seq", F.from_json("payload", "array<string>").alias("d"))))).alias("docs"),
    )
    contexts = F.array_distinct(F.flatten(F.transform("docs", lambda x: F.coalesce(x["d"], F.array().cast("array<string>")))))
    return got.select("root_id", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("answer", F.lit("")).alias("answer"), contexts.alias("contexts"), "metadata")
