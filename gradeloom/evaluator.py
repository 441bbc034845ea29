"""The evaluation run: samples and metrics to the long results table, by batch or at once, resumable."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.operators import judges, results, tutoring, usage
from gradeloom.functions import scoring as K
from gradeloom.registry import REGISTRY, Registry

SCHEMA = "sample_index long, metric_name string, score double, reason string"


#: What a metric needs of the judge beside its own request.
PARTS = {"no_immediate_disclosure": ("no_immediate_disclosure", "helpfulness"), "pes": ("faithfulness", "state", "no_immediate_disclosure", "helpfulness")}


def evaluate(
    samples: DataFrame,
    metrics: Sequence[str],
    cache: DataFrame | None = None,
    judge: Callable[[str, str], str] | None = None,
    model: str = "",
    system: str = "",
    registry: Registry = REGISTRY,
    extra: Mapping[str, Callable[[], Column]] | None = None,
    cache_path: str | None = None,
    ttl: float | None = None,
    on_answers: Callable[[DataFrame], None] | None = None,
    injected: Mapping[str, object] | None = None,
    **options: float,
) -> DataFrame:
    """Results (sample_index, metric_name, score, reason) of canonical samples.

    Column metrics are scored in one pass over the samples. Judge metrics come from the cache (``cache``: cache_key,
    text, cached_at; or the table at ``cache_path``, entries older than ``ttl`` seconds left out) and the judge; all of
    them together ask each prompt once, and fresh answers are added to the table. ``on_answers`` is given the fresh
    answers; ``injected`` are the encoder, scorer or sentiment that column metrics take; ``options`` go to
    ``judges.ask``. Scores outside 0..1 leave no row, as do metrics without a score.
    """
    spark = samples.sparkSession
    chosen = [registry.get(m) for m in metrics if m not in (extra or {})]
    columns = {m.name: registry.create(m.name, **(injected or {})) for m in chosen if m.column is not None} | {k: f() for k, f in (extra or {}).items()}
    out = spark.createDataFrame([], SCHEMA)
    if columns:
        rows = samples.select("sample_index", *[c.alias(n) for n, c in columns.items()])
        out = out.unionByName(results.unpivot(rows, list(columns)))
    asked = [m.name for m in chosen if m.column is None]
    if asked:
        known = cache if cache is not None else spark.createDataFrame([], "cache_key string, text string, cached_at double")
        if cache_path is not None:
            known = known.unionByName(usage.alive(usage.load(spark, cache_path), time.time(), ttl))
        needed = list(dict.fromkeys(p for m in asked for p in PARTS.get(m, (m,))))
        got, fresh = judges.judgements(judges.requests(samples, needed, model, system), known, judge, **options)
        if fresh is not None and cache_path is not None:
            usage.put(fresh, cache_path, time.time())
        if fresh is not None and on_answers is not None:
            on_answers(fresh)
        plain = [m for m in asked if m in judges.SCORES]
        if plain:
            out = out.unionByName(judges.scored(samples, plain, got))
        if "no_immediate_disclosure" in asked or "pes" in asked:
            told = told_results(samples, got)
            if "no_immediate_disclosure" in asked:
                out = out.unionByName(told)
            if "pes" in asked:
                base = judges.scored(samples, ["faithfulness", "state"], got)
                out = out.unionByName(composite_results(samples, base, told).select("sample_index", "metric_name", "score", "reason"))
    return out.where((F.col("score") >= 0) & (F.col("score") <= 1))


def disclosure_results(samples: DataFrame, cache: DataFrame, judge: Callable[[str, str], str] | None, model: str, system: str = "", **options: float) -> DataFrame:
    """The two judge calls of a sample side by side; a failed call scores 0 with its error."""
    got, _ = judges.judgements(judges.requests(samples, list(PARTS["no_immediate_disclosure"]), model, system), cache, judge, **options)
    return told_results(samples, got)


def told_results(samples: DataFrame, got: DataFrame) -> DataFrame:
    """``disclosure_results`` from judgements that are at hand."""
    pair = list(PARTS["no_immediate_disclosure"])
    wide = got.where(F.col("metric").isin(pair)).groupBy("sample_index").pivot("metric", pair).agg(F.first("text"))
    d = judges.disclosure(F.col(pair[0]), F.col(pair[1]))
    scored = wide.select("sample_index", F.lit(pair[0]).alias("metric_name"), d["score"].alias("score"), d["reason"].alias("reason"))
    empty = samples.where("answer = ''").select("sample_index", F.lit(pair[0]).alias("metric_name"), F.lit(0.0).alias("score"), F.lit(judges.NO_ANSWER).alias("reason"))
    return scored.unionByName(empty)


def composite_results(samples: DataFrame, base: DataFrame, disclosure: DataFrame, threshold: float | None = 0.5) -> DataFrame:
    """The composite score per sample, with gate_failed and score_before_gate; ``threshold=None`` leaves out the gate."""
    wide = base.groupBy("sample_index").pivot("metric_name", ["faithfulness", "state"]).agg(F.first(F.struct("score", "reason")))
    letter = F.regexp_extract("state.reason", r"^\[State ([ABC])\]", 1)
    m1 = tutoring.uptake(F.col("question"), F.col("answer"), F.col("contexts"))["score"]
    m2 = tutoring.linguistic_adaptation(F.col("answer"))["score"]
    x = samples.select("sample_index", "answer", m1.alias("m1"), m2.alias("m2")).join(wide, "sample_index", "left").join(disclosure.select("sample_index", F.col("score").alias("m3")), "sample_index", "left")
    x = x.select("sample_index", "answer", "m1", "m2", F.coalesce("m3", F.lit(0.0)).alias("m3"), F.coalesce(letter, F.lit("")).alias("state"), F.col("faithfulness.score").alias("faithfulness"))
    f = F.col("faithfulness") if threshold is not None else None
    c = K.composite(F.col("m1"), F.col("m2"), F.col("m3"), F.col("state"), f, threshold or 0.0)
    reason = tutoring.composite_reason(F.col("m1"), F.col("m2"), F.col("m3"), F.col("state"), F.lit(""), f, c["gate_failed"])
    none = F.col("answer") == ""
    return x.select(
        "sample_index", F.lit("pes").alias("metric_name"), F.when(none, 0.0).otherwise(c["score"]).alias("score"), F.when(none, judges.NO_ANSWER).otherwise(reason).alias("reason"), "m1", "m2", "m3", "state", "faithfulness", c["gate_failed"].alias("gate_failed"), c["score_before_gate"].alias("score_before_gate")
    )


def evaluate_batches(samples: DataFrame, metrics: Sequence[str], path: str, batch_size: int = 50, on_batch: Callable[[DataFrame, int], None] | None = None, **options) -> DataFrame:  # type: ignore[no-untyped-def]
    """Results written to ``path`` as Parquet, one folder per batch of ``batch_size`` sample indices; finished batches
    are kept, so a run that broke off continues where it stopped. All batches are computed in one job; the callback gets
    each new batch's rows and may fail without ending the run.
    """
    spark = samples.sparkSession
    b = results.batch_number(batch_size)
    try:
        done = spark.read.schema(SCHEMA + ", batch long").parquet(path).select("batch").distinct()
        todo = samples.withColumn("batch", b).join(done, "batch", "left_anti").drop("batch")
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        todo = samples
    got = evaluate(todo, metrics, **options).withColumn("batch", b)
    new = [r[0] for r in todo.select(b.alias("batch")).distinct().collect()] if on_batch else []
    got.write.mode("append").partitionBy("batch").parquet(path)
    out = spark.read.schema(SCHEMA + ", batch long").parquet(path)
    for n in sorted(new):
        try:
            on_batch(out.where(F.col("batch") == n), int(n))  # type: ignore[misc]
        except Exception:  # a callback must not end the run
            import logging

            logging.getLogger(__name__).warning("the batch callback failed", exc_info=True)
    return out
