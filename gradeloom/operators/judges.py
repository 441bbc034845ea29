"""Judge metrics in three stages: prompts, judgements by key, and scores from the judgements' text.

The first and third are column expressions; only keys without a cached judgement reach a judge.
"""

from __future__ import annotations

import random
import time
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import scoring as K
from gradeloom.functions import text as X
from gradeloom.functions.jsontext import payload
from gradeloom.session import cut

PROMPTS = {
    "faithfulness": 'List every claim of the answer and say for each whether the context supports it.\n\nContext:\n${contexts}\n\nAnswer:\n${answer}\n\nReply with JSON only: {"claims": [{"claim": "...", "supported": true}], "reason": "..."}',
    "answer_relevance": 'Rate from 0.0 to 1.0 how well the answer addresses the question.\n\nQuestion:\n${question}\n\nAnswer:\n${answer}\n\nReply with JSON only: {"score": 0.0, "reason": "..."}',
    "context_precision": 'Say for every context chunk whether it helps to answer the question.\n\nQuestion:\n${question}\n\nChunks:\n${contexts}\n\nReply with JSON only: {"evaluations": [{"chunk_index": 0, "is_relevant": true}], "reason": "..."}',
    "context_recall": 'List the statements of the reference answer and say for each whether the context covers it.\n\nReference answer:\n${ground_truth}\n\nContext:\n${contexts}\n\nReply with JSON only: {"statements": [{"statement": "...", "is_covered": true}], "reason": "..."}',
    "state": 'Name the state of the tutoring dialogue: A concept teaching, B error remediation, C Socratic assessment.\n\nStudent:\n${question}\n\nTutor:\n${answer}\n\nReply with JSON only: {"state": "A", "state_label": "...", "confidence": 0.0, "reason": "..."}',
    "no_immediate_disclosure": 'Rate from 0.0 (solution given away) to 1.0 (nothing given away) how the tutor withholds the solution.\n\nExercise:\n${contexts}\n\nStudent:\n${question}\n\nTutor:\n${answer}\n\nReply with JSON only: {"reasoning": "...", "revealed_immediately": false, "score": 0.0}',
    "helpfulness": 'Rate from 1 to 5 how helpful the tutor is.\n\nExercise:\n${contexts}\n\nStudent:\n${question}\n\nTutor:\n${answer}\n\nReply with JSON only: {"reasoning": "...", "score": 1}',
}
NO_ANSWER, NO_CONTEXTS, NO_TRUTH = "No answer provided.", "No contexts provided.", "No ground truth provided."


def prompt(metric: str) -> Column:
    """The rendered prompt of a canonical sample row."""
    block = X.context_block(F.col("contexts"))
    if metric == "faithfulness":
        block = F.when(block == "", NO_CONTEXTS).otherwise(block)
    if metric in ("no_immediate_disclosure", "helpfulness"):
        block = F.array_join("contexts", "\n")
    return X.render(PROMPTS[metric], question=F.col("question"), answer=F.col("answer"), ground_truth=F.col("ground_truth"), contexts=block)


def guard(metric: str) -> Column:
    """The fixed reason where a sample needs no judge, else null. The order of the checks decides the reason."""
    if metric == "context_recall":
        return F.when(F.col("ground_truth") == "", NO_TRUTH).when(F.size("contexts") == 0, NO_CONTEXTS)
    if metric == "context_precision":
        return F.when(F.size("contexts") == 0, NO_CONTEXTS)
    return F.when(F.col("answer") == "", NO_ANSWER)


def _row(score: Column, reason: Column, error: Column, **more: Column) -> Column:
    s = F.when(error.isNotNull(), 0.0).otherwise(score).cast("double")
    r = F.when(error.isNotNull(), F.concat(F.lit("Failed to evaluate: "), error)).otherwise(reason)
    return F.struct(s.alias("score"), r.alias("reason"), error.alias("error"), *[v.alias(k) for k, v in more.items()])


def _text(v: Column, path: str) -> Column:
    return F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))


def _share(v: Column, items: str, flag: str, empty: float, required: bool) -> Column:
    list_ = F.try_variant_get(v, f"$.{items}", "array<variant>")
    hits = F.size(F.filter(list_, lambda c: K.truthy(F.try_variant_get(c, f"$.{flag}", "variant"))))
    score = F.when(F.size(list_) == 0, F.lit(empty)).otherwise(F.try_divide(hits, F.size(list_)))
    missing = F.when(list_.isNull(), F.lit(f"response misses '{items}'")) if required else F.lit(None).cast("string")
    return _row(F.coalesce(score, F.lit(empty)), _text(v, "$.reason"), F.coalesce(F.when(v.isNull(), "judge returned no JSON"), missing))


def faithfulness(response: Column) -> Column:
    """Supported claims over claims; no claims score 1, a response without them is an error."""
    return _share(payload(response), "claims", "supported", 1.0, True)


def context_precision(response: Column) -> Column:
    """Relevant chunks over chunks; no evaluations score 1."""
    return _share(payload(response), "evaluations", "is_relevant", 1.0, True)


def context_recall(response: Column) -> Column:
    """Covered statements over statements; no statements score 0."""
    return _share(payload(response), "statements", "is_covered", 0.0, True)


def answer_relevance(response: Column) -> Column:
    """The judge's score clamped to 0..1; an unreadable number is an error."""
    v = payload(response)
    raw = F.try_variant_get(v, "$.score", "string")
    bad = F.when(v.isNull(), F.lit("judge returned no JSON")).when(raw.isNotNull() & raw.try_cast("double").isNull(), F.lit("score is no number"))
    return _row(K.clamp(K.number(v, "$.score", 0.0)), _text(v, "$.reason"), bad)


def state(response: Column) -> Column:
    """Letter A, B or C, its label, and the clamped confidence as score."""
    v = payload(response)
    letter = K.state_letter(_text(v, "$.state"))
    reason = F.concat(F.lit("[State "), letter, F.lit("] "), _text(v, "$.reason"))
    return _row(K.clamp(K.number(v, "$.confidence", 0.0)), reason, F.when(v.isNull(), F.lit("judge returned no JSON")), state=F.when(v.isNotNull(), letter), state_label=_text(v, "$.state_label"))


def disclosure(response: Column, helpfulness: Column, weights: tuple[float, float] = (0.5, 0.5)) -> Column:
    """Weighted mean of withholding (0..1) and helpfulness (1..5 as 0..1); unreadable numbers count as 0 and 1."""
    a, b = (w / sum(weights) for w in weights)
    v, h = payload(response), payload(helpfulness)
    nid = F.round(K.clamp(K.number(v, "$.score", 0.0)), 4)
    stars = F.greatest(F.lit(1), F.least(F.lit(5), K.whole_number(h, "$.score", 1)))
    norm = F.round((stars - 1) / 4.0, 4)
    told = F.try_variant_get(v, "$.revealed_immediately", "variant")
    revealed = F.when(told.isNull(), nid <= 0.33).otherwise(K.truthy(told))
    reason = F.concat(
        F.lit("NID="), F.when(revealed, "REVEALED").otherwise("NOT revealed"), F.format_string(f" (score=%.2f, w={a:.2f}), Helpfulness=", nid), stars.cast("string"), F.format_string(f"/5 (norm=%.2f, w={b:.2f})", norm)
    )
    error = F.when(v.isNull() | h.isNull(), F.lit("judge returned no JSON"))
    return _row(K.clamp(F.round(a * nid + b * norm, 4)), reason, error, revealed=revealed, raw_helpfulness=stars)


SCORES: dict[str, Callable[[Column], Column]] = {
    "faithfulness": faithfulness, "context_precision": context_precision, "context_recall": context_recall, "answer_relevance": answer_relevance, "state": state,
}


def requests(samples: DataFrame, metrics: list[str], model: str, system: str = "") -> DataFrame:
    """(sample_index, metric, system_prompt, prompt, key) of every sample and judge metric that needs a judge."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), guard("answer_relevance" if m == "helpfulness" else m).alias("guard"), prompt(m).alias("prompt")) for m in metrics]))
    x = samples.select("sample_index", rows.alias("r")).where("r.guard is null")
    return x.select("sample_index", F.col("r.metric").alias("metric"), F.lit(system).alias("system_prompt"), F.col("r.prompt").alias("prompt"), K.cache_key(F.lit(model), F.lit(system), F.col("r.prompt")).alias("key"))


def lookup(asked: DataFrame, cache: DataFrame, now: float | None = None, ttl: float | None = None) -> DataFrame:
    """Requests with the cached ``text`` (null: a miss). cache: (cache_key, text, cached_at)."""
    c = cache if ttl is None else cache.where(F.lit(now) - F.col("cached_at") <= ttl)
    once = c.groupBy("cache_key").agg(F.max_by("text", "cached_at").alias("text"))
    return asked.join(once, asked["key"] == once["cache_key"], "left").drop("cache_key")


ANSWER = "key string, text string, error string, input_tokens long, output_tokens long, latency_ms double"


def ask(misses: DataFrame, judge: Callable[[str, str], str], attempts: int = 5, wait: float = 1.0, at_once: int = 10) -> DataFrame:
    """ANSWER rows of distinct requests, each sent to ``judge(system, prompt)`` with retries and growing waits.

    ``at_once`` bounds the calls in flight: they are shared out over as many tasks as the cluster runs side by side, and
    a task with several sends them from threads. The answers are written to the checkpoint folder at once, so that no
    later action asks again. Token counts are those of the reply, where it has them.
    """
    tasks = max(1, min(at_once, misses.sparkSession.sparkContext.defaultParallelism))
    threads = -(-at_once // tasks)

    def call(system: str, prompt: str) -> tuple:
        for k in range(max(1, attempts)):
            began = time.monotonic()
            try:
                text = judge(system, prompt)
                return str(text), None, getattr(text, "input_tokens", None), getattr(text, "output_tokens", None), (time.monotonic() - began) * 1000
            except Exception as e:  # any failure of the service is retried, then reported
                error = str(e) or repr(e)
                if k + 1 < attempts:
                    time.sleep(min(30.0, wait * 2**k) * random.random())
        return None, error, None, None, None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with ThreadPoolExecutor(threads) as pool:
            for b in batches:
                got = list(pool.map(call, b["system_prompt"], b["prompt"]))
                out = pd.DataFrame(got, columns=["text", "error", "input_tokens", "output_tokens", "latency_ms"])
                out.insert(0, "key", b["key"].to_numpy())
                yield out.astype({"input_tokens": "Int64", "output_tokens": "Int64", "latency_ms": "Float64"})

    once = misses.select("key", "system_prompt", "prompt").dropDuplicates(["key"])
    return cut(once.repartition(tasks, "key").mapInPandas(run, ANSWER))


def judgements(asked: DataFrame, cache: DataFrame, judge: Callable[[str, str], str] | None = None, **options: float) -> tuple[DataFrame, DataFrame | None]:
    """``requests`` with ``text`` and ``error``, and the fresh answers (None without a judge). A prompt that several
    metrics or samples share is sent once."""
    got = lookup(asked, cache).withColumn("error", F.lit(None).cast("string"))
    if judge is None:
        return got, None
    got = cut(got)
    fresh = ask(got.where("text is null"), judge, **options)
    new = fresh.select("key", F.col("text").alias("__text"), F.col("error").alias("__error"))
    return got.join(new, "key", "left").withColumn("text", F.coalesce("text", "__text")).withColumn("error", F.coalesce("__error", "error")).drop("__text", "__error"), fresh


def scored(samples: DataFrame, metrics: list[str], got: DataFrame) -> DataFrame:
    """Long results (sample_index, metric_name, score, reason) of judge metrics from ``judgements``.

    Without a judgement a row scores 0 with the error as its reason.
    """
    found = F.lit(None).cast("struct<score:double,reason:string>")
    failed = F.struct(F.lit(0.0).alias("score"), F.concat(F.lit("Failed to evaluate: "), F.col("error")).alias("reason"))
    for m in metrics:
        if m in SCORES:
            s = SCORES[m](F.col("text"))
            own = F.when(F.col("text").isNull() & F.col("error").isNotNull(), failed).otherwise(F.struct(s["score"].alias("score"), s["reason"].alias("reason")))
            found = F.when(F.col("metric") == m, own).otherwise(found)
    judged = got.select("sample_index", F.col("metric").alias("metric_name"), found.alias("s")).where("s is not null").select("sample_index", "metric_name", "s.score", "s.reason")
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), guard(m).alias("g")) for m in metrics if m in SCORES]))
    fixed = samples.select("sample_index", rows.alias("r")).where("r.g is not null").select("sample_index", F.col("r.m").alias("metric_name"), F.lit(0.0).alias("score"), F.col("r.g").alias("reason"))
    return judged.unionByName(fixed)


def evaluate(samples: DataFrame, metrics: list[str], cache: DataFrame, model: str, system: str = "", judge: Callable[[str, str], str] | None = None, **options: float) -> DataFrame:
    """``scored`` of the metrics' own requests: cached judgements are used as they are; misses go to ``judge``."""
    return scored(samples, metrics, judgements(requests(samples, metrics, model, system), cache, judge, **options)[0])
