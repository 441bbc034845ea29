"""Adapters from public question-answering sets to the sample columns (question, answer, ground_truth, contexts, metadata)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EMPTY = "array<string>"


def _out(df: DataFrame, question: Column, truth: Column, contexts: Column, metadata: Column | None = None) -> DataFrame:
    none = F.array().cast(EMPTY)
    return df.select(
        *(["seq"] if "seq" in df.columns else []),
        F.coalesce(question.cast("string"), F.lit("")).alias("question"),
        F.lit("").alias("answer"),
        F.coalesce(truth.cast("string"), F.lit("")).alias("ground_truth"),
        F.coalesce(contexts.cast(EMPTY), none).alias("contexts"),
        (metadata if metadata is not None else F.lit(None).cast("string")).alias("metadata"),
    )


def hotpotqa(df: DataFrame) -> DataFrame:
    """Contexts are titled paragraphs; of titles and sentence lists the shorter list decides."""
    t, s = F.coalesce("context.title", F.array().cast(EMPTY)), F.coalesce("context.sentences", F.array().cast("array<array<string>>"))
    n = F.least(F.size(t), F.size(s))
    paragraphs = F.zip_with(F.slice(t, F.lit(1), n), F.slice(s, F.lit(1), n), lambda a, b: F.concat(F.lit("Title: "), a, F.lit("\n"), F.array_join(b, "")))
    meta = [c for c in ("level", "type") if c in df.columns]
    return _out(df, F.col("question"), F.col("answer"), paragraphs, F.to_json(F.struct(*meta)) if meta else None)


def nq(df: DataFrame) -> DataFrame:
    return _out(df, F.col("question"), F.try_element_at("answer", F.lit(1)), F.array(), F.to_json(F.struct(F.col("answer").alias("all_answers"))))


def triviaqa(df: DataFrame) -> DataFrame:
    contexts = F.filter("search_results.search_context", lambda c: c.isNotNull() & (c != ""))
    return _out(df, F.col("question"), F.col("answer.value"), contexts, F.to_json(F.struct(F.col("answer.aliases").alias("aliases"))))


def squad2(df: DataFrame) -> DataFrame:
    """Unanswerable rows are dropped, before any limit."""
    return _out(df.where(F.size("answers.text") > 0), F.col("question"), F.try_element_at("answers.text", F.lit(1)), F.array("context"))


def _first(df: DataFrame, *names: str) -> Column:
    """The first of the named columns that the source has, whatever its value."""
    for n in names:
        if n in df.columns:
            return F.col(n)
    return F.lit(None).cast("string")


def _contexts(df: DataFrame, names: tuple[str, ...]) -> Column:
    for n in names:
        if n not in df.columns:
            continue
        kind = df.schema[n].dataType.simpleString()
        if kind.startswith("array<struct"):
            return F.transform(n, lambda d: d["text"])
        return F.col(n) if kind.startswith("array") else F.when(F.col(n).isNotNull(), F.array(n))
    return F.array()


def _rest(df: DataFrame, used: set[str]) -> Column:
    rest = [c for c in df.columns if c not in used | {"seq"}]
    return F.to_json(F.struct(*rest)) if rest else F.lit(None).cast("string")


def rgb(df: DataFrame) -> DataFrame:
    used = {"query", "question", "answer", "ground_truth", "docs", "context"}
    return _out(df, _first(df, "query", "question"), _first(df, "answer", "ground_truth"), _contexts(df, ("docs", "context")), _rest(df, used))


def recall(df: DataFrame) -> DataFrame:
    used = {"query", "question", "answer", "ground_truth", "docs", "context"}
    return _out(df, _first(df, "question", "query"), _first(df, "ground_truth", "answer"), _contexts(df, ("context", "docs")), _rest(df, used))


ADAPTERS: dict[str, Callable[[DataFrame], DataFrame]] = {"hotpotqa": hotpotqa, "nq": nq, "triviaqa": triviaqa, "squad2": squad2, "rgb": rgb, "recall": recall}


def get_adapter(name: str) -> Callable[[DataFrame], DataFrame]:
    key = name.strip().lower()
    if key not in ADAPTERS:
        raise ValueError(f"unknown benchmark {name!r}; known: {', '.join(sorted(ADAPTERS))}")
    return ADAPTERS[key]


def load(name: str, df: DataFrame, max_samples: int | None = None) -> DataFrame:
    """Adapted rows; with a limit the first by ``seq`` (a source order is needed to say which)."""
    got = get_adapter(name)(df)
    if max_samples is None:
        return got
    if "seq" not in got.columns:
        from gradeloom.sources.loaders import number_rows

        got = number_rows(got, "seq")
    return got.orderBy("seq").limit(max_samples)


#: Splits that are tried after the one asked for fails.
FALLBACK_SPLITS = {"recall": ("train",)}


def load_split(spark: SparkSession, name: str, path: str, split: str = "validation", max_samples: int | None = None, reader: Callable[[SparkSession, str, str], DataFrame] | None = None) -> DataFrame:
    """A benchmark's split from the hub, or from a JSON file (which has no splits), adapted.

    ``reader(spark, path, split)`` replaces the hub.
    """
    from gradeloom.sources import loaders

    if path.endswith(".jsonl"):
        return load(name, loaders.number_rows(loaders.read_json_lines(spark, path), "seq"), max_samples)
    if path.endswith(".json"):
        return load(name, loaders.number_rows(loaders.read_json_array(spark, path).drop("__seq"), "seq"), max_samples)
    get_adapter(name)
    splits = (split, *FALLBACK_SPLITS.get(name.strip().lower(), ()))
    for i, s in enumerate(splits):
        try:
            rows = (reader or loaders.read_hub)(spark, path, s)
            return load(name, rows, max_samples)
        except Exception:
            if i + 1 == len(splits):
                raise
    raise AssertionError
