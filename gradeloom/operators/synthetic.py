"""Synthetic question-answer samples from documents: seeded choices as columns, text from an injected judge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import scoring as K
from gradeloom.functions.jsontext import payload
from gradeloom.operators import judges
from gradeloom.sources.loaders import number_rows

INSTRUCTIONS = {
    "factual": "Ask a factual question that the text answers directly, with the exact answer.",
    "multi-hop": "Ask a question that needs two or more places of the text, with its answer.",
    "reasoning": "Ask a question whose answer follows from the text by reasoning, with its answer.",
    "comparative": "Ask a question that compares two things the text names, with its answer.",
}
SYSTEM = 'You write evaluation data. Reply with JSON only: {"question": "...", "answer": "..."}'
# Shares of hallucinated and of abstaining answers; the rest is grounded.
HALLUCINATE, ABSTAIN = 0.15, 0.15
BEHAVIOURS = {
    "hallucinate": "Give a plausible but wrong answer that ignores the context.",
    "abstain": "Say that the context does not contain enough information to answer.",
    "grounded": "Answer from the context only.",
}


def draw(seed: int, *parts: Column | str) -> Column:
    """A uniform number in 0..1 that depends on the seed and the row's keys only."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *[F.col(p) if isinstance(p, str) else p for p in parts]), 11) / F.lit(float(1 << 53))


def plan(chunk_rows: DataFrame, types: Sequence[str] = ("factual",), difficulty: str = "medium", per_chunk: int = 1, seed: int = 0) -> DataFrame:
    """One row per chunk and question to ask: question_type, prompt, behaviour and the chunk_id of its distractor.

    chunk_rows: (chunk_id 0..n-1, chunk). The distractor is another chunk, chosen by hash (null where there is one chunk).
    """
    n = chunk_rows.agg(F.count("*").alias("n_chunks"))
    x = chunk_rows.crossJoin(F.broadcast(n)).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(per_chunk))))  # one row
    kind = F.element_at(F.array(*map(F.lit, types)), F.floor(draw(seed, "chunk_id", "draw") * len(types)).cast("int") + 1)
    text = F.element_at(F.create_map(*[F.lit(v) for kv in INSTRUCTIONS.items() for v in kv]), F.when(kind.isin(*INSTRUCTIONS), kind).otherwise("factual"))
    roll = draw(seed + 1, "chunk_id", "draw")
    behaviour = F.when(roll < HALLUCINATE, "hallucinate").when(roll < HALLUCINATE + ABSTAIN, "abstain").otherwise("grounded")
    other = F.floor(draw(seed + 2, "chunk_id", "draw") * (F.col("n_chunks") - 1)).cast("long")
    other = F.when(F.col("n_chunks") > 1, F.when(other >= F.col("chunk_id"), other + 1).otherwise(other))
    prompt = F.concat(text, F.lit(f" Difficulty: {difficulty}.\n\nText:\n"), F.col("chunk"))
    return x.select("chunk_id", "draw", "chunk", kind.alias("question_type"), F.lit(difficulty).alias("difficulty"), behaviour.alias("behaviour"), other.alias("distractor_id"), prompt.alias("prompt"), (draw(seed + 3, "chunk_id", "draw") < 0.5).alias("swap"))


def accepted(question: Column, answer: Column) -> Column:
    q, a = F.trim(question), F.trim(answer)
    return F.coalesce((F.length(q) >= 10) & (F.length(a) >= 2) & (F.lower(q) != F.lower(a)), F.lit(False))


def generate(documents: DataFrame, judge: Callable[[str, str], str], types: Sequence[str] = ("factual",), difficulty: str = "medium", per_chunk: int = 1, seed: int = 0, answerer: Callable[[str, str], str] | None = None, **options: float) -> DataFrame:
    """Samples (question, answer, ground_truth, contexts, metadata) from chunks (chunk) of documents.

    ``answerer`` (default: the judge) answers in plain text; ``options`` go to ``judges.ask``.
    Pairs that are too short or repeat themselves are dropped; of equal questions (without case) the first chunk's stays.
    """
    rows = number_rows(documents.select("chunk"), "chunk_id")
    p = plan(rows, types, difficulty, per_chunk, seed)
    asked = p.select("*", F.lit(SYSTEM).alias("system_prompt"), K.cache_key(F.lit(""), F.lit(SYSTEM), F.concat("prompt", F.col("draw").cast("string"))).alias("key"))
    got = asked.join(judges.ask(asked, judge, **options).select("key", "text"), "key")
    v = payload(F.col("text"))
    qa = got.select("*", F.trim(F.try_variant_get(v, "$.question", "string")).alias("q"), F.trim(F.try_variant_get(v, "$.answer", "string")).alias("a")).where(accepted(F.col("q"), F.col("a")))
    first = qa.groupBy(F.lower("q").alias("k")).agg(F.min_by(F.struct(*qa.columns), F.struct("chunk_id", "draw")).alias("r")).select("r.*")
    system = F.element_at(F.create_map(*[F.lit(x) for kv in BEHAVIOURS.items() for x in kv]), F.col("behaviour"))
    prompt = F.concat(F.lit("Context:\n"), F.col("chunk"), F.lit("\n\nQuestion:\n"), F.col("q"), F.lit("\n\nAnswer:"))
    again = first.drop("prompt", "system_prompt", "text", "key").select("*", prompt.alias("prompt"), system.alias("system_prompt"))
    again = again.withColumn("key", K.cache_key(F.lit(""), F.col("system_prompt"), F.col("prompt")))
    done = again.join(judges.ask(again, answerer or judge, **options).select("key", "text"), "key", "left")
    others = rows.select(F.col("chunk_id").alias("distractor_id"), F.col("chunk").alias("other"))
    done = done.join(others, "distractor_id", "left")
    contexts = F.when(F.col("other").isNull(), F.array("chunk")).when(F.col("swap"), F.array("other", "chunk")).otherwise(F.array("chunk", "other"))
    meta = F.struct(F.lit("synthetic").alias("source"), "question_type", "difficulty", "chunk_id", F.lit(True).alias("is_synthetic"))
    return done.select(F.col("q").alias("question"), F.coalesce(F.trim("text"), F.lit("")).alias("answer"), F.col("a").alias("ground_truth"), contexts.alias("contexts"), meta.alias("metadata"))
