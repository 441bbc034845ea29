"""Lexical metrics of an answer against its ground truth, as column expressions.

Each returns a struct (score, reason, and details); a missing answer or ground truth scores 0 with that reason.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import text as X
from gradeloom.functions.stemming import rouge_scores

MISSING = "Missing answer or ground truth."


def _scored(score: Column, reason: Column | str, **details: Column) -> Column:
    r = F.lit(reason) if isinstance(reason, str) else reason
    return F.struct(score.cast("double").alias("score"), r.alias("reason"), *[v.alias(k) for k, v in details.items()])


def _missing(answer: Column, truth: Column) -> Column:
    return (X.text(answer) == "") | (X.text(truth) == "")


def exact_match(answer: Column, truth: Column) -> Column:
    same = X.normalize_answer(answer) == X.normalize_answer(truth)
    miss = _missing(answer, truth)
    score = F.when(miss, 0.0).when(same, 1.0).otherwise(0.0)
    reason = F.when(miss, MISSING).when(same, "Matched exactly after normalization.").otherwise("Did not match exactly.")
    return _scored(score, reason)


def token_f1(answer: Column, truth: Column) -> Column:
    """Multiset precision, recall and F1 over normalised tokens."""
    miss = _missing(answer, truth)

    def body(p: Column) -> Column:
        hit, n, m = p["hit"], p["n"], p["m"]
        empty = (n == 0) | (m == 0)
        reason = F.when(p["miss"], MISSING).when(empty, "Empty after normalization.").when(hit == 0, "No common tokens.").otherwise("Computed token-level F1")
        zero = lambda x: F.when(p["miss"], 0.0).otherwise(F.coalesce(x, F.lit(0.0)))
        return _scored(zero(F.try_divide(2 * hit, F.when(hit > 0, n + m))), reason, precision=zero(F.try_divide(hit, n)), recall=zero(F.try_divide(hit, m)))

    pair = F.struct(X.answer_tokens(answer).alias("a"), X.answer_tokens(truth).alias("t"))
    sizes = X.let(pair, lambda p: F.struct(X.multiset_overlap(p["a"], p["t"]).alias("hit"), F.size(p["a"]).alias("n"), F.size(p["t"]).alias("m"), miss.alias("miss")))
    return X.let(sizes, body)


def bleu_tokens(c: Column) -> Column:
    """Lower-case words and single other marks. (Not the Treebank tokenizer: contractions are split at the apostrophe.)"""
    return F.regexp_extract_all(F.lower(X.text(c)), F.lit(r"([\p{L}\p{N}_]+|[^\s\p{L}\p{N}_])"), 1)


def bleu(answer: Column, truth: Column, n: int = 4) -> Column:
    """Sentence BLEU with uniform weights up to ``n``: clipped precisions, 0.1 in place of a zero count beyond
    unigrams, brevity penalty; 0 without a common unigram."""
    miss = _missing(answer, truth)

    def body(p: Column) -> Column:
        a, t = p["a"], p["t"]
        logs = F.lit(0.0)
        for k in range(1, n + 1):
            hit = X.multiset_overlap(X.ngrams(a, k), X.ngrams(t, k)).cast("double")
            total = F.greatest(F.lit(1), F.size(a) - (k - 1))
            logs = logs + F.ln(X.let(hit, lambda h: F.when(h > 0, h).otherwise(0.1)) / total) / n
        short = F.when(F.size(a) > F.size(t), 1.0).otherwise(F.exp(1 - F.try_divide(F.size(t), F.size(a))))
        empty = (F.size(a) == 0) | (F.size(t) == 0)
        score = F.when(miss | empty | ~F.arrays_overlap(a, t), 0.0).otherwise(short * F.exp(logs))
        reason = F.when(miss, MISSING).when(empty, "Empty after tokenization.").otherwise(f"Computed BLEU-{n}")
        return _scored(score, reason)

    return X.let(F.struct(bleu_tokens(answer).alias("a"), bleu_tokens(truth).alias("t")), body)


def rouge_tokens(c: Column) -> Column:
    return F.regexp_extract_all(F.lower(X.text(c)), F.lit(r"([a-z0-9]+)"), 1)


def rouge_n(answer: Column, truth: Column, n: int = 1) -> Column:
    """ROUGE-n without stemming, all within the JVM."""
    miss = _missing(answer, truth)

    def body(p: Column) -> Column:
        hit, a, t = p["hit"], p["n"], p["m"]
        f = F.coalesce(F.try_divide(2 * hit, F.when(hit > 0, a + t)), F.lit(0.0))
        part = lambda x: F.coalesce(F.try_divide(hit, x), F.lit(0.0))
        return _scored(F.when(miss, 0.0).otherwise(f), F.when(miss, MISSING).otherwise(f"Computed rouge{n} F1"), precision=part(a), recall=part(t))

    pair = F.struct(X.ngrams(rouge_tokens(answer), n).alias("a"), X.ngrams(rouge_tokens(truth), n).alias("t"))
    sizes = X.let(pair, lambda p: F.struct(X.multiset_overlap(p["a"], p["t"]).alias("hit"), F.size(p["a"]).alias("n"), F.size(p["t"]).alias("m")))
    return X.let(sizes, body)


_PRF = T.StructType([T.StructField(k, T.DoubleType()) for k in ("precision", "recall", "fmeasure")])
_ROUGE = T.StructType([T.StructField(k, _PRF) for k in ("rouge1", "rouge2", "rougeL")])


@F.pandas_udf(_ROUGE)  # type: ignore[call-overload]
def _rouge_udf(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for answer, truth in it:
        rows = [rouge_scores(a or "", t or "") for a, t in zip(answer, truth)]
        yield pd.DataFrame({k: [dict(zip(("precision", "recall", "fmeasure"), r[k])) for r in rows] for k in ("rouge1", "rouge2", "rougeL")})


def rouge(answer: Column, truth: Column, variant: str = "rougeL") -> Column:
    """ROUGE-1, -2 or -L with Porter stemming, in Arrow batches (longest common subsequences are no set operation)."""
    got = _rouge_udf(X.text(answer), X.text(truth))
    miss = _missing(answer, truth)
    return _scored(F.when(miss, 0.0).otherwise(got[variant]["fmeasure"]), F.when(miss, MISSING).otherwise(f"Computed {variant} F1"), precision=got[variant]["precision"], recall=got[variant]["recall"])
