"""Tutoring metrics: uptake, linguistic adaptation and the composite score."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import scoring as K
from gradeloom.functions import text as X

NO_ANSWER = "No answer provided."
LEAST_QUESTION_TOKENS = 5
# Lemmas of tentative language and markers of contrast, by language (en, it, es, fr, de).
TENTATIVE = (
    "maybe", "perhaps", "possibly", "might", "could", "wonder", "think", "guess", "seem", "appear", "suppose",
    "consider", "likely", "unlikely", "probably", "arguably",
    "forse", "magari", "sembrare", "chissà", "ipotizzare", "riflettere", "potere", "supporre", "provare", "pensare",
    "considerare", "immaginare",
    "quizás", "tal vez", "posiblemente", "parecer", "suponer", "considerar", "pensar", "imaginar", "probablemente",
    "peut-être", "possiblement", "sembler", "supposer", "considérer", "penser", "imaginer", "probablement",
    "vielleicht", "möglicherweise", "scheinen", "vermuten", "überlegen", "denken", "wahrscheinlich",
)
CONTRAST = (
    "but", "however", "although", "nevertheless", "yet", "nonetheless", "still", "conversely",
    "ma", "però", "tuttavia", "nonostante", "eppure",
    "pero", "sin embargo", "aunque", "no obstante",
    "mais", "cependant", "néanmoins", "toutefois", "pourtant",
    "aber", "jedoch", "dennoch", "trotzdem", "allerdings",
)
WEIGHTS = (0.4, 0.3, 0.3)
MAX_TENTATIVENESS = 0.05

PairScorer = Callable[[list[str], list[str]], list[float]]
TextScorer = Callable[[list[str]], list[float]]


def overlap_scorer(sources: list[str], targets: list[str]) -> list[float]:
    """Default pair scorer: share of the source's words that the target takes up. A stand-in for a trained classifier."""
    out = []
    for s, t in zip(sources, targets):
        a, b = set(re.findall(r"\w+", s.lower())), set(re.findall(r"\w+", t.lower()))
        out.append(len(a & b) / len(a) if a else 0.0)
    return out


def neutral_sentiment(texts: list[str]) -> list[float]:
    """Default sentiment: the middle of the scale. A stand-in for a trained model."""
    return [0.5] * len(texts)


def _pairs(scorer: PairScorer) -> Callable[[Column, Column], Column]:
    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for a, b in it:
            yield pd.Series(scorer(a.fillna("").tolist(), b.fillna("").tolist()), dtype="float64")

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


def _texts(scorer: TextScorer) -> Callable[[Column], Column]:
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(scorer(s.fillna("").tolist()), dtype="float64")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.DoubleType())


def uptake_route(question: Column, answer: Column, contexts: Column) -> Column:
    """Which pair decides: ``question``, ``context`` or ``none`` (null without an answer)."""
    long = F.size(X.split_words(question)) >= LEAST_QUESTION_TOKENS
    some = F.array_join(contexts, " ") != ""
    return F.when(X.text(answer) == "", F.lit(None)).when(long, "question").when(some, "context").otherwise("none")


def uptake(question: Column, answer: Column, contexts: Column, scorer: PairScorer = overlap_scorer, stop: Sequence[str] = ()) -> Column:
    """Probability that the answer takes up the question (short questions: the contexts), with the overlap of words that
    are not in ``stop``."""
    route = uptake_route(question, answer, contexts)
    joined = F.array_join(contexts, " ")
    f = _pairs(scorer)
    source = F.when(route == "question", question).when(route == "context", joined).otherwise("")
    p = K.clamp(f(source, X.text(answer)))
    n = F.size(X.split_words(question)).cast("string")
    score = F.when(route.isin("question", "context"), p).otherwise(0.0)
    reason = (
        F.when(route == "question", "Computed conversational uptake.")
        .when(route == "context", F.concat(F.lit("Computed context uptake (question of "), n, F.lit(" tokens is too short).")))
        .when(route == "none", "Insufficient data to compute any uptake score.")
        .otherwise(NO_ANSWER)
    )
    overlap = F.when(route.isNotNull() & (joined != ""), X.word_overlap(joined, answer, stop))
    return F.struct(score.alias("score"), reason.alias("reason"), overlap.alias("context_overlap"))


def syllables(word: str) -> int:
    """Groups of vowels; a silent final e doesn't count."""
    groups = re.findall(r"[aeiouyàâäáéèêëíìîïóòôöúùûü]+", word.lower())
    n = len(groups)
    if n > 1 and word.lower().endswith("e") and not word.lower().endswith(("le", "ee")):
        n -= 1
    return max(1, n)


_sentence_end = re.compile(r"[.!?…]+(?:\s|$)")
_word = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*").findall


def readability(text: str) -> tuple[float, float, int]:
    """Flesch reading ease, Flesch-Kincaid grade and word count."""
    words = _word(text)
    if not words:
        return 0.0, 0.0, 0
    s = max(1, len(_sentence_end.findall(text)))
    y = sum(map(syllables, words))
    w = len(words)
    return 206.835 - 1.015 * w / s - 84.6 * y / w, 0.39 * w / s + 11.8 * y / w - 15.59, w


_READ = T.StructType([T.StructField("ease", T.DoubleType()), T.StructField("grade", T.DoubleType()), T.StructField("words", T.IntegerType())])


def _read(it: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in it:
        yield pd.DataFrame([readability(t or "") for t in s], columns=["ease", "grade", "words"])


_read.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}


def word_tokens(c: Column) -> Column:
    """Lower-case words and single marks."""
    return F.regexp_extract_all(F.lower(X.text(c)), F.lit(r"([\p{L}\p{N}]+(?:['’-][\p{L}\p{N}]+)*|[^\s\p{L}\p{N}])"), 1)


def tentativeness(c: Column, limit: float = MAX_TENTATIVENESS) -> Column:
    """(score, ratio, count): tentative words over words, scaled to ``limit``. Forms are matched as written; a
    lemmatiser can be applied before."""

    def body(t: Column) -> Column:
        n = F.size(F.filter(t, lambda w: w.isin(*TENTATIVE)))
        ratio = F.coalesce(F.try_divide(n, F.nullif(F.size(t), F.lit(0))), F.lit(0.0))
        score = F.least(F.lit(1.0), ratio / limit) if limit > 0 else F.lit(0.0)
        return F.struct(score.alias("score"), F.round(ratio, 4).alias("ratio"), n.alias("count"))

    return X.let(word_tokens(c), body)


def has_contrast(c: Column) -> Column:
    return F.arrays_overlap(word_tokens(c), F.array(*map(F.lit, CONTRAST)))


def critique(c: Column, sentiment: Column) -> Column:
    """Sentiment (0..1) plus 0.1 where the text holds a contrast marker, at most 1."""
    return F.least(F.lit(1.0), sentiment + F.when(has_contrast(c), 0.1).otherwise(0.0))


def _mapped(f: Callable[[list[str]], list[str]]) -> Callable[[Column], Column]:
    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(f(s.fillna("").tolist()), dtype="object")

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.StringType())


def linguistic_adaptation(answer: Column, sentiment: TextScorer = neutral_sentiment, weights: tuple[float, float, float] = WEIGHTS, lemmas: Callable[[list[str]], list[str]] | None = None) -> Column:
    """Weighted readability, tentativeness and critique. ``lemmas`` turns texts into their lemmas before tentative words
    are counted."""
    a, b, c = (w / sum(weights) for w in weights)
    read = F.pandas_udf(_read, _READ)(X.text(answer))
    ease = K.clamp(read["ease"] / 100.0)
    tent = tentativeness(_mapped(lemmas)(X.text(answer)) if lemmas is not None else answer)["score"]
    crit = critique(answer, _texts(sentiment)(X.text(answer)))
    miss = X.text(answer) == ""
    score = F.round(K.clamp(a * ease + b * tent + c * crit), 4)
    reason = F.format_string("Weighted combination: readability=%.3f, tentativeness=%.3f, critique=%.3f", ease, tent, crit)
    return F.struct(F.when(miss, 0.0).otherwise(score).alias("score"), F.when(miss, NO_ANSWER).otherwise(reason).alias("reason"), read["ease"].alias("flesch_reading_ease"), read["grade"].alias("flesch_kincaid_grade"), read["words"].alias("word_count"))


def composite_reason(m1: Column, m2: Column, m3: Column, state: Column, label: Column, faithfulness: Column | None, failed: Column) -> Column:
    w = K.state_weights(state)
    out = F.concat(
        F.lit("State="), F.when(state == "", "?").otherwise(state), F.lit(" ("), F.when(label == "", "unknown").otherwise(label), F.lit(")"), F.format_string(" | weights=(%.2f, %.2f, %.2f)", w["w1"], w["w2"], w["w3"]), F.format_string(" | M1=%.4f, M2=%.4f, M3=%.4f", m1, m2, m3)
    )
    if faithfulness is None:
        return out
    return F.concat(out, F.format_string(" | faithfulness=%.4f (gate ", faithfulness), F.when(failed, "FAILED").otherwise("PASSED"), F.lit(")"))
