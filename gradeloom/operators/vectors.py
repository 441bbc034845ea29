"""Vector metrics with an injected encoder. The default is a hashing encoder: deterministic, no model to download."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.functions import scoring as K
from gradeloom.functions import text as X

Encoder = Callable[[list[str]], np.ndarray]
_words = re.compile(r"\w+").findall
DIMENSIONS = 128


def hashing_encoder(texts: list[str], dimensions: int = DIMENSIONS) -> np.ndarray:
    """Signed word counts in hashed slots, unit length."""
    out = np.zeros((len(texts), dimensions))
    for i, t in enumerate(texts):
        for w in _words(t.lower()):
            h = xxhash.xxh64_intdigest(w)
            out[i, h % dimensions] += 1.0 if h >> 63 else -1.0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm == 0, 1, norm)


def encode(c: Column, encoder: Encoder = hashing_encoder) -> Column:
    """Vectors of a text column, in Arrow batches; the encoder is set up once per task."""

    def run(it: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in it:
            yield pd.Series(list(encoder(s.fillna("").tolist())))

    run.__annotations__ = {"it": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, T.ArrayType(T.DoubleType()))(X.text(c))


def semantic_similarity(answer: Column, truth: Column, encoder: Encoder = hashing_encoder) -> Column:
    """Cosine of the two texts' vectors, clamped; a missing text scores 0."""
    miss = (X.text(answer) == "") | (X.text(truth) == "")
    score = K.clamp(K.cosine(encode(answer, encoder), encode(truth, encoder)))
    return F.struct(F.when(miss, 0.0).otherwise(score).alias("score"), F.when(miss, "Missing answer or ground truth.").otherwise("Computed cosine similarity between embeddings.").alias("reason"))


def token_alignment(answer: str, truth: str, encoder: Encoder) -> tuple[float, float, float]:
    """Greedy alignment of token vectors: precision, recall and F1 of the best cosines."""
    a, t = _words(answer.lower()), _words(truth.lower())
    if not a or not t:
        return 0.0, 0.0, 0.0
    sim = encoder(a) @ encoder(t).T
    p, r = float(sim.max(1).mean()), float(sim.max(0).mean())
    return p, r, 2 * p * r / (p + r) if p + r > 0 else 0.0


def bert_score(answer: Column, truth: Column, encoder: Encoder = hashing_encoder) -> Column:
    """Clamped F1 of the token alignment, with precision and recall."""
    kind = T.StructType([T.StructField(n, T.DoubleType()) for n in ("precision", "recall", "f1")])

    def run(it: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for a, t in it:
            yield pd.DataFrame([token_alignment(x or "", y or "", encoder) for x, y in zip(a, t)], columns=["precision", "recall", "f1"])

    run.__annotations__ = {"it": Iterator[tuple[pd.Series, pd.Series]], "return": Iterator[pd.DataFrame]}
    got = F.pandas_udf(run, kind)(X.text(answer), X.text(truth))
    miss = (X.text(answer) == "") | (X.text(truth) == "")
    return F.struct(F.when(miss, 0.0).otherwise(K.clamp(got["f1"])).alias("score"), F.when(miss, "Missing answer or ground truth.").otherwise("Computed token alignment.").alias("reason"), got["precision"].alias("precision"), got["recall"].alias("recall"))
