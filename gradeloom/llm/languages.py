"""Languages of documents and of their segments, with confidences (problem 2).

Each sentence has a likelihood under every language's n-gram model: word unigrams, backed by character trigrams for
words the model doesn't know. A document is a mixture: expectation-maximisation estimates its proportions, and a
language joins the document's set only if it raises the document's log-likelihood by more than a penalty that grows with
the logarithm of the document's length. Where no language is EVIDENCE nats ahead of the others the language is
``unknown``. Texts are scored in batches, in arrays; only those in which another language gains run through EM.

The models are fitted here, on the driver, from a bounded sample of labelled rows (FIT_ROWS) and labelled seed texts
(SEED_ROWS). Labels may be wrong: after the first round they are forgotten and each sentence counts for the languages
it was found to be in.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.tokens import Codes, scan, sums
from gradeloom.llm.tokens import Column as Growing

#: Bounds of what the models are fitted on.
FIT_ROWS = 3000
SEED_ROWS = 2000
ROUNDS = 3
#: Gain in log-likelihood (nats) that another language must bring: PENALTY, and half the logarithm of the words for its
#: proportion (as in Schwarz's criterion).
PENALTY = 4.0
#: Lead in nats over the next language, below which a text's language is unknown.
EVIDENCE, UNKNOWN = 2.0, "unknown"
#: Weight and bound of what an unknown word says.
UNKNOWN_WEIGHT, UNKNOWN_BOUND = 0.4, 1.5
#: What a seed text counts in the first round, against 1 of a labelled row, whose label may be wrong.
SEED_WEIGHT = 5
#: Whitespace-separated tokens with a letter that a field needs before anything is reported of it.
LEAST_WORDS = 5

# Names of languages in labels (codes, three-letter codes, English names).
LABELS = {
    "en": ("en", "eng", "english"),
    "it": ("it", "ita", "italian"),
    "es": ("es", "spa", "spanish", "castilian"),
    "fr": ("fr", "fra", "fre", "french"),
    "de": ("de", "deu", "ger", "german"),
}
LANGS = tuple(LABELS)

_words = re.compile(r"[^\W\d_]+").findall
_sentence = re.compile(r"[^.!?…。！？\n]+[.!?…。！？]*")
_tokens = re.compile(r"[^\W\d_]+|[.!?…。！？\n]+").findall


@dataclass
class Scores:
    """Sentences with words of a batch of texts: the text, words and log-likelihoods (relative to their mean over the
    languages) of each, and the first sentence of every text."""

    text: np.ndarray
    sizes: np.ndarray
    ll: np.ndarray
    first: np.ndarray


@dataclass
class Found:
    """Chosen languages of a text, their proportions and the sentences' posteriors over them; none: unknown."""

    langs: list[int]
    pi: np.ndarray
    post: np.ndarray


def label_language(c: Column) -> Column:
    """The language that a label names, by code, code with region, three-letter code or English name; else null."""
    base = F.regexp_extract(F.lower(F.trim(c)), r"^([a-z]+)(?:[-_][a-z0-9]+)*$", 1)
    out = F.lit(None).cast("string")
    for lang, names in LABELS.items():
        out = F.when(base.isin(*names), F.lit(lang)).otherwise(out)
    return out


def n_words(c: Column) -> Column:
    """Whitespace-separated tokens with a letter."""
    return F.size(F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda t: t.rlike(r"\p{L}")))


def enough(text: str) -> bool:
    """At least LEAST_WORDS whitespace-separated tokens with a letter."""
    n = 0
    for t in text.split():
        n += any(map(str.isalpha, t))
        if n >= LEAST_WORDS:
            return True
    return False


class Model:
    """Word and character-trigram scores per language."""

    def __init__(self, langs: Sequence[str]):
        self.langs = tuple(langs)
        self.vocab: dict[str, int] = {}
        self.matrix = np.zeros((1, len(langs)))
        self.tri: dict[str, np.ndarray] = {}
        self.base = np.zeros(len(langs))

    def fit(self, counts: list[Counter]) -> None:
        n = len(self.langs)
        totals = np.array([max(1, sum(c.values())) for c in counts], float)
        words = sorted(w for w, k in sum(counts, Counter()).items() if k >= 1.5)
        c = np.array([[x[w] for x in counts] for w in words], float).reshape(-1, n)
        # A little of every word's mass goes to all languages, so that stray words of another language weigh little.
        share = c / totals
        p = share + 0.02 * share.mean(1, keepdims=True) + 0.05 / totals.mean()
        self.vocab = {w: i + 1 for i, w in enumerate(words)}
        self.matrix = np.vstack([np.zeros((1, n)), np.log(p) - np.log(p).mean(1, keepdims=True)])
        tri: list[Counter] = [Counter() for _ in counts]
        for x, t in zip(counts, tri):
            for w, k in x.items():
                s = f"^{w}$"
                for i in range(len(s) - 2):
                    t[s[i : i + 3]] += k
        sizes = np.array([max(1, sum(t.values())) for t in tri], float)
        keys = sorted(set().union(*tri))
        a = np.log((np.array([[t[g] for t in tri] for g in keys], float).reshape(-1, n) + 0.5) / sizes)
        self.tri = dict(zip(keys, a - a.mean(1, keepdims=True)))
        self.codes = None

    def _unknown(self, w: str) -> np.ndarray:
        s = f"^{w}$"
        v = sum((self.tri[g] for g in (s[i : i + 3] for i in range(len(s) - 2)) if g in self.tri), np.zeros(len(self.langs)))
        return np.clip((v - v.mean()) * UNKNOWN_WEIGHT, -UNKNOWN_BOUND, UNKNOWN_BOUND)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("codes", "score", "word", "name")}

    def _seen(self, w: str) -> None:
        low = w.lower()
        i = self.vocab.get(low)
        self.word.add(w[0].isalpha())
        self.name.add(i is None and w[0].isupper())
        self.score.add(self.matrix[i] if i is not None else self._unknown(low) if w[0].isalpha() else 0.0)

    def scores(self, texts: Sequence[str | None]) -> Scores:
        """The scored sentences of all texts. Words the model doesn't know say nothing if written like names."""
        if getattr(self, "codes", None) is None or len(self.codes) > 500_000:
            self.codes, self.score, self.word, self.name = Codes(self._seen), Growing(np.float64, len(self.langs)), Growing(bool), Growing(bool)
        code, first = scan(texts, _tokens, self.codes)
        word = self.word.data[code]
        text = np.repeat(np.arange(len(texts)), np.diff(first))
        begins = np.ones(len(code), bool)
        begins[1:] = ~word[:-1] | (text[1:] != text[:-1])
        begins, own = begins[word], text[word]
        code = code[word]
        row = self.score.data[code]
        row[~begins & self.name.data[code]] = 0.0
        at = np.flatnonzero(begins)
        sentence = own[at]
        edges = np.append(at, len(code))
        return Scores(sentence, np.diff(edges), sums(row, edges), np.searchsorted(sentence, np.arange(len(texts) + 1)))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Where the sentences with words stand."""
        return [m.span() for m in _sentence.finditer(text) if any(_words(m.group()))]

    def found(self, s: Scores) -> list[Found | None]:
        """The languages of every text; None for texts without words."""
        total = sums(s.ll, s.first)
        n = len(s.first) - 1
        best = total.argmax(1)
        rest = total.copy()
        rest[np.arange(n), best] = -np.inf
        lead = total[np.arange(n), best] - rest.max(1, initial=-np.inf) if total.shape[1] > 1 else np.full(n, np.inf)
        own = s.ll[np.arange(len(s.ll)), best[s.text]]
        ahead = sums(np.maximum(s.ll - own[:, None], 0.0), s.first).max(1, initial=0.0)
        words = sums(s.sizes, s.first)
        mixed = ahead > self.penalty(words)
        out: list[Found | None] = []
        for k in range(n):
            a, b = s.first[k], s.first[k + 1]
            if a == b:
                out.append(None)
            elif mixed[k]:
                out.append(Found(*self.mixture(s.sizes[a:b], s.ll[a:b])))
            elif lead[k] < EVIDENCE:
                out.append(Found([], np.zeros(0), np.zeros((b - a, 0))))
            else:
                out.append(Found([int(best[k])], np.ones(1), np.ones((b - a, 1))))
        return out

    @staticmethod
    def penalty(words: np.ndarray) -> np.ndarray:
        return PENALTY + 0.5 * np.log(np.maximum(words, 1))

    def mixture(self, sizes: np.ndarray, ll: np.ndarray) -> tuple[list[int], np.ndarray, np.ndarray]:
        """Chosen languages, their proportions and the sentences' posteriors over them."""
        best = [int(ll.sum(0).argmax())]
        top = float(ll[:, best[0]].sum())
        least = float(self.penalty(sizes.sum()))
        pi, post = np.ones(1), np.ones((len(ll), 1))
        while len(best) < len(self.langs) and len(ll) > 0:
            ahead = np.maximum(ll - ll[:, best].max(1, keepdims=True), 0).sum(0)
            ahead[best] = -1
            k = int(ahead.argmax())
            if ahead[k] <= least:
                break
            p, g, value = self._em(sizes, ll[:, [*best, k]])
            if value - top <= least:
                break
            best, pi, post, top = [*best, k], p, g, value
        return best, pi, post

    @staticmethod
    def _em(sizes: np.ndarray, ll: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        pi = np.full(ll.shape[1], 1 / ll.shape[1])
        w = sizes / sizes.sum()
        for _ in range(12):
            x = ll + np.log(pi)
            m = x.max(1, keepdims=True)
            z = np.log(np.exp(x - m).sum(1, keepdims=True)) + m
            g = np.exp(x - z)
            pi = np.maximum((g * w[:, None]).sum(0), 1e-3)
            pi /= pi.sum()
        return pi, g, float(z.sum())


def fit(labelled: DataFrame, seeds: DataFrame | None = None) -> Model:
    """Models from (text, label) rows: the FIT_ROWS with the least hash of their text, and SEED_ROWS seed rows."""

    def take(df: DataFrame, n: int) -> list[tuple[str, str]]:
        x = df.select("text", label_language(F.col("label")).alias("l")).where("text is not null and l is not null")
        # Thin by hash to a few times n first: else every task would send n rows to the driver.
        total = x.count()
        h = F.xxhash64("text")
        if total > 4 * n:
            x = x.where(F.shiftrightunsigned(h, 1) < F.lit(int((1 << 63) * (2 * n / total))))
        return [(r[0], r[1]) for r in x.orderBy(h, "l").limit(n).collect()]

    sure = take(seeds, SEED_ROWS) if seeds is not None else []
    rows = [(t, x, SEED_WEIGHT) for t, x in sure] + [(t, x, 1) for t, x in take(labelled, FIT_ROWS)]
    langs = [x for x in LANGS if any(r[1] == x for r in rows)] or list(LANGS)
    model = Model(langs)

    def count(into: Counter, text: str, weight: int = 1) -> None:
        for w in _words(text):
            into[w.lower()] += weight

    counts: list[Counter] = [Counter() for _ in langs]
    texts = []
    for t, x, weight in rows:
        # A sentence that a text repeats counts once, or one text could outweigh all others.
        once = list(dict.fromkeys(m.group() for m in _sentence.finditer(t)))
        texts.append(once)
        for s in once:
            count(counts[langs.index(x)], s, weight)
    model.fit(counts)
    for _ in range(ROUNDS - 1):
        new: list[Counter] = [Counter() for _ in langs]
        joined = ["\n".join(once) for once in texts]
        for j, f in zip(joined, model.found(model.scores(joined))):
            if f is not None and f.langs:
                for (a, b), g in zip(model.spans(j), f.post):
                    count(new[f.langs[int(g.argmax())]], j[a:b])
        model.fit(new)
    return model


FOUND = T.ArrayType(T.StructType([T.StructField("lang", T.StringType()), T.StructField("share", T.DoubleType()), T.StructField("confidence", T.DoubleType())]))
SEGMENT = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType()), T.StructField("lang", T.StringType()), T.StructField("confidence", T.DoubleType())]))


def describe(model: Model, texts: Sequence[str | None]) -> list[list[dict]]:
    """Per text its languages with share (the mixture's proportion) and confidence, largest share first."""
    s = model.scores(texts)
    x = np.exp(s.ll - s.ll.max(1, keepdims=True, initial=-np.inf))
    full = x / x.sum(1, keepdims=True)
    out: list[list[dict]] = []
    for k, f in enumerate(model.found(s)):
        a, b = s.first[k], s.first[k + 1]
        if f is None:
            out.append([])
        elif not f.langs:
            out.append([{"lang": UNKNOWN, "share": 1.0, "confidence": 0.0}])
        else:
            n, pick = s.sizes[a:b], f.post.argmax(1)
            sure = full[a:b][np.arange(b - a), np.array(f.langs)[pick]]
            rows = [{"lang": model.langs[x], "share": float(f.pi[j]), "confidence": float((sure * n)[pick == j].sum() / n[pick == j].sum())} for j, x in enumerate(f.langs) if (pick == j).any()]
            out.append(sorted(rows, key=lambda o: -o["share"]))
    return out


def segments_of(model: Model, texts: Sequence[str | None]) -> list[list[dict]]:
    """Per text its segments in order: neighbouring sentences of one language, with the confidence of their words."""
    s = model.scores(texts)
    x = np.exp(s.ll - s.ll.max(1, keepdims=True, initial=-np.inf))
    full = x / x.sum(1, keepdims=True)
    out: list[list[dict]] = []
    for k, f in enumerate(model.found(s)):
        rows: list[dict] = []
        if f is not None:
            a, b = s.first[k], s.first[k + 1]
            for (lo, hi), g, row, n in zip(model.spans(texts[k] or ""), f.post, full[a:b], s.sizes[a:b].tolist()):
                at = f.langs[int(g.argmax())] if f.langs else None
                lang, c = (UNKNOWN, 0.0) if at is None else (model.langs[at], float(row[at]))
                if rows and rows[-1]["lang"] == lang:
                    o = rows[-1]
                    o["confidence"] = (o["confidence"] * o["n"] + c * n) / (o["n"] + n)
                    o["n"], o["stop"] = o["n"] + n, hi
                else:
                    rows.append({"start": lo, "stop": hi, "lang": lang, "confidence": c, "n": n})
        out.append([{k: v for k, v in o.items() if k != "n"} for o in rows])
    return out


def detect(df: DataFrame, model: Model, keys: Sequence[str], columns: Sequence[str], segments: bool = False) -> DataFrame:
    """``keys`` and, for each text column, an array of its languages (share of words, confidence), largest share first,
    or of its segments in order. Null, empty and wordless texts give an empty array, texts without evidence ``unknown``."""
    kind = SEGMENT if segments else FOUND
    schema = T.StructType([*(df.schema[k] for k in keys), *(T.StructField(c, kind) for c in columns)])
    share = df.sparkSession.sparkContext.broadcast(model)
    item = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("lang", pa.string()), ("confidence", pa.float64())] if segments else [("lang", pa.string()), ("share", pa.float64()), ("confidence", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in batches:
            arrays = [b.column(k) for k in range(len(keys))]
            for j in range(len(columns)):
                arrays.append(pa.array((segments_of if segments else describe)(m, b.column(len(keys) + j).to_pylist()), pa.list_(item)))
            yield pa.RecordBatch.from_arrays(arrays, names=[*keys, *columns])

    return df.select(*keys, *columns).mapInArrow(run, schema)


def samples_model(samples: DataFrame, graded: DataFrame) -> Model:
    """Models for samples: fitted on its labelled questions and answers, seeded with the graded texts."""
    both = samples.select(F.concat_ws("\n", "question", "answer").alias("text"), F.col("lang").alias("label"))
    return fit(both, graded.select("text", F.col("lang").alias("label")))


def unnamed_languages(samples: DataFrame, model: Model) -> DataFrame:
    """Distinct (sample_index, field_name, lang): languages of question or answer that the row's label doesn't name.

    Fields with fewer than LEAST_WORDS words and unknown languages give no row.
    """
    keyed = samples.where(F.col("sample_index").isNotNull()).withColumn("named", label_language(F.col("lang")))
    share = samples.sparkSession.sparkContext.broadcast(model)
    fields = ("question", "answer")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = share.value
        for b in batches:
            named = b.column("named").to_pylist()
            at, field, lang = [], [], []
            for f in fields:
                texts = b.column(f).to_pylist()
                for i, got in enumerate(m.found(m.scores(texts))):
                    for x in got.langs if got is not None else ():
                        if m.langs[x] != named[i] and enough(texts[i]):
                            at.append(i)
                            field.append(f)
                            lang.append(m.langs[x])
            yield pa.RecordBatch.from_arrays([b.column("sample_index").take(pa.array(at, pa.int64())), pa.array(field, pa.string()), pa.array(lang, pa.string())], names=["sample_index", "field_name", "lang"])

    return keyed.select("sample_index", "named", *fields).mapInArrow(run, "sample_index long, field_name string, lang string").distinct()
