"""Reading level of documents by a Rasch-style latent difficulty model (problem 3).

Every document has a level, every word a difficulty and a discrimination: at level t the log-odds of word w against the
words of average difficulty are ``slope_w * (t - difficulty_w)``, so that the share of w among a document's words is
``exp(slope_w * (t - difficulty_w)) / Z(t)`` (Rasch's multiplicative model for reading, with discriminations). A word's
parameters are kept as ``base = -slope * difficulty`` and ``slope``. Easy words have negative slopes.

Estimation alternates over the whole corpus until the levels stand still: given the words each document's level is the
maximum of its likelihood; given the levels, Newton steps maximise the words' likelihood. The words need of the corpus
only sums per word and a histogram of the levels, which the tasks pre-aggregate. Documents with a known level anchor the
scale and weigh as much as all others together. Words are modelled per language of the anchors, and a document counts
for the language that makes its words most likely.

An extra beside the words: the length of the sentence a word stands in is an item with LENGTHS answers and a likelihood
of the same form, at SHAPE_WEIGHT of a word's weight. Without it short sentences of hard words read as hard as long ones.

Texts are tokenised once, into the checkpoint folder (32-bit word keys); the rounds only read keys.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.llm.tokens import Codes, Column, scan, sums
from gradeloom.session import cut

#: A word is an item of the model if at least this share of the documents holds it (and two do), or an anchor. So the
#: items are at most the mean number of distinct words of a document over SHARE, whatever the size of the corpus.
SHARE, LEAST_DOCS = 1e-4, 2
#: Anchors that the scale is fitted on. The sums of the anchors and those of all other documents of a language are each
#: scaled to MASS words, so that the priors weigh the same at any size.
ANCHOR_ROWS, MASS = 5000, 30_000.0
#: Rounds go on until the mean move of a level is at most REST (4 to 8 rounds); ROUNDS is a stop for models that oscillate.
ROUNDS, REST = 30, 0.02
SHAPE_WEIGHT, LENGTHS = 0.25, 16
#: Variance of the levels and of the slopes a priori, and the log-likelihood of a word that a language doesn't know.
LEVEL_VAR, SLOPE_VAR, UNKNOWN = 4.0, 1.0, -14.0
LEAST_WORDS = 30
GRID = np.linspace(-3.0, 3.0, 121)

_find = re.compile(r"[^\W\d_]+|[.!?…。！？]+(?=\s|$)|\n+").findall


class _Words:
    """What is known of the tokens met by this worker."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.codes = Codes(self.seen)
        self.key, self.word, self.name = Column(np.int32), Column(bool), Column(bool)

    def seen(self, w: str) -> None:
        self.key.add(np.uint32(xxhash.xxh32_intdigest(w.lower())).view(np.int32))
        self.word.add(w[0].isalpha())
        # Names (and short nouns of languages that capitalise them) say nothing, unless they begin a sentence.
        self.name.add(w[0].isupper() and not w.isupper() and len(w) < 12)


_known = _Words()


def items(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word keys of all texts, each text's first place, and per text how many words stand in sentences of each length."""
    if len(_known.codes) > 500_000:
        _known.clear()
    code, first = scan(texts, _find, _known.codes)
    word = _known.word.data[code] if len(code) else np.zeros(0, bool)
    text = np.repeat(np.arange(len(texts)), np.diff(first))
    begins = np.ones(len(code), bool)
    begins[1:] = ~word[:-1] | (text[1:] != text[:-1])
    sentence = np.cumsum(begins)
    size = np.bincount(sentence[word], minlength=int(sentence[-1]) + 1 if len(code) else 1)
    n = size[sentence]
    real = word & (n >= 2)
    shape = np.zeros((len(texts), LENGTHS), np.float32)
    bucket = np.minimum((2 * np.log2(np.maximum(n, 1))).astype(np.int64), LENGTHS - 1)
    np.add.at(shape, (text[real], bucket[real]), np.float32(SHAPE_WEIGHT))
    keep = real & (begins | ~_known.name.data[code]) if len(code) else real
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.bincount(text[keep], minlength=len(texts)), out=at[1:])
    return _known.key.data[code[keep]], at, shape


def encode(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, n_words, words, shape) of every row, in the checkpoint folder: whitespace-separated words, keys of the words
    that count, words per length of their sentence. Null and empty texts have no words."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).to_pylist()
            keys, at, shape = items(texts)
            words = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(keys))
            shapes = pa.ListArray.from_arrays(pa.array(np.arange(len(texts) + 1, dtype=np.int32) * LENGTHS), pa.array(shape.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(t.split()) if t else 0 for t in texts], pa.int32()), words, shapes], names=[key, "n_words", "words", "shape"])

    return cut(df.select(key, text).mapInArrow(run, f"{key} {kind}, n_words int, words array<int>, shape array<float>"))


def _lists(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, first places and shapes of a batch of encoded rows."""
    words, shape = b.column("words"), b.column("shape")
    at = words.offsets.to_numpy().astype(np.int64)
    keys = words.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    return keys, at - at[0], shape.flatten().to_numpy(zero_copy_only=False).reshape(-1, LENGTHS)


class Scale:
    """Items, their parameters per language, and the cut points between levels."""

    def __init__(self, keys: np.ndarray, langs: int):
        self.keys = keys
        self.prior = np.full((len(keys), langs), UNKNOWN)
        self.base, self.slope = np.zeros((len(keys), langs)), np.zeros((len(keys), langs))
        self.norm = np.zeros((langs, len(GRID)))
        self.shape = np.zeros((langs, LENGTHS, len(GRID)))
        self.cuts: list[tuple[int, float]] = []

    def find(self, keys: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Item numbers of the known keys, and each text's first place among them."""
        if not len(self.keys) or not len(keys):
            return np.zeros(0, np.int64), np.zeros_like(at)
        k = np.searchsorted(self.keys, keys)
        k[k == len(self.keys)] = 0
        ok = self.keys[k] == keys
        return k[ok], np.concatenate([[0], np.cumsum(ok)])[at]

    def levels(self, k: np.ndarray, at: np.ndarray, shape: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Level (NaN without known words) and language of every text."""
        n = len(at) - 1
        lang = sums(self.prior[k], at).argmax(1)
        own = np.repeat(lang, np.diff(at))
        known = self.prior[k, own] > UNKNOWN
        s = sums(self.slope[k, own] * known, at)
        size = sums(known.astype(np.int64), at)
        out = np.full(n, np.nan)
        step = 4096
        for a in range(0, n, step):
            z = slice(a, min(a + step, n))
            f = s[z, None] * GRID - size[z, None] * self.norm[lang[z]] - GRID**2 / (2 * LEVEL_VAR)
            for x in range(len(self.shape)):
                mine = lang[z] == x
                if mine.any():
                    f[mine] += shape[z][mine].astype(float) @ self.shape[x]
            j = np.clip(f.argmax(1), 1, len(GRID) - 2)
            r = np.arange(len(j))
            l, m, h = f[r, j - 1], f[r, j], f[r, j + 1]
            bend = l - 2 * m + h
            move = np.where(bend < 0, np.clip((l - h) / (2 * np.where(bend < 0, bend, -1)), -1, 1), 0)
            out[z] = np.where(size[z] > 0, GRID[j] + move * (GRID[1] - GRID[0]), np.nan)
        return out, lang

    def grade(self, theta: np.ndarray) -> np.ma.MaskedArray:
        """Levels of the anchors' scale; masked where there is no estimate or no scale."""
        if not self.cuts:
            return np.ma.masked_all(len(theta), np.int64)
        at = np.searchsorted(np.array([c for _, c in self.cuts[1:]]), np.nan_to_num(theta), side="right")
        return np.ma.array(np.array([x for x, _ in self.cuts])[at], mask=np.isnan(theta))


class Sums:
    """Sufficient sums of a set of documents with levels: per item and language its occurrences and their levels, per
    language and level the words, and the same of the sentence lengths."""

    def __init__(self, n: int, langs: int):
        self.count, self.level = np.zeros((n, langs)), np.zeros((n, langs))
        self.words = np.zeros((langs, len(GRID)))
        self.s_count, self.s_level = np.zeros((langs, LENGTHS)), np.zeros((langs, LENGTHS))
        self.moved = np.zeros(2)

    def add(self, k: np.ndarray, at: np.ndarray, shape: np.ndarray, theta: np.ndarray, lang: np.ndarray) -> None:
        t = np.where(np.isnan(theta), 0.0, theta)
        g = np.clip(np.round((t - GRID[0]) / (GRID[1] - GRID[0])).astype(np.int64), 0, len(GRID) - 1)
        size = np.diff(at)
        n, langs = self.count.shape
        flat = k * langs + np.repeat(lang, size)
        self.count += np.bincount(flat, minlength=n * langs).reshape(n, langs)
        self.level += np.bincount(flat, np.repeat(GRID[g], size), minlength=n * langs).reshape(n, langs)
        np.add.at(self.words, (lang, g), size)
        np.add.at(self.s_count, lang, shape)
        np.add.at(self.s_level, lang, shape * GRID[g][:, None])

    def parts(self) -> list[np.ndarray]:
        return [self.count, self.level, self.words, self.s_count, self.s_level, self.moved]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The sums that aren't 0 as (part, place, value)."""
        at = [np.flatnonzero(p) for p in self.parts()]
        part = np.repeat(np.arange(len(at), dtype=np.int32), [len(x) for x in at])
        return part, np.concatenate(at), np.concatenate([p.ravel()[x] for p, x in zip(self.parts(), at)]).astype(float)

    def take(self, part: np.ndarray, place: np.ndarray, value: np.ndarray) -> None:
        for i, p in enumerate(self.parts()):
            mine = part == i
            p.reshape(-1)[place[mine]] = value[mine]


def _maximise(count: np.ndarray, level: np.ndarray, words: np.ndarray, base: np.ndarray, slope: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Newton steps on the words of one language, block by block of words with the others' share held."""
    for _ in range(60):
        total, change = np.zeros(len(GRID)), 0.0
        for a in range(0, len(base), 8192):
            total += np.exp(base[a : a + 8192, None] + slope[a : a + 8192, None] * GRID).sum(0)
        for a in range(0, len(base), 8192):
            z = slice(a, a + 8192)
            e = np.exp(base[z, None] + slope[z, None] * GRID) * (words / total)
            e0, e1, e2 = e.sum(1) + 1e-3, e @ GRID, e @ GRID**2 + 1 / SLOPE_VAR
            g0, g1 = count[z] - e0, level[z] - e1 - slope[z] / SLOPE_VAR
            det = e0 * e2 - e1**2
            d0, d1 = np.clip((e2 * g0 - e1 * g1) / det, -1, 1), np.clip((e0 * g1 - e1 * g0) / det, -1, 1)
            base[z] += d0
            slope[z] += d1
            change = max(change, float(np.abs(d1).max(initial=0)))
        if change < 1e-3:
            break
    return base, slope


def _maximise_shape(count: np.ndarray, level: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Log-shares of the sentence lengths at every level, by Newton steps on all of them together."""
    n = words * count.sum() / max(words.sum(), 1e-9)
    x = np.zeros(2 * LENGTHS)

    def shares(x: np.ndarray) -> np.ndarray:
        z = x[:LENGTHS, None] + x[LENGTHS:, None] * GRID
        z = z - z.max(0)
        return z - np.log(np.exp(z).sum(0))

    ridge = np.repeat([0.01, 1 / SLOPE_VAR], LENGTHS)
    for _ in range(60):
        p = np.exp(shares(x))
        e = p * n

        def block(w: np.ndarray | float) -> np.ndarray:
            return np.diag((e * w).sum(1)) - (e * w) @ p.T

        g = np.concatenate([count - e.sum(1), level - e @ GRID]) - ridge * x
        h = np.block([[block(1.0), block(GRID)], [block(GRID), block(GRID**2)]]) + np.diag(ridge)
        d = np.linalg.solve(h, g)
        d *= min(1.0, 2.0 / max(np.abs(d).max(), 1e-9))
        x = x + d
        if np.abs(d).max() < 1e-5:
            break
    return shares(x)


def _estimate(scale: Scale, s: Sums) -> None:
    """The scale's parameters from the sums, starting from its present ones."""
    for x in range(scale.prior.shape[1]):
        use = s.count[:, x] > 0
        if not use.any():
            continue
        c = s.count[use, x]
        usual = np.log(c / c.sum())
        fresh = scale.prior[use, x] <= UNKNOWN
        base = np.where(fresh, usual, scale.base[use, x])
        base, slope = _maximise(c, s.level[use, x], s.words[x], base, np.where(fresh, 0.0, scale.slope[use, x]))
        scale.prior[:, x] = UNKNOWN
        scale.prior[use, x] = np.maximum(usual, UNKNOWN + 1)
        scale.base[use, x], scale.slope[use, x] = base, slope
        scale.norm[x] = np.log(np.exp(base[:, None] + slope[:, None] * GRID).sum(0))
        scale.shape[x] = _maximise_shape(s.s_count[x] + 0.5, s.s_level[x], s.words[x])


def _cuts(estimates: np.ndarray, levels: np.ndarray) -> list[tuple[int, float]]:
    """Cut points halfway between the high estimates of one level's anchors and the low ones of the next level's."""
    ok = ~np.isnan(estimates)
    got = {int(x): estimates[ok & (levels == x)] for x in sorted(set(levels[ok]))}
    names = list(got)
    out = [(names[0], float("-inf"))] if names else []
    for a, b in zip(names, names[1:]):
        out.append((b, float(np.quantile(got[a], 0.95) + np.quantile(got[b], 0.05)) / 2))
    return [(x, max(c, out[i - 1][1]) if i else c) for i, (x, c) in enumerate(out)]


def _vocabulary(encoded: DataFrame) -> np.ndarray:
    """Sorted keys of the words that at least SHARE of the documents with words hold, and LEAST_DOCS."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, at, _ = _lists(b)
            doc = np.repeat(np.arange(len(at) - 1), np.diff(at)).astype(np.uint64) << np.uint64(32)
            once = np.unique(doc | keys.view(np.uint32).astype(np.uint64))
            k, n = np.unique((once & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(n.astype(np.int64))], names=["k", "n"])

    docs = encoded.where(F.size("words") > 0).count()
    counts = encoded.select("words", "shape").mapInArrow(run, "k int, n long").groupBy("k").agg(F.sum("n").alias("n"))
    got = counts.where(F.col("n") >= max(LEAST_DOCS, SHARE * docs)).select("k").toPandas()
    return np.sort(got["k"].to_numpy(np.int32))


def fit(encoded: DataFrame, graded: DataFrame, rounds: int = ROUNDS) -> Scale:
    """The scale from anchors (text, reading_level[, lang]) and all rows of ``encode``.

    The anchors are the ANCHOR_ROWS with the least hash of their text. Without anchors no level is ever given.
    """
    lang = F.coalesce(F.col("lang"), F.lit("")) if "lang" in graded.columns else F.lit("")
    rows = graded.where("text is not null and reading_level is not null").select("text", F.col("reading_level").cast("double"), lang)
    got = rows.orderBy(F.xxhash64("text"), "text").limit(ANCHOR_ROWS).collect()
    if not got:
        return Scale(np.zeros(0, np.int32), 1)
    return fit_rows(encoded, [r[0] for r in got], np.array([r[1] for r in got]), [r[2] for r in got], rounds)


def fit_rows(encoded: DataFrame, texts: list[str], graded: np.ndarray, langs: list[str], rounds: int = ROUNDS) -> Scale:
    """``fit`` with the anchors as lists."""
    names = sorted(set(langs))
    lang = np.array([names.index(x) for x in langs])
    keys, at, shape = items(list(texts))
    scale = Scale(np.union1d(_vocabulary(encoded), keys), len(names))
    theta = graded - (graded.min() + graded.max()) / 2
    theta = theta * min(1.0, 1.5 / max(np.abs(theta).max(), 1e-9))  # the outer levels at 1.5 at most: room for the grid
    k, at = scale.find(keys, at)
    anchors = Sums(len(scale.keys), len(names))
    anchors.add(k, at, shape, theta, lang)
    _estimate(scale, anchors)
    before = None
    for _ in range(rounds):
        now = _corpus(encoded, scale, before)
        before = (scale.keys, scale.prior.copy(), scale.base.copy(), scale.slope.copy(), scale.norm.copy(), scale.shape.copy())
        both = Sums(len(scale.keys), len(names))
        for x in range(len(names)):
            f, g = (MASS / max(p.words[x].sum(), 1e-9) for p in (anchors, now))
            for p, a, c in zip(both.parts()[:2], anchors.parts(), now.parts()):
                p[:, x] = f * a[:, x] + g * c[:, x]
            for p, a, c in zip(both.parts()[2:5], anchors.parts()[2:5], now.parts()[2:5]):
                p[x] = f * a[x] + g * c[x]
        _estimate(scale, both)
        if now.moved[1] == 0 or now.moved[0] <= REST * now.moved[1]:
            break
    scale.cuts = _cuts(scale.levels(k, at, shape)[0], graded)
    return scale


def _corpus(encoded: DataFrame, scale: Scale, before: tuple | None) -> Sums:
    """Sums over all documents at their present levels, and by how much the levels moved since the round before."""
    share = encoded.sparkSession.sparkContext.broadcast((scale, before))  # bounded by SHARE

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc, last = share.value
        old = None
        if last is not None:
            old = Scale(last[0], last[1].shape[1])
            _, old.prior, old.base, old.slope, old.norm, old.shape = last
        total = Sums(len(sc.keys), sc.prior.shape[1])
        for b in batches:
            keys, at, shape = _lists(b)
            k, at = sc.find(keys, at)
            theta, lang = sc.levels(k, at, shape)
            ok = ~np.isnan(theta)
            if old is None:
                total.moved += (ok.sum() * 9.0, ok.sum())
            else:
                total.moved += (np.abs(theta[ok] - np.nan_to_num(old.levels(k, at, shape)[0][ok])).sum(), ok.sum())
            total.add(k, at, shape, theta, lang)
        part, place, value = total.rows()
        yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(place), pa.array(value)], names=["part", "place", "value"])

    got = encoded.select("words", "shape").mapInArrow(run, "part int, place long, value double").groupBy("part", "place").agg(F.sum("value").alias("value")).toPandas()
    out = Sums(len(scale.keys), scale.prior.shape[1])
    out.take(got["part"].to_numpy(), got["place"].to_numpy(np.int64), got["value"].to_numpy())
    return out


def levels(encoded: DataFrame, scale: Scale, key: str) -> DataFrame:
    """(key, n_words, theta, level) of every row of ``encode``: whitespace-separated words, latent and graded level.

    Texts without known words have a null theta and level. Texts that were cut are judged by what is left.
    """
    share = encoded.sparkSession.sparkContext.broadcast(scale)
    kind = encoded.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sc = share.value
        for b in batches:
            keys, at, shape = _lists(b)
            theta, _ = sc.levels(*sc.find(keys, at), shape)
            level = sc.grade(theta)
            none = np.isnan(theta)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(theta, pa.float64(), mask=none), pa.array(level.filled(0).astype(np.int32), pa.int32(), mask=np.ma.getmaskarray(level))], names=[key, "n_words", "theta", "level"])

    return encoded.mapInArrow(run, f"{key} {kind}, n_words int, theta double, level int")


def demanding(encoded: DataFrame, scale: Scale, key: str = "sample_index", level: int = 4, least: int = LEAST_WORDS) -> DataFrame:
    """Distinct keys whose text has at least ``least`` words and reads at ``level``."""
    x = levels(encoded.where(F.col(key).isNotNull()), scale, key)
    return x.where((F.col("n_words") >= least) & (F.col("level") == level)).select(key).distinct()
