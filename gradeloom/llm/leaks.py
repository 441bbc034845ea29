"""Held-out test items inside a training corpus (problem 8).

Rare n-gram seeds: for every window of ``min_run`` words of every item the rarest of its ``seed_words``-grams, by their
counts over the whole corpus, become seeds, so that a document holding the window must hold a seed. Documents and
items meet at seeds; the text around each meeting is aligned with the item by Smith-Waterman over words, which scores
edited copies of the item or of a stretch of it, and the longest run of equal consecutive words is measured for the
exact question.

The items are the stated query set. Up to ``block_bytes`` of their text their index is shipped to the tasks and the
documents are never shuffled. Beyond that the corpus is scanned twice whatever the number of items: once counting the
grams that pass a Bloom filter of fixed size, once collecting the places of seeds with the words around them, which are
then joined with the items by gram (``joined_leaks``). Both ways find the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.llm.tokens import Codes, scan
from gradeloom.llm.tokens import Column as Growing
from gradeloom.operators.skew import join_spread
from gradeloom.session import cut

MIN_RUN = 12
SEED_WORDS = 6
#: Besides the rarest gram of a window, grams up to so many times as frequent are seeds too: an edited copy may lack
#: just the rarest.
RARE_TIMES = 8
#: Text of the items that is shipped to the tasks: the index built from it takes about 20 times as much.
BLOCK_BYTES = 4_000_000
MATCH, MISMATCH, GAP = 2, -1, -1
#: Least share of the best possible alignment score at which an edited copy is reported.
MIN_SIMILARITY = 0.8
#: Size of the Bloom filters, 2 to this power in bits (16 MB). A fuller filter lets more through to the join, no less.
BLOOM_BITS = 27

_find = re.compile(r"[^\W_]+").findall
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words(text: str) -> list[str]:
    """Maximal runs of letters and digits, without case."""
    found = " ".join(_find(text)).casefold()
    return found.split(" ") if found else []


def gram_keys(ids: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit key of every run of n ids."""
    if len(ids) < n:
        return np.empty(0, np.uint64)
    x = (ids.astype(np.int64).view(np.uint64) + np.uint64(1)) * _MULT
    x ^= x >> np.uint64(29)
    m = len(ids) - n + 1
    h = np.zeros(m, np.uint64)
    for i in range(n):
        h = h * np.uint64(0xD6E8FEB86659FD93) + x[i : i + m]
    h ^= h >> np.uint64(32)
    return h * _MULT


class Items:
    """Index of one block of items: vocabulary, word ids per item and the n-grams with their places."""

    def __init__(self, rows: list[tuple[int, str]], seed_words: int, min_run: int):
        self.seed_words, self.min_run = seed_words, min_run
        self.vocab: dict[str, int] = {}
        self.ids: list[int] = []
        self.text: list[np.ndarray] = []
        for i, t in sorted(rows):
            w = words(t)
            if len(w) >= seed_words:
                self.ids.append(i)
                self.text.append(np.array([self.vocab.setdefault(x, len(self.vocab)) for x in w], np.int32))
        keys = [gram_keys(t, seed_words) for t in self.text]
        self.grams = np.unique(np.concatenate(keys)) if keys else np.empty(0, np.uint64)
        self.gram_of = [np.searchsorted(self.grams, k) for k in keys]

    def choose(self, counts: np.ndarray) -> None:
        """Keep as seeds the rarest grams of every window of min_run words."""
        places: dict[int, list[tuple[int, int]]] = {}
        for n, g in enumerate(self.gram_of):
            for p in chosen(counts[g], g, self.seed_words, self.min_run):
                places.setdefault(int(g[p]), []).append((n, int(p)))
        self.seeds = np.array(sorted(places), np.int64)
        self.seed_keys = self.grams[self.seeds] if len(self.seeds) else np.empty(0, np.uint64)
        self.places = [places[int(s)] for s in self.seeds]


def chosen(counts: np.ndarray, grams: np.ndarray, seed_words: int, min_run: int) -> np.ndarray:
    """Places of an item's grams that are seeds: of every window of ``min_run`` words (of a shorter item: of all) the
    grams at most RARE_TIMES as frequent as its rarest, wherever they stand."""
    span = min(min_run - seed_words + 1, len(counts))
    taken = np.zeros(len(counts), bool)
    for s in range(len(counts) - span + 1):
        w = counts[s : s + span]
        taken[s : s + span] |= w <= RARE_TIMES * max(1, int(w.min()))
    return np.flatnonzero(np.isin(grams, grams[taken]))


def doc_ids(texts: list[str | None], vocab: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Vocabulary ids of the words of all texts (unknown: -1) and each text's first place; texts are kept apart."""
    get = vocab.get
    parts, first = [], np.zeros(len(texts) + 1, np.int64)
    for k, t in enumerate(texts):
        w = words(t) if t else []
        a = np.fromiter((get(x, -1) for x in w), np.int32, len(w))
        parts += [a, np.array([-1], np.int32)]
        first[k + 1] = first[k] + len(w) + 1
    return (np.concatenate(parts) if parts else np.empty(0, np.int32)), first


def hits(ids: np.ndarray, n: int, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, number in the sorted ``keys``) of every n-gram of known words that is one of ``keys``."""
    if len(ids) < n or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    ok = np.flatnonzero(bad[n:] == bad[:-n])
    g = gram_keys(ids, n)[ok]
    at = np.searchsorted(keys, g)
    at[at == len(keys)] = 0
    same = keys[at] == g
    return ok[same], at[same]


def align(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int, int]:
    """Smith-Waterman over words: (best score, its end in the region, longest run of equal words, its end)."""
    m = len(region)
    h, run = np.zeros(m + 1, np.int64), np.zeros(m + 1, np.int64)
    steps = -GAP * np.arange(m + 1)
    best = end = longest = longest_end = 0
    for w in item:
        eq = region == w
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(h[:-1] + np.where(eq, MATCH, MISMATCH), h[1:] + GAP)
        np.maximum(new, 0, out=new)
        h = np.maximum.accumulate(new + steps) - steps
        run[1:] = (run[:-1] + 1) * eq
        j = int(h.argmax())
        if h[j] > best:
            best, end = int(h[j]), j
        r = int(run.argmax())
        if run[r] > longest:
            longest, longest_end = int(run[r]), r
    return best, end, longest, longest_end


def stretch(item: np.ndarray, region: np.ndarray) -> tuple[int, int]:
    """Words of the item, and of the region, in the best local alignment."""
    m = len(region)
    rows = [np.zeros(m + 1, np.int64)]
    steps = -GAP * np.arange(m + 1)
    for w in item:
        new = np.zeros(m + 1, np.int64)
        new[1:] = np.maximum(rows[-1][:-1] + np.where(region == w, MATCH, MISMATCH), rows[-1][1:] + GAP)
        np.maximum(new, 0, out=new)
        rows.append(np.maximum.accumulate(new + steps) - steps)
    h = np.array(rows)
    i, j = i1, j1 = np.unravel_index(int(h.argmax()), h.shape)
    while h[i, j] > 0:
        if i and j and h[i, j] == h[i - 1, j - 1] + (MATCH if item[i - 1] == region[j - 1] else MISMATCH):
            i, j = i - 1, j - 1
        elif i and h[i, j] == h[i - 1, j] + GAP:
            i -= 1
        else:
            j -= 1
    return int(i1 - i), int(j1 - j)


def compare(item: np.ndarray, words: np.ndarray, lo: int, hi: int, starts: list[int]) -> tuple[int, int, int, float]:
    """Best score and longest run of an item against the words lo..hi around its meetings, and the words of the item in
    the best alignment with that alignment's own similarity. ``starts``: where the item would begin by each meeting."""
    size = len(item)
    best = longest = stretch_words = 0
    own = 0.0
    starts = sorted(starts)
    pad = size // 4 + 2
    i = 0
    while i < len(starts):  # meetings whose surroundings overlap are aligned together
        j = i
        while j + 1 < len(starts) and starts[j + 1] - starts[j] <= size:
            j += 1
        region = words[max(lo, starts[i] - pad) : min(hi, starts[j] + size + pad)]
        score, _, r, _ = align(item, region)
        if score > best and score >= MATCH * MIN_RUN * MIN_SIMILARITY:
            a, b = stretch(item, region)
            stretch_words, own = a, score / (MATCH * max(a, b))
        best, longest = max(best, score), max(longest, r)
        i = j + 1
    return best, longest, stretch_words, own


SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("item_id", T.LongType()),
        T.StructField("score", T.IntegerType()),
        T.StructField("similarity", T.DoubleType()),
        T.StructField("run_words", T.IntegerType()),
        T.StructField("item_words", T.IntegerType()),
        T.StructField("stretch_words", T.IntegerType()),
        T.StructField("stretch_similarity", T.DoubleType()),
    ]
)
_TYPES = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(_TYPES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=SCHEMA.names)


def _count_grams(docs: DataFrame, items: Items) -> np.ndarray:
    """Occurrences of every gram of the block over all documents (a vector as long as the block's grams)."""
    share = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = share.value
        total = np.zeros(len(it.grams), np.int64)
        for b in batches:
            ids, _ = doc_ids(b.column(0).to_pylist(), it.vocab)
            _, at = hits(ids, it.seed_words, it.grams)
            total += np.bincount(at, minlength=len(total))
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], names=["k", "n"])

    rows = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros(len(items.grams), np.int64)
    counts[rows["k"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return counts


def _search(docs: DataFrame, items: Items) -> DataFrame:
    share = docs.sparkSession.sparkContext.broadcast(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        it = share.value
        for b in batches:
            keys = b.column(0).to_pylist()
            ids, first = doc_ids(b.column(1).to_pylist(), it.vocab)
            at, seed = hits(ids, it.seed_words, it.seed_keys)
            doc = np.searchsorted(first, at, side="right") - 1
            met: dict[tuple[int, int], list[int]] = {}
            for d, p, s in zip(doc.tolist(), at.tolist(), seed.tolist()):
                for n, q in it.places[s]:
                    met.setdefault((d, n), []).append(p - q)
            out = []
            for (d, n), starts in met.items():
                if keys[d] is not None:
                    item = it.text[n]
                    best, longest, part, own = compare(item, ids, int(first[d]), int(first[d + 1]) - 1, starts)
                    out.append((keys[d], it.ids[n], best, best / (MATCH * len(item)), longest, len(item), part, own))
            yield _batch(out)

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


class _Hashes:
    """64-bit hashes of the words met by this worker."""

    def __init__(self) -> None:
        self.codes, self.hash = Codes(self.seen), Growing(np.uint64)

    def seen(self, w: str) -> None:
        self.hash.add(xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, and each text's first place."""
        code, first = scan(texts, words, self.codes)
        return self.hash.data[code], first


_known = _Hashes()


def hashed(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    global _known
    if len(_known.codes) > 500_000:
        _known = _Hashes()
    return _known.of(texts)


def _text_grams(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the n-grams within texts, and their places."""
    keys = gram_keys(h, n)
    text = np.searchsorted(first, np.arange(len(h)), side="right")
    ok = np.flatnonzero(text[: len(keys)] == text[n - 1 :][: len(keys)])
    return keys[ok], ok


def _slots(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    shift = np.uint64(64 - BLOOM_BITS)
    return (keys >> shift).astype(np.int64), ((keys * np.uint64(0xD6E8FEB86659FD93)) >> shift).astype(np.int64)


def bloom(keys: DataFrame) -> np.ndarray:
    """Bits of a Bloom filter of the column ``key``: at most 2 ** BLOOM_BITS / 64 words reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = np.unique(np.concatenate(_slots(b.column(0).to_numpy().view(np.uint64))))
            word, inv = np.unique(at >> 6, return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, inv, np.uint64(1) << (at & 63).astype(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bits.view(np.int64))], names=["word", "bits"])

    got = keys.select("key").mapInArrow(run, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros((1 << BLOOM_BITS) // 64, np.uint64)
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _slots(keys)
    one = np.uint64(1)
    return ((bits[a >> 6] >> (a & 63).astype(np.uint64)) & (bits[b >> 6] >> (b & 63).astype(np.uint64)) & one).astype(bool)


def joined_leaks(docs: DataFrame, items: DataFrame, min_run: int, seed_words: int) -> DataFrame:
    """``find_leaks`` by joins on grams, for any number of items: two scans of the documents."""
    sc = docs.sparkSession.sparkContext

    def of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = hashed(b.column(1).to_pylist())
            keys, place = _text_grams(h, first, seed_words)
            item = np.searchsorted(first, place, side="right") - 1
            ids = np.array(b.column(0).to_pylist(), np.int64)[item]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(ids), pa.array((place - first[item]).astype(np.int32))], names=["key", "item_id", "place"])

    grams = cut(items.mapInArrow(of_items, "key long, item_id long, place int"))
    share = sc.broadcast(bloom(grams))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, _ = _text_grams(*hashed(b.column(0).to_pylist()), seed_words)
            k, n = np.unique(keys[_passes(share.value, keys)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(n.astype(np.int64))], names=["key", "n"])

    counts = docs.select("text").mapInArrow(count, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
    per = grams.join(counts, "key", "left").groupBy("item_id").agg(F.array_sort(F.collect_list(F.struct("place", "key", F.coalesce("n", F.lit(0)).alias("n")))).alias("g"))

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, g in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                keys, n, place = (np.array([x[c] for x in g], np.int64) for c in ("key", "n", "place"))
                at = chosen(n, keys, seed_words, min_run)
                yield pa.RecordBatch.from_arrays([pa.array(keys[at]), pa.array(np.full(len(at), i)), pa.array(place[at].astype(np.int32))], names=["key", "item_id", "place"])

    seeds = cut(per.mapInArrow(choose, "key long, item_id long, place int"))
    longest = int(grams.agg(F.coalesce(F.max("place"), F.lit(0))).first()[0]) + seed_words
    reach = longest + longest // 4 + 2
    known = sc.broadcast(bloom(seeds))

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Stretches of documents around places of seeds; places nearer than an item is long share a stretch."""
        for b in batches:
            ids = b.column(0).to_pylist()
            h, first = hashed(b.column(1).to_pylist())
            keys, place = _text_grams(h, first, seed_words)
            ok = _passes(known.value, keys)
            keys, place = keys[ok], place[ok]
            doc = np.searchsorted(first, place, side="right") - 1
            new = np.ones(len(place), bool)
            new[1:] = (doc[1:] != doc[:-1]) | (place[1:] - place[:-1] > 2 * reach)
            out = []
            edges = np.append(np.flatnonzero(new), len(place))
            for a, z in zip(edges, edges[1:]):
                d = doc[a]
                lo, hi = max(int(first[d]), int(place[a]) - reach), min(int(first[d + 1]), int(place[z - 1]) + reach + 1)
                if ids[d] is not None:
                    out.append((ids[d], int(place[a] - first[d]), h[lo:hi].view(np.int64), keys[a:z].view(np.int64), (place[a:z] - lo).astype(np.int32)))
            cols = list(zip(*out)) if out else [[]] * 5
            types = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["doc_id", "at", "words", "keys", "places"])

    found = cut(docs.select("doc_id", "text").mapInArrow(collect, "doc_id long, at long, words array<long>, keys array<long>, places array<int>"))
    places = found.select("doc_id", "at", F.explode(F.arrays_zip("keys", "places")).alias("x")).select("doc_id", "at", F.col("x.keys").alias("key"), F.col("x.places").alias("p"))
    met = join_spread(places, seeds, ["key"], places.groupBy("key").agg(F.count("*").alias("n")), F.struct("doc_id", "p"), "inner")
    met = met.groupBy("doc_id", "at", "item_id").agg(F.collect_set(F.col("p") - F.col("place")).alias("starts"))
    texts = items.select("item_id", "text").dropDuplicates(["item_id"])
    pairs = met.join(found.select("doc_id", "at", "words").dropDuplicates(["doc_id", "at"]), ["doc_id", "at"]).join(texts, "item_id").select("doc_id", "item_id", "words", "starts", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h, first = hashed(b.column("text").to_pylist())
            out = []
            for k, (d, i, w, starts) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "item_id", "words", "starts")))):
                item = h[first[k] : first[k + 1]]
                best, most, part, own = compare(item, np.array(w, np.int64).view(np.uint64), 0, len(w), starts)
                out.append((d, i, best, best / (MATCH * len(item)), most, len(item), part, own))
            yield _batch(out)

    rest = [c for c in SCHEMA.names if c not in ("doc_id", "item_id")]
    top = F.max(F.struct("score", "similarity", "item_words", "stretch_words", "stretch_similarity")).alias("top")
    got = pairs.mapInArrow(run, SCHEMA).groupBy("doc_id", "item_id").agg(top, F.max("run_words").alias("run_words"))
    return got.select("doc_id", "item_id", *[F.col("run_words") if c == "run_words" else F.col(f"top.{c}").alias(c) for c in rest])


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN, seed_words: int = SEED_WORDS, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """SCHEMA rows of every document and item that share a seed.

    ``similarity`` is the alignment score over the item's best possible score; ``run_words`` the longest run of equal
    consecutive words; ``stretch_words`` and ``stretch_similarity`` measure the best aligned part of an item by itself
    (0 where it is too short to matter). Every pair with ``run_words >= min_run`` is in the result; edited copies are as
    far as they keep a seed. Null texts, items shorter than seed_words words and null ids match nothing. Repeated rows
    of a document may give repeated rows.
    """
    items = benchmark.where(F.col("item_id").isNotNull() & F.col("text").isNotNull()).select("item_id", "text")
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    if int(size) > block_bytes:
        return joined_leaks(docs, items, min_run, seed_words)
    index = Items([(r[0], r[1]) for r in items.collect()], seed_words, min_run)  # at most block_bytes
    index.choose(_count_grams(docs, index))
    return _search(docs, index)


def is_leak() -> F.Column:
    """Rows of ``find_leaks`` that are leaks: an exact run, an edited copy of the item, or one of a long part of it."""
    part = (F.col("stretch_words") >= MIN_RUN) & (F.col("stretch_similarity") >= MIN_SIMILARITY)
    return (F.col("run_words") >= MIN_RUN) | (F.col("similarity") >= MIN_SIMILARITY) | part


def exact_leaks(docs: DataFrame, benchmark: DataFrame, min_run: int = MIN_RUN) -> DataFrame:
    """Distinct (doc_id, item_id): the document holds min_run consecutive words of the item."""
    return find_leaks(docs, benchmark, min_run).where(F.col("run_words") >= min_run).select("doc_id", "item_id").distinct()
