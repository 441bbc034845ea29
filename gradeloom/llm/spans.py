"""Long spans that stand verbatim in more than one record (problem 9).

Every window of ``part`` characters is hashed (Rabin-Karp, over whole arrays of code points). Of the windows inside
each stretch of ``span`` characters the one with the least hash is the stretch's anchor, so that equal stretches have
equal anchors and only about one window in a hundred is shuffled. Anchors are counted in Spark; those standing in one
document only are dropped. Occurrences of an anchor with the same surroundings form a class, and only where an anchor
has several classes are the hashes of the full ``span``-character windows counted, one occurrence a class. Repeated
windows merge into maximal intervals.

A window is identified by two independent 64-bit hashes (its anchor's and its own).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.skew import join_spread
from gradeloom.session import cut

SPAN = 400
#: Ways in which the occurrences of one anchor are spread over partitions.
SALTS = 16
#: Documents of one group that are paired within one key.
BLOCK = 512
#: Characters hashed in one go.
CHUNK = 1 << 20
_PLACE = np.uint64((1 << 22) - 1)

_U = np.uint64
_BASES = (_U(0x2545F4914F6CDD1D), _U(0x9E3779B97F4A7C15))


def _inverse(b: int) -> int:
    return pow(b, -1, 1 << 64)


_POWERS: dict[tuple[int, int], np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get((base, 0))
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        a = np.full(size, _U(base))
        a[0] = 1
        with np.errstate(over="ignore"):
            have = np.multiply.accumulate(a)
        _POWERS[(base, 0)] = have
    return have


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U(31))
    x = x * _U(0x7FB5D329728EA185)
    return x ^ (x >> _U(27))


class Hashes:
    """Hashes of any substring of one array of code points; base 0 for anchors, 1 for windows and surroundings."""

    def __init__(self, codes: np.ndarray):
        self.n = len(codes)
        c = _mix((codes.astype(np.uint64) + _U(1)) * _U(0xBF58476D1CE4E5B9))
        self.sums, self.inverse = [], []
        for b in _BASES:
            s = np.zeros(self.n + 1, np.uint64)
            np.cumsum(c * _powers(int(b), self.n + 1)[: self.n], out=s[1:])
            self.sums.append(s)
            self.inverse.append(_powers(_inverse(int(b)), self.n + 1))

    def of(self, base: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return _mix((self.sums[base][b] - self.sums[base][a]) * self.inverse[base][a])

    def all(self, base: int, size: int) -> np.ndarray:
        s = self.sums[base]
        return _mix((s[size:] - s[:-size]) * self.inverse[base][: self.n - size + 1])


def _sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive entries (van Herk's two passes)."""
    n = len(x)
    full = -(-n // w) * w
    p = np.full(full, np.iinfo(np.uint64).max, np.uint64)
    p[:n] = x
    p = p.reshape(-1, w)
    left = np.minimum.accumulate(p, axis=1).ravel()
    right = np.minimum.accumulate(p[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - w + 1], left[w - 1 : n])


def anchors(codes: np.ndarray, first: np.ndarray, span: int, merge: bool = True) -> tuple[np.ndarray, ...]:
    """Anchors of the texts that stand one after another in ``codes`` (text k from first[k] to first[k + 1]).

    Returns text number, place, first and last start of the windows it is the anchor of (all within the text), the
    anchor's hash and the hash of its surroundings.
    """
    part = span // 2
    h = Hashes(codes)
    key = (h.all(0, part) & ~_PLACE) | np.arange(h.n - part + 1, dtype=np.uint64)
    at = (_sliding_min(key, span - part + 1) & _PLACE).astype(np.int64)
    starts = np.arange(len(at))
    text = np.searchsorted(first, starts, side="right") - 1
    ok = starts + span <= first[text + 1]
    starts, at, text = starts[ok], at[ok], text[ok]
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (text[1:] != text[:-1])
    lo = np.flatnonzero(new)
    hi = np.append(lo[1:], len(at)) - 1
    p, text, lo, hi = at[lo], text[lo], starts[lo], starts[hi]
    a, b = np.maximum(first[text], p - (span - part)), np.minimum(first[text + 1], p + span)
    around = _mix(h.of(1, a, b) + _U(0x632BE59BD9B4E019) * ((p - a) * 4096 + (b - p)).astype(np.uint64))
    base = first[text]
    rows = text, p - base, lo - base, hi - base, h.of(0, p, p + part), around
    return _merged(*rows) if merge else rows


def _merged(text: np.ndarray, p: np.ndarray, lo: np.ndarray, hi: np.ndarray, x: np.ndarray, around: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one text's occurrences with the same surroundings that follow each other (periodic text) one row is enough."""
    same = np.zeros(len(p), bool)
    same[1:] = (text[1:] == text[:-1]) & (x[1:] == x[:-1]) & (around[1:] == around[:-1]) & (lo[1:] == hi[:-1] + 1)
    head = np.flatnonzero(~same)
    last = np.append(head[1:], len(p)) - 1 if len(head) else head
    return text[head], p[head], lo[head], hi[last], x[head], around[head]


def _chunks(ids: list, texts: list[str | None], least: int) -> Iterator[tuple[list, np.ndarray, np.ndarray]]:
    """Texts of at least ``least`` characters, joined in pieces of about CHUNK; longer texts come in overlapping cuts."""
    group: list = []
    parts: list[str] = []
    size = 0
    for i, t in zip(ids, texts):
        if i is None or t is None or len(t) < least:
            continue
        if size and size + len(t) > CHUNK:
            yield _joined(group, parts)
            group, parts, size = [], [], 0
        group.append(i)
        parts.append(t)
        size += len(t)
    if group:
        yield _joined(group, parts)


def _joined(group: list, parts: list[str]) -> tuple[list, np.ndarray, np.ndarray]:
    codes = np.frombuffer("".join(parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return group, codes, np.concatenate([[0], np.cumsum([len(t) for t in parts])]).astype(np.int64)


def _long(codes: np.ndarray, span: int) -> tuple[np.ndarray, ...]:
    """Anchors of one text longer than the place field allows: overlapping cuts whose windows are each taken once."""
    step, reach = 1 << 21, 2 * span
    out = []
    for s in range(0, len(codes), step):
        a, b = max(0, s - reach), min(len(codes), s + step + reach)
        t, p, lo, hi, x, y = anchors(codes[a:b], np.array([0, b - a]), span, False)
        lo, hi, p = lo + a, hi + a, p + a
        keep = (lo >= s) & (lo < s + step)  # a whole row belongs to the piece in which it begins
        out.append((t[keep], p[keep], lo[keep], hi[keep], x[keep], y[keep]))
    return _merged(*(np.concatenate(c) for c in zip(*out)))


def anchor_rows(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(h, around, doc_id, at) of every anchor of every text of at least ``span`` characters; ``at`` holds the first and
    the last start of its windows (``lo`` and ``hi``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for ids, codes, first in _chunks(b.column(0).to_pylist(), b.column(1).to_pylist(), span):
                if len(codes) >= int(_PLACE) - span:
                    t, p, lo, hi, h, y = _long(codes, span)
                else:
                    t, p, lo, hi, h, y = anchors(codes, first, span)
                doc = np.array(ids, np.int64)[t]
                at = (lo.astype(np.int64) << 32) | hi.astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(y.view(np.int64)), pa.array(doc), pa.array(at)], names=["h", "around", "doc_id", "at"])

    return docs.select("doc_id", "text").mapInArrow(run, "h long, around long, doc_id long, at long")


def _lo(at: str) -> F.Column:
    return F.shiftright(at, 32).cast("int")


def _hi(at: str) -> F.Column:
    return F.col(at).bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")


def _repeated(rows: DataFrame, keys: list[str], member: str, rest: list[str]) -> tuple[DataFrame, DataFrame]:
    """``rows`` spread by keys and salt, and (keys..., salt) of the keys that differing members have.

    Both the counting and the selection that follows use one exchange, and a hot key's rows stay spread over SALTS
    partitions. A filter would reach one of the two uses only, and a semi-join would move below the exchange: either way
    it would run twice. So every column is used on both sides, and the keys are selected by an inner join.
    """
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(member), F.lit(SALTS)))
    spread = salted.where(" and ".join(f"{c} is not null" for c in (*keys, "salt"))).repartition(*keys, "salt")
    used = F.max(F.xxhash64(member, *rest))
    part = spread.groupBy(*keys, "salt").agg(F.min(member).alias("d0"), F.max(member).alias("d1"), used.alias("used")).where("used is not null").drop("used")
    bits = F.bit_or(F.expr("shiftleft(1L, cast(salt AS int))")).alias("salts")
    hot = part.groupBy(*keys).agg(F.min("d0").alias("d0"), F.max("d1").alias("d1"), bits).where("d0 < d1")
    return spread, hot


def _salts(hot: DataFrame, keys: list[str]) -> DataFrame:
    held = F.expr(f"filter(sequence(0L, {SALTS - 1}L), i -> (shiftright(salts, cast(i AS int)) & 1L) != 0)")
    return hot.select(*keys, F.explode(held).alias("salt"))


def shared_members(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """The anchor rows whose anchor stands in two documents or more."""
    spread, hot = _repeated(anchor_rows(docs, span), ["h"], "doc_id", ["around", "at"])
    return spread.join(_salts(hot, ["h"]), ["h", "salt"]).drop("salt")


def classes(members: DataFrame) -> DataFrame:
    """(h, around, n, d0, d1, doc_id, at) per class of occurrences with the same surroundings: their number, the least
    and greatest document, and one occurrence."""
    one = F.min(F.struct("doc_id", "at"))
    got = members.groupBy("h", "around").agg(F.count("*").alias("n"), F.max("doc_id").alias("d1"), one.alias("one"))
    return got.select("h", "around", "n", F.col("one.doc_id").alias("d0"), "d1", F.col("one.doc_id").alias("doc_id"), F.col("one.at").alias("at"))


def class_windows(docs: DataFrame, cls: DataFrame, span: int = SPAN, carry: tuple[str, ...] = ()) -> DataFrame:
    """(h, around, w[, start, carry...]): the full windows of one occurrence of each class, where an anchor has several.

    carry: whole-number columns of ``cls`` that each window is given too, after its start.
    """
    several = cls.groupBy("h").agg(F.count("*").alias("k")).where("k > 1").select("h")
    ways = cls.groupBy("h").agg(F.count("*").alias("n"))
    reps = join_spread(cls, several, ["h"], ways, F.col("around"), "inner").select("doc_id", "h", "around", "at", *[F.col(c).cast("long").alias(c) for c in carry])
    each = ("h", "around", "at", *carry)
    by_doc = reps.groupBy("doc_id").agg(*[F.collect_list(c).alias(c) for c in each])
    joined = docs.where(F.length("text") >= span).select("doc_id", "text").join(by_doc, "doc_id")
    names = ["h", "around", "w", *(("start", *carry) if carry else ())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = {n: b.column(n).to_pylist() for n in each}
            for where, t in enumerate(b.column("text").to_pylist()):
                at = np.array(cols["at"][where], np.int64)
                lo, hi = at >> 32, at & 0xFFFFFFFF
                a0, b0 = int(lo.min()), int(hi.max()) + span
                hs = Hashes(np.frombuffer(t[a0:b0].encode("utf-32-le", "surrogatepass"), np.uint32))
                w = hs.all(1, span).view(np.int64)
                n = hi - lo + 1
                start = np.repeat(lo, n) + np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                wide = lambda c, n=n, where=where: pa.array(np.repeat(np.array(cols[c][where], np.int64), n))
                out = [wide("h"), wide("around"), pa.array(w[start - a0])]
                if carry:
                    out += [pa.array(start), *(wide(c) for c in carry)]
                yield pa.RecordBatch.from_arrays(out, names=names)

    return joined.mapInArrow(run, ", ".join(f"{c} long" for c in names))


def groups(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(h, w, doc_id, n): groups of n documents all of which hold one span; groups of the same documents once.

    h and w name the group. Every two documents that share a span are in some group together: this is the membership
    form of ``shared_pairs``, which copies don't blow up.
    """
    members = cut(shared_members(docs, span))
    cls = cut(classes(members))
    spread, hot = _repeated(class_windows(docs, cls, span), ["h", "w"], "around", [])
    # Windows shared by the same classes say the same: one of them stands for all. The classes are told by the exclusive
    # or of their 64-bit hashes.
    sign = spread.groupBy("h", "w", "salt").agg(F.count("*").alias("c"), F.bit_xor("around").alias("x"))
    sign = sign.groupBy("h", "w").agg(F.sum("c").alias("c"), F.bit_xor("x").alias("x"), F.bit_or(F.expr("shiftleft(1L, cast(salt AS int))")).alias("salts"))
    chosen = sign.where("c > 1").groupBy("h", "c", "x").agg(F.min(F.struct("w", "salts")).alias("one")).select("h", "one.*")
    linked = spread.join(_salts(chosen, ["h", "w"]), ["h", "w", "salt"]).select("h", "around", "w").distinct()
    own = cls.where("d0 < d1").select("h", "around", F.col("around").alias("w"))
    rows = join_spread(members.select("h", "around", "doc_id"), linked.unionByName(own), ["h", "around"], cls.select("h", "around", "n"), F.col("doc_id"), "inner")
    rows = cut(rows.select("h", "w", "doc_id").distinct())
    sets = rows.groupBy("h", "w").agg(F.count("*").alias("n"), F.sum(F.hash("doc_id").cast("long")).alias("s"), F.bit_xor(F.xxhash64("doc_id")).alias("x"))
    sets = cut(sets.where("n > 1"))
    one = sets.groupBy("n", "s", "x").agg(F.min(F.struct("h", "w")).alias("k")).select(F.col("k.h").alias("h"), F.col("k.w").alias("w"), "n")
    return join_spread(rows, one, ["h", "w"], sets.select("h", "w", F.col("n").alias("__n")), F.col("doc_id"), "inner", "__n")


def shared_pairs(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """Distinct (doc_id_a, doc_id_b), doc_id_a < doc_id_b: both texts hold the same ``span`` consecutive characters.

    Groups of more than BLOCK documents are paired block against block, each pair of blocks under its own key. Null
    and shorter texts hold no span; an empty table gives no rows.
    """
    g = groups(docs, span).withColumn("nb", F.ceil(F.col("n") / BLOCK).cast("int"))
    g = g.withColumn("b", F.pmod(F.xxhash64("doc_id"), F.col("nb")).cast("int"))
    cells = g.select("h", "w", "doc_id", "b", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)).alias("o"))
    cells = cells.select("h", "w", "doc_id", "b", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"))
    a, b = cells.alias("a"), cells.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("h", "w", "i", "j")]
    pairs = a.join(b, on).where((F.col("a.doc_id") < F.col("b.doc_id")) & ((F.col("a.i") == F.col("a.j")) | (F.col("a.b") != F.col("b.b"))))
    return pairs.select(F.col("a.doc_id").alias("doc_id_a"), F.col("b.doc_id").alias("doc_id_b")).distinct()


def shared_intervals(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, start, stop): the maximal intervals of each text every ``span``-window of which stands in another text."""
    members = cut(shared_members(docs, span))
    cls = cut(classes(members))
    many = cls.select("h", "around", "n")
    several = cls.where("d0 < d1").select("h", "around", F.lit(True).alias("several"))
    placed = members.select("h", "around", "doc_id", _lo("at").alias("lo"), _hi("at").alias("hi"))
    whole = join_spread(placed, several, ["h", "around"], many, F.col("doc_id"), "inner").select("doc_id", F.col("lo").alias("start"), (F.col("hi") + span).alias("stop"))
    # Classes of one document: their windows that stand in another document's class, as offsets from an occurrence's
    # first window, hold for all their occurrences. Periodic text repeats them (a row may hold several periods).
    sized = cls.withColumns({"first": _lo("at"), "windows": _hi("at") - _lo("at") + 1})
    win = class_windows(docs, sized, span, ("d0", "d1", "first", "windows"))
    often = win.groupBy("h", "w").agg(F.min("d0").alias("d0"), F.max("d1").alias("d1")).where("d0 < d1").select("h", "w")
    at = win.where("d0 = d1").join(often, ["h", "w"], "left_semi").select("h", "around", "windows", (F.col("start") - F.col("first")).alias("at"))
    run = F.col("at") - F.row_number().over(Window.partitionBy("h", "around").orderBy("at"))
    runs = at.withColumn("run", run).groupBy("h", "around", "windows", "run").agg(F.min("at").alias("a"), F.max("at").alias("b"))
    held = join_spread(placed, runs, ["h", "around"], many, F.struct("doc_id", "lo"), "inner").where(F.col("lo") + F.col("a") <= F.col("hi"))
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.expr("cast((hi - lo - a) div windows as long)"))))
    moved = F.col("lo") + F.col("turn") * F.col("windows")
    single = held.select("doc_id", (moved + F.col("a")).cast("int").alias("start"), (F.least(moved + F.col("b"), F.col("hi").cast("long")) + span).cast("int").alias("stop"))
    rows = whole.unionByName(single)
    by = Window.partitionBy("doc_id").orderBy("start", "stop")
    far = F.max("stop").over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = rows.withColumn("new", F.when(far >= F.col("start"), 0).otherwise(1))
    return new.withColumn("k", F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0))).groupBy("doc_id", "k").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("k")


def shared_share(docs: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, n_chars, shared_chars, share) of every document; null texts count as empty, with share 0."""
    got = shared_intervals(docs, span).groupBy("doc_id").agg(F.sum(F.col("stop") - F.col("start")).alias("shared_chars"))
    base = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).alias("n_chars"))
    out = base.join(got, "doc_id", "left").withColumn("shared_chars", F.coalesce("shared_chars", F.lit(0)))
    return out.withColumn("share", F.coalesce(F.try_divide(F.col("shared_chars"), F.col("n_chars")), F.lit(0.0)))
