"""Texts that were cut off by a field limit or in transfer (problem 5).

Evidence, all of it counted over the whole corpus:

* the vocabulary trie, kept as a table of nodes (a prefix and the occurrences of the words below it): a final token
  that is no known word but a proper prefix of known ones was cut inside a word;
* how often the final one to three words end a sentence elsewhere: words that never do were cut inside a sentence;
* length: open-ended texts of one source that pile up at one length, in characters or in bytes, point to its limit;
* what stands behind the cut (ellipsis, hyphen, broken character, stray closers) and what stands open in the text.

n-grams are counted as 64-bit keys within each Arrow batch before Spark adds them up; only unigrams keep their text.
What is asked of the counts is asked once per distinct open text, and its answer joined to the rows, hot texts spread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.llm.tokens import Codes, scan
from gradeloom.llm.tokens import Column as Growing
from gradeloom.operators.skew import join_spread
from gradeloom.session import cut

#: A word is known from this many occurrences that don't end an open text.
KNOWN = 2
#: Least number of other occurrences from which an n-gram speaks.
LEAST = 4
#: Below this share of sentence ends the final words stop inside a sentence; from WHOLE on they may well be its end.
ENDS, WHOLE = 0.05, 0.3
#: A length is a limit if at least SPIKE_LEAST different open tails have it, SPIKE_TIMES as many as its neighbours.
#: and at least SPIKE_SHARE of all different open tails of the source.
SPIKE_LEAST, SPIKE_TIMES, SPIKE_CHARS, SPIKE_SHARE = 4, 6.0, 20, 0.05
#: A text of fewer words than FEW is a value, not a cut text.
FEW = 3
#: Limits are joined as a broadcast up to so many rows, beyond them by shuffle.
BROADCAST_ROWS = 50_000

_terminal = ".!?。！？"
_split = re.compile(r"[.!?。！？…]+(?=[\s\"'»”’)\]]|$)|\n+").split
_token = re.compile(r"[^\W_]+").findall
_words = re.compile(r"[^\W_]+").finditer
_stream = re.compile(r"[^\W_]+|[.!?。！？…]+(?=[\s\"'»”’)\]]|$)|\n+").findall
_blank = " \t\r\n\v\f\x1c\x1d\x1e\x1f\x85\xa0               　​‌‍⁠﻿­"
_item = re.compile(r"\s*(?:[-*•—–+]|\(?\w{1,3}[.)])\s+\S.{0,60}")
_tag = re.compile(r"</?\w*$").search
_hashes: dict[str, int] = {}


def _key(word: str) -> int:
    k = _hashes.get(word)
    if k is None:
        if len(_hashes) > 500_000:
            _hashes.clear()
        k = _hashes[word] = xxhash.xxh64_intdigest("#" if any(c.isdigit() for c in word) else word)
    return k


def _grams(k: np.ndarray, n: int) -> np.ndarray:
    h = np.zeros(len(k), np.uint64)
    for i in range(n):  # the gram that ends at each place
        prev = np.zeros(len(k), np.uint64)
        prev[i:] = k[: len(k) - i]
        h = (h ^ prev) * np.uint64(0x9E3779B97F4A7C15 + 2 * n)
        h ^= h >> np.uint64(29)
    return h


def _gram(*keys: np.ndarray) -> np.ndarray:
    """What ``_grams`` gives where the words ``keys``, last one first, end."""
    h = np.zeros(len(keys[0]), np.uint64)
    for k in keys:
        h = (h ^ k) * np.uint64(0x9E3779B97F4A7C15 + 2 * len(keys))
        h ^= h >> np.uint64(29)
    return h


class Tail:
    """What the end of one text looks like; ``None`` from ``tail`` means a finished text."""

    __slots__ = ("few", "forced", "keys", "mark", "shape", "unit", "word")


def unmarked(text: str) -> tuple[str, bool, bool, bool]:
    """The text without what stands behind a cut; whether there was such a mark, a broken character, a gap before it."""
    t = text.rstrip(_blank)
    mark = broken = False
    gap = len(t) < len(text)
    while t:
        c = t[-1]
        tag = _tag(t)
        if c == "\ufffd":
            broken = mark = True
        elif t.endswith("...") and len(t) > 3:
            t = t[:-3].rstrip(_blank)
            mark = True
            continue
        elif c in "…\\[{<|~^" or (c in "-–—" and len(t) > 1):
            mark = True
        elif (c in "}]>" and t.count(c) > t.count("{[<"["}]>".index(c)])) or (c in "\"'" and t.count(c) % 2 and (mark or t[-2:-1].isalnum())):
            mark = True
        elif tag:
            t = t[: tag.start()].rstrip(_blank)
            mark = True
            continue
        else:
            break
        rest = t[:-1] if c in "}]>\"'" else t.rstrip(c)
        t = rest.rstrip(_blank)
        gap = len(t) < len(rest)
    return t, mark, broken, gap


def last_words(text: str) -> list[str]:
    """The last three words, in lower case, of the text's last sentence."""
    size = 256
    while True:
        end = text[-size:]
        parts = _split(end)
        toks = _token(parts[-1].lower())
        # Complete if the sentence begins in this stretch or three words surely do.
        if len(parts) > 1 or len(toks) > 3 or size >= len(text):
            return toks[-3:]
        size *= 8


def tail(text: str) -> Tail | None:
    t, mark, broken, gap = unmarked(text)
    if not t:
        return None
    c = t[-1]
    closed = t.rstrip("\"'»”’)]" + _blank)
    if closed[-1:] and closed[-1] in _terminal:
        if broken and gap and c in _terminal:
            pass  # the broken character began another sentence
        else:
            return None
    x = Tail()
    x.mark = mark
    line = t[t.rfind("\n") + 1 :]
    opened = line.count("(") > line.count(")") or t.count("$$") % 2 == 1 or line.count("{") > line.count("}")
    x.forced = broken or opened or c in ",;(¿¡"
    # Lists, signatures and anything that doesn't end in a letter or digit count as whole unless a limit shows.
    x.shape = not (c.isalnum() or x.forced) or (line != t and _item.fullmatch(line) is not None and not x.forced)
    toks = last_words(t)
    x.word = toks[-1] if toks and c.isalnum() and toks[-1].isalpha() else ""
    x.unit = len(x.word) == 1 or any(d.isdigit() for d in "".join(toks[-2:-1]))
    x.keys = [0] * (3 - len(toks)) + [_key(w) for w in toks]
    x.few = len(list(islice(_words(t), FEW))) < FEW
    return x


KEYS = ["word", "unit", "k1", "k2", "k3", "k32"]
_FLAGS = ("mark", "forced", "shape", "few", "unit")
TAIL = "chars int, bytes int, mark boolean, forced boolean, shape boolean, few boolean, unit boolean, same long, word string, k1 long, k2 long, k3 long, k32 long"
TAIL_NAMES = [x.split()[0] for x in TAIL.split(", ")]


def tail_columns(texts: list[str | None]) -> tuple[list[int], list[pa.Array]]:
    """Numbers of the texts that don't end in a full stop or the like, and their TAIL columns."""
    rows: list[int] = []
    found: list[Tail] = []
    known: dict[str, Tail | None] = {}
    for i, t in enumerate(texts):
        if not t:
            continue
        if t in known:
            x = known[t]
        else:
            x = known[t] = tail(t)
        if x is not None:
            rows.append(i)
            found.append(x)
    mine = [texts[i] or "" for i in rows]
    a, b, c = np.array([x.keys for x in found], np.uint64).reshape(-1, 3).T
    columns = [
        pa.array([len(t) for t in mine], pa.int32()),
        pa.array([len(t.replace("\ufffd", "").encode("utf-8", "surrogatepass")) for t in mine], pa.int32()),
        *(pa.array([getattr(x, a) for x in found], pa.bool_()) for a in _FLAGS),
        pa.array(np.array([xxhash.xxh64_intdigest(t.encode("utf-8", "surrogatepass")) for t in mine], np.uint64).view(np.int64)),
        pa.array([x.word for x in found], pa.string()),
        *(pa.array(g.view(np.int64)) for g in (_gram(c), _gram(c, b), _gram(c, b, a), _gram(b, a))),
    ]
    return rows, columns


def core(text: F.Column) -> F.Column:
    """The text up to its last letter or digit, without what stands behind a cut."""
    return F.reverse(F.regexp_replace(F.reverse(text), r"^[^\p{L}\p{N}]+", ""))


def tails(texts: DataFrame, cores: bool = False) -> DataFrame:
    """One row per text that doesn't end in a full stop or the like; ``core`` is the hash of its core if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, columns = tail_columns(b.column(4).to_pylist())
            at = pa.array(rows, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(at) for c in range(4)), *columns], names=["field_name", "record_id", "grp", "core", *TAIL_NAMES])

    return texts.select("field_name", "record_id", "grp", (F.xxhash64(core(F.col("text"))) if cores else F.lit(0).cast("long")).alias("core"), "text").mapInArrow(run, "field_name string, record_id long, grp string, core long, " + TAIL)


class _Grams:
    """What is known of the tokens met by this worker."""

    def __init__(self) -> None:
        self.codes = Codes(self.seen)
        self.key, self.letters, self.real = Growing(np.uint64), Growing(bool), Growing(bool)
        self.text: list[str | None] = []

    def seen(self, w: str) -> None:
        self.real.add(w[0].isalnum())
        self.key.add(_key(w))
        self.letters.add(w.isalpha())
        self.text.append(w if w.isalpha() else None)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(k, word, n, ends, opens): occurrences of every 1- to 3-gram of words, how often it ends a finished sentence and
    how often an open text; ``word`` for unigrams of letters only."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Grams()
        for b in batches:
            if len(known.codes) > 500_000:
                known = _Grams()
            times = Counter(b.column(0).to_pylist())
            times.pop(None, 0)
            code, first = scan([unmarked(t)[0].lower() for t in times], _stream, known.codes)
            word = known.real.data[code]
            if not word.any():
                continue
            text = np.repeat(np.arange(len(times)), np.diff(first))
            begins = np.ones(len(code), bool)
            begins[1:] = ~word[:-1] | (text[1:] != text[:-1])
            ends = np.ones(len(code), bool)  # the last word of a sentence: a stop or another text follows
            ends[:-1] = ~word[1:] | (text[1:] != text[:-1])
            closed = np.zeros(len(code), bool)  # ... by a stop
            closed[:-1] = ~word[1:] & (text[1:] == text[:-1])
            begins, ends, closed, code = begins[word], ends[word], closed[word], code[word]
            weight = np.array(list(times.values()), np.int64)[text[word]]
            at = np.arange(len(code)) + 2 * np.cumsum(begins)  # two empty places before every sentence
            k = np.zeros(int(at[-1]) + 1, np.uint64)
            k[at] = known.key.data[code]
            stop, left = weight * closed, weight * (ends & ~closed)
            for n in (1, 2, 3):
                g, place, inv = np.unique(_grams(k, n)[at], return_index=True, return_inverse=True)
                total = [np.bincount(inv, v, len(g)).astype(np.int64) for v in (weight, stop, left)]
                names = [known.text[c] for c in code[place].tolist()] if n == 1 else [None] * len(g)
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(names, pa.string()), *map(pa.array, total)], names=["k", "word", "n", "ends", "opens"])

    parts = texts.select("text").mapInArrow(run, "k long, word string, n long, ends long, opens long")
    return parts.groupBy("k").agg(F.max("word").alias("word"), F.sum("n").alias("n"), F.sum("ends").alias("ends"), F.sum("opens").alias("opens"))


def trie_nodes(words: DataFrame, asked: DataFrame | None = None) -> DataFrame:
    """(word, below): every proper prefix of a known word, with the occurrences of the known words that extend it.

    asked (word): only prefixes as long as one of these words, so that a long string has no more prefixes than others.
    """
    known = words.where(F.col("word").isNotNull() & (F.col("n") - F.col("opens") >= KNOWN) & (F.length("word") > 1))
    sizes = F.sequence(F.lit(1), F.length("word") - 1)
    if asked is not None:
        # The different lengths of words: one small row.
        lengths = [r[0] for r in asked.select(F.length("word").alias("s")).where("s > 0").distinct().collect()]
        sizes = F.filter(F.lit(sorted(lengths)).cast("array<int>"), lambda i: i < F.length("word")) if lengths else F.array().cast("array<int>")
    prefix = F.explode(F.transform(sizes, lambda i: F.substring(F.col("word"), F.lit(1), i)))
    return known.select(prefix.alias("word"), (F.col("n") - F.col("opens")).alias("n")).groupBy("word").agg(F.sum("n").alias("below"))


def limits(ends: DataFrame) -> DataFrame:
    """(field_name, grp, kind, size): lengths, in characters or bytes, at which open texts of a source pile up."""
    kinds = F.explode(F.array(F.struct(F.lit("chars").alias("kind"), F.col("chars").alias("size")), F.struct(F.lit("bytes").alias("kind"), F.col("bytes").alias("size"))))
    each = ends.select("field_name", "grp", "k2", kinds.alias("x")).select("field_name", "grp", "x.kind", "x.size", "k2")
    by_len = each.distinct().groupBy("field_name", "grp", "kind", "size").agg(F.count("*").alias("n"))
    w = Window.partitionBy("field_name", "grp", "kind").orderBy("size")
    whole = F.sum("n").over(Window.partitionBy("field_name", "grp", "kind"))
    near = F.coalesce(F.sum("n").over(w.rangeBetween(-15, -4)), F.lit(0)) + F.coalesce(F.sum("n").over(w.rangeBetween(1, 12)), F.lit(0))
    found = by_len.withColumn("usual", near / F.lit(24.0)).withColumn("whole", whole).where((F.col("n") >= SPIKE_SHARE * F.col("whole")) & (F.col("size") >= SPIKE_CHARS) & (F.col("n") >= SPIKE_LEAST) & (F.col("n") >= SPIKE_TIMES * (F.col("usual") + 0.25)))
    # A limit in one unit shows weaker spikes in the other: the unit with the stronger one is the limit's.
    top = F.max(F.struct("n", "kind")).over(Window.partitionBy("field_name", "grp"))
    return found.withColumn("top", top).where(F.col("kind") == F.col("top.kind")).select("field_name", "grp", "kind", "size")


def judge_tails(per: DataFrame, grams: DataFrame) -> DataFrame:
    """KEYS with what the n-grams and the trie say about every distinct end of the open texts ``per``."""
    # Repetition says nothing about an end: of the rows that end alike, all but one per text are ``extra``.
    distinct = per.groupBy("same", *KEYS).agg((F.sum("n") - 1).alias("extra")).groupBy(*KEYS).agg(F.sum("extra").alias("extra"))
    distinct = cut(distinct.withColumn("extra", F.sum("extra").over(Window.partitionBy("k3"))))
    asked = distinct.select(*KEYS, "extra", F.posexplode(F.array("k1", "k2", "k3", "k32")).alias("i", "k"))
    # A last word, or a gram, may be that of a large part of the texts.
    got = join_spread(asked, grams.drop("word"), ["k"], asked.groupBy("k").agg(F.count("*").alias("times")), F.col("k3"), n="times")
    got = got.groupBy(*KEYS, "extra").pivot("i", [0, 1, 2, 3]).agg(F.max("n").alias("n"), F.max("ends").alias("e"), F.max("opens").alias("o"))
    got = join_spread(got, trie_nodes(grams, per), ["word"], distinct.groupBy("word").agg(F.count("*").alias("n")), F.col("k3"))

    def inside(i: int) -> F.Column:  # occurrences that don't end an open text, which may itself be cut
        return F.coalesce(F.col(f"{i}_n") - F.col(f"{i}_o"), F.lit(0))

    def share(i: int) -> F.Column:
        return F.when(inside(i) >= LEAST, F.col(f"{i}_e") / inside(i))

    def follows(copies: F.Column | int) -> F.Column:  # the last word mostly follows the two before it
        n, before = F.col("2_n") - copies, F.col("3_n") - copies
        return F.coalesce((n > LEAST) & (n >= 0.5 * before), F.lit(False))

    # Such words end a fixed phrase, even where no stop ever follows, if differing texts hold them. Copies of one text
    # alone make no phrase, but a unit or symbol of it is then no cut word.
    complete, settled = follows(F.col("extra")), follows(F.lit(0))
    below = F.coalesce(F.col("below"), F.lit(0))
    in_word = (F.col("word") != "") & (inside(0) < F.greatest(F.lit(float(KNOWN)), below / 1000.0)) & (below >= KNOWN) & ~complete & ~(F.col("unit") & settled)
    ended = F.when(complete & (inside(2) < LEAST), F.lit(1.0)).otherwise(F.coalesce(share(2), share(1), share(0)))
    going = F.coalesce(*[F.when(inside(i) >= LEAST, inside(i)) for i in (2, 1, 0)], F.lit(0))
    return got.select(*KEYS, ended.alias("ended"), going.alias("going"), inside(0).alias("last_n"), F.coalesce(F.col("0_e"), F.lit(0)).alias("last_e"), F.coalesce(in_word, F.lit(False)).alias("in_word"))


def at_limits(ends: DataFrame) -> DataFrame:
    """``ends`` with ``at_limit``: the text is as long as a limit of its source, in characters or bytes."""
    lim = cut(limits(ends))
    near = [("chars", 1), ("bytes", 3)]
    small = lim.count() <= BROADCAST_ROWS
    out = ends
    for kind, back in near:
        x = lim.where(F.col("kind") == kind).select(F.col("field_name").alias("r_f"), F.col("grp").alias("r_g"), F.explode(F.sequence(F.col("size") - back, F.col("size"))).alias("r_s")).distinct().withColumn(f"at_{kind}", F.lit(True))
        on = F.col("field_name").eqNullSafe(F.col("r_f")) & F.col("grp").eqNullSafe(F.col("r_g")) & (F.col(kind) == F.col("r_s"))
        out = out.join(F.broadcast(x) if small else x, on, "left").drop("r_f", "r_g", "r_s")
    return out.withColumn("at_limit", F.coalesce("at_chars", F.lit(False)) | F.coalesce("at_bytes", F.lit(False))).drop("at_chars", "at_bytes")


def find_cut(texts: DataFrame, corpus: DataFrame | None = None, shortened: DataFrame | None = None, ends: DataFrame | None = None) -> DataFrame:
    """(field_name, record_id, at_limit, in_word, in_sentence) of the texts that were cut.

    texts: (field_name, record_id, grp, text); grp is the source whose limits are looked for (null: a source of its
    own). ``corpus`` (text): further texts that only count for vocabulary and sentence ends. ``shortened`` (core):
    hashes of the ``core`` of texts known to be the beginning of another. ``ends``: the ``tails`` of texts, where they
    are at hand. Null, empty and blank texts and texts without letters or digits are never cut. Repeated rows count
    once in the result.
    """
    ends = cut(tails(texts, shortened is not None)) if ends is None else ends
    source = texts.select("text") if corpus is None else texts.select("text").unionByName(corpus.select("text"))
    grams = cut(gram_counts(source.where(F.col("text").isNotNull())))
    # One row per distinct open text of a field.
    per = cut(ends.groupBy("field_name", "same", "core", "mark", "forced", "shape", "few", *KEYS).agg(F.count("*").alias("n"), F.approx_count_distinct("record_id").alias("records")))
    judged = judge_tails(per, grams)
    short = F.lit(False)
    told = per
    if shortened is not None:
        told = told.join(shortened.select("core").distinct().withColumn("short", F.lit(True)), "core", "left")
        short = F.coalesce(F.col("short"), F.lit(False)) & ~F.col("shape")
    ways = per.groupBy(*KEYS).agg(F.count("*").alias("n"))
    told = join_spread(told, judged, KEYS, ways, F.col("same"))
    # Copies may be a whole phrase: where they are a fair part of what its last words do, and its last word ends
    # sentences if they are counted as ends, the n-grams don't speak. Other evidence holds for any number of copies.
    n = F.col("records") - 1
    phrase = F.coalesce((n > 0) & (n >= ENDS * (F.col("going") + n)) & (F.col("last_e") + n >= ENDS * (F.col("last_n") + n)), F.lit(False))
    ended = F.coalesce(F.col("ended"), F.lit(1.0))
    inside = ~F.col("shape") & (((ended < ENDS) & ~phrase) | (F.col("mark") & (F.coalesce(F.col("ended"), F.lit(0.0)) < WHOLE)) | short)
    plain = F.col("few") & ~F.col("mark")
    told = told.select("field_name", "same", F.coalesce("in_word", F.lit(False)).alias("in_word"), (~plain & (F.col("forced") | inside)).alias("in_sentence"))
    rows = at_limits(ends).select("field_name", "record_id", "same", "at_limit")
    out = join_spread(rows, told, ["field_name", "same"], per.select("field_name", "same", "n"), F.col("record_id"))
    found = out.where("at_limit or in_word or in_sentence").where("record_id is not null")
    return found.groupBy("field_name", "record_id").agg(*[F.max(c).alias(c) for c in ("at_limit", "in_word", "in_sentence")])


def answer_texts(samples: DataFrame, *fields: str) -> DataFrame:
    """Text fields of samples as (field_name, record_id, grp, text); grp is the source."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields]))
    return samples.select(F.col("sample_index").alias("record_id"), F.col("source").alias("grp"), pairs.alias("x")).select("x.field_name", "record_id", "grp", "x.text")


def reason_texts(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Reasons as (field_name, record_id, grp, text); grp is the judge of the run (null where the run is unknown)."""
    judges = runs.groupBy("run_id").agg(F.max("judge_name").alias("grp"))
    return results.select("run_id", "result_id", "reason").join(judges, "run_id", "left").select(F.lit("reason").alias("field_name"), F.col("result_id").alias("record_id"), "grp", F.col("reason").alias("text"))


def cut_rates(texts: DataFrame, found: DataFrame) -> DataFrame:
    """(field_name, grp, n_texts, n_cut, rate): share of cut texts among a source's distinct records with a text."""
    base = texts.where(F.col("text").isNotNull() & (F.col("text") != "")).groupBy("field_name", "record_id").agg(F.max("grp").alias("grp"))
    flags = found.select("field_name", "record_id", F.lit(1).alias("c"))
    j = base.join(flags, ["field_name", "record_id"], "left")
    return j.groupBy("field_name", "grp").agg(F.count("*").alias("n_texts"), F.count("c").alias("n_cut"), (F.count("c") / F.count("*")).alias("rate"))
