"""Byte-level BPE encoding of a text column with a public vocabulary (problem 7).

The vocabulary is a rank file (base64 token, rank per line). Bytes are mapped to Latin-1 characters so that an
Aho-Corasick automaton over all tokens gives the matches of a piece; encoding walks the piece left to right with the
longest match first and backtracks where two neighbours could not have been left side by side by the merges. Whether a
pair of tokens may stand side by side is decided once per pair and memoised. The ids equal those of applying the
merges in rank order, in time linear in the piece.

Texts are first split at spaces that precede a non-space: the pre-tokenisation pattern always breaks there, so each
chunk can be encoded by itself, and a bounded cache of chunks makes repeated words a dictionary lookup.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: The GPT-2 pre-tokenisation pattern (fixed value; it belongs to the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Chunks kept per Python worker, and the longest chunk (characters) that is kept.
CACHE_ENTRIES = 300_000
CACHE_CHARS = 48


class Bpe:
    """Encoder over a rank table ``{token bytes: rank}`` whose ids are the ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        import ahocorasick
        import regex

        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.find = regex.compile(pattern).findall
        self.auto = ahocorasick.Automaton()
        for b, i in ranks.items():
            self.auto.add_word(b.decode("latin-1"), (len(b), i))
        self.auto.make_automaton()
        #: For each token, the pair that merges into it last (None: a single byte, or not reachable by merges).
        self.parts: dict[int, tuple[int, int] | None] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cache: dict[str, list[int]] = {}

    def split(self, token: int) -> tuple[int, int] | None:
        """The two tokens that the last merge of ``token`` joins."""
        if token not in self.parts:
            self.parts[token] = self._merge(self.tokens[token], self.ranks[self.tokens[token]])
        return self.parts[token]

    def _merge(self, piece: bytes, below: int) -> tuple[int, int] | None:
        """Apply all merges of rank less than ``below``; the pair that remains, if it is one."""
        seq = [piece[i : i + 1] for i in range(len(piece))]
        while len(seq) > 1:
            best, at = below, -1
            for i in range(len(seq) - 1):
                r = self.ranks.get(seq[i] + seq[i + 1], below)
                if r < best:
                    best, at = r, i
            if at < 0:
                break
            seq[at : at + 2] = [seq[at] + seq[at + 1]]
        return (self.ranks[seq[0]], self.ranks[seq[1]]) if len(seq) == 2 else None

    def fits(self, left: int, right: int) -> bool:
        """True if merging the bytes of both tokens together leaves exactly these two tokens."""
        key = (left, right)
        known = self.pairs.get(key)
        if known is None:
            known = self.pairs[key] = self._fits(left, right)
            if len(self.pairs) > 2_000_000:
                self.pairs.clear()
        return known

    def _fits(self, left: int, right: int) -> bool:
        # Unfold both tokens along their touching edge, the one made by the later merge first; a merge across the
        # border that ranks before the merge that hides it would have happened.
        limit = 1 << 62
        while True:
            joined = self.ranks.get(self.tokens[left] + self.tokens[right])
            if joined is not None and joined < limit:
                return False
            if left > right:
                limit, part = left, self.split(left)
                if part is None:
                    limit, part = right + 1, self.split(right)
                    if part is None:
                        return True
                    right = part[0]
                else:
                    left = part[1]
            else:
                limit, part = right + 1, self.split(right)
                if part is None:
                    limit, part = left, self.split(left)
                    if part is None:
                        return True
                    left = part[1]
                else:
                    right = part[0]

    def piece(self, b: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(b)
        if whole is not None:
            return [whole]
        starts: list[list[tuple[int, int]]] = [[] for _ in b]
        for end, (n, i) in self.auto.iter(b.decode("latin-1")):
            starts[end - n + 1].append((n, i))
        for m in starts:
            m.sort(reverse=True)
        out: list[tuple[int, int, int]] = []  # (start, candidate number, id)
        dead = bytearray(len(b) + 1)
        at, k = 0, 0
        while at < len(b):
            for k in range(k, len(starts[at])):
                n, i = starts[at][k]
                if not dead[at + n] and (not out or self.fits(out[-1][2], i)):
                    out.append((at, k, i))
                    at, k = at + n, 0
                    break
            else:
                dead[at] = 1
                at, k, _ = out.pop()
                k += 1
        return [i for _, _, i in out]

    def chunk(self, s: str) -> list[int]:
        ids = [i for p in self.find(s) for i in self.piece(p.encode("utf-8"))]
        if len(s) <= CACHE_CHARS:
            if len(self.cache) >= CACHE_ENTRIES:
                self.cache.clear()
            self.cache[s] = ids
        return ids

    _border = re.compile(r" (?=\S)").split

    def encode(self, text: str) -> list[int]:
        parts = self._border(text)
        get, slow = self.cache.get, self.chunk
        head = parts[0]
        out = [get(head) or slow(head)] if head else []
        for p in parts[1:]:
            p = " " + p
            out.append(get(p) or slow(p))
        return list(chain.from_iterable(out))


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line.strip())}


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


_LOADED: dict[str, Bpe] = {}


def _encoder(data: bytes, pattern: str) -> Bpe:
    key = hashlib.sha256(data + pattern.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED[key] = Bpe(read_ranks(data), pattern)
    return _LOADED[key]


def encode_column(df: DataFrame, id_col: str, text_col: str, vocabulary: str | None = None, pattern: str = PATTERN) -> DataFrame:
    """(id_col, ids array<int>) for every row, without special tokens.

    Null and empty texts get an empty list; blank texts are encoded as they stand. The vocabulary file (a fixed size
    of about 1 MB) is read on the driver and shipped to the workers, so that executors need no copy of it. Rows are
    independent: no shuffle, no state beyond the bounded caches. Repeated ids give repeated rows.
    """
    with open(vocabulary or default_vocabulary(), "rb") as f:
        data = df.sparkSession.sparkContext.broadcast(f.read())
    id_field = df.schema[id_col]
    schema = T.StructType([T.StructField(id_col, id_field.dataType, True), T.StructField("ids", T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(data.value, pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            lists = [enc.encode(t) if t else [] for t in texts]
            sizes = np.fromiter(map(len, lists), np.int64, len(lists))
            offsets = np.zeros(len(lists) + 1, np.int32)
            np.cumsum(sizes, out=offsets[1:])
            values = np.fromiter(chain.from_iterable(lists), np.int32, int(offsets[-1]))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=[id_col, "ids"])

    return df.select(id_col, text_col).mapInArrow(run, schema)
