"""Tokens of many texts at once: one regular-expression scan per text, everything after it in arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import chain

import numpy as np


class Codes(dict):
    """Numbers of tokens, given out as they appear; ``seen`` is told of every new one."""

    def __init__(self, seen: Callable[[str], None]):
        super().__init__()
        self.seen = seen

    def __missing__(self, token: str) -> int:
        n = self[token] = len(self)
        self.seen(token)
        return n


class Column:
    """A growing array with one entry per token code."""

    def __init__(self, kind: type, width: int = 0):
        self.data = np.zeros((1024, width) if width else 1024, kind)
        self.n = 0

    def add(self, value: object) -> None:
        if self.n == len(self.data):
            self.data = np.concatenate([self.data, np.zeros_like(self.data)])
        self.data[self.n] = value
        self.n += 1


def scan(texts: Sequence[str | None], find: Callable[[str], list[str]], codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all tokens in order and, per text, the place of its first one (one entry more than texts)."""
    lists = [find(t) if t else [] for t in texts]
    first = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, lists), np.int64, len(lists)), out=first[1:])
    return np.fromiter(map(codes.__getitem__, chain.from_iterable(lists)), np.int64, int(first[-1])), first


def sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of the rows between each entry of ``first`` and the next; empty stretches give 0."""
    out = np.zeros((len(first) - 1, *values.shape[1:]), np.float64 if values.dtype.kind == "f" else np.int64)
    full = first[1:] > first[:-1]
    if full.any():
        out[full] = np.add.reduceat(values, first[:-1][full], axis=0)
    return out
