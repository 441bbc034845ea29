"""Porter's stemmer (from the 1980 paper) and stemmed ROUGE scores, for use in Arrow batches."""

from __future__ import annotations

import re
from collections import Counter

_token = re.compile(r"[a-z0-9]+").findall
_cache: dict[str, str] = {}


def _measure(stem: str) -> int:
    """Number of vowel-consonant sequences."""
    kinds = "".join("v" if _vowel(stem, i) else "c" for i in range(len(stem)))
    return len(re.findall(r"v+c+", kinds))


def _vowel(w: str, i: int) -> bool:
    return w[i] in "aeiou" or (w[i] == "y" and i > 0 and not _vowel(w, i - 1))


def _has_vowel(w: str) -> bool:
    return any(_vowel(w, i) for i in range(len(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and not _vowel(w, len(w) - 1)


def _cvc(w: str) -> bool:
    n = len(w)
    return n > 2 and not _vowel(w, n - 1) and _vowel(w, n - 2) and not _vowel(w, n - 3) and w[-1] not in "wxy"


# The suffix rules of steps 2 to 4.
_STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"),
    ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
    ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
    ("iviti", "ive"), ("biliti", "ble"),
)
_STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
_STEP4 = (
    "al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti",
    "ous", "ive", "ize",
)


def stem(word: str) -> str:
    known = _cache.get(word)
    if known is None:
        if len(_cache) > 200_000:
            _cache.clear()
        known = _cache[word] = _stem(word)
    return known


def _stem(w: str) -> str:
    if len(w) <= 2:
        return w
    for end, to in (("sses", "ss"), ("ies", "i"), ("ss", "ss"), ("s", "")):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + to
            break
    again = False
    if w.endswith("eed"):
        if _measure(w[:-3]) > 0:
            w = w[:-1]
    elif w.endswith("ed") and _has_vowel(w[:-2]):
        w, again = w[:-2], True
    elif w.endswith("ing") and _has_vowel(w[:-3]):
        w, again = w[:-3], True
    if again:
        if w.endswith(("at", "bl", "iz")):
            w += "e"
        elif _double(w) and w[-1] not in "lsz":
            w = w[:-1]
        elif _measure(w) == 1 and _cvc(w):
            w += "e"
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    for rules in (_STEP2, _STEP3):
        for end, to in sorted(rules, key=lambda r: -len(r[0])):
            if w.endswith(end):
                if _measure(w[: len(w) - len(end)]) > 0:
                    w = w[: len(w) - len(end)] + to
                break
    for end in sorted(_STEP4, key=len, reverse=True):
        if w.endswith(end):
            head = w[: len(w) - len(end)]
            if _measure(head) > 1 and (end != "ion" or head.endswith(("s", "t"))):
                w = head
            break
    if w.endswith("e"):
        m = _measure(w[:-1])
        if m > 1 or (m == 1 and not _cvc(w[:-1])):
            w = w[:-1]
    if w.endswith("ll") and _measure(w) > 1:
        w = w[:-1]
    return w


def rouge_tokens(text: str) -> list[str]:
    return [stem(t) if len(t) > 3 else t for t in _token(text.lower())]


def _prf(hit: int, n: int, m: int) -> tuple[float, float, float]:
    p, r = hit / n if n else 0.0, hit / m if m else 0.0
    return p, r, 2 * p * r / (p + r) if p + r else 0.0


def lcs(a: list[str], b: list[str]) -> int:
    """Length of the longest common subsequence, bit-parallel over the shorter list."""
    if len(a) < len(b):
        a, b = b, a
    where: dict[str, int] = {}
    for i, x in enumerate(b):
        where[x] = where.get(x, 0) | (1 << i)
    full = (1 << len(b)) - 1
    row = full
    for x in a:
        y = row & where.get(x, 0)
        row = ((row + y) | (row - y)) & full
    return len(b) - row.bit_count()


def rouge_scores(answer: str, truth: str) -> dict[str, tuple[float, float, float]]:
    a, t = rouge_tokens(answer), rouge_tokens(truth)
    out = {}
    for n in (1, 2):
        ga, gt = Counter(zip(*(a[i:] for i in range(n)))), Counter(zip(*(t[i:] for i in range(n))))
        out[f"rouge{n}"] = _prf(sum((ga & gt).values()), sum(ga.values()), sum(gt.values()))
    out["rougeL"] = _prf(lcs(a, t), len(a), len(t))
    return out
