import base64
import random

import pytest

from gradeloom.llm import encode

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def bpe():
    with open(encode.default_vocabulary(), "rb") as f:
        return encode.Bpe(encode.read_ranks(f.read()))


def naive(bpe, text):
    """Merges in rank order, one at a time."""
    out = []
    for p in bpe.find(text):
        seq = [bytes([b]) for b in p.encode()]
        while True:
            best = min(((bpe.ranks[a + b], i) for i, (a, b) in enumerate(zip(seq, seq[1:])) if a + b in bpe.ranks), default=None)
            if best is None:
                break
            i = best[1]
            seq[i : i + 2] = [seq[i] + seq[i + 1]]
        out += [bpe.ranks[s] for s in seq]
    return out


def test_same_ids_as_merging_in_rank_order(bpe):
    random.seed(3)
    alphabet = "ab  \n\t \xa0'stéß中文😊1²Ⅷ\x1c\x85　​_-.,"
    for k in range(3000):
        n = random.randint(0, 14)
        s = "".join(random.choice(alphabet if k % 2 else "thenoigrsa ") for _ in range(n))
        assert bpe.encode(s) == naive(bpe, s), s


def test_same_ids_as_the_library(bpe):
    tiktoken = pytest.importorskip("tiktoken")
    ref = tiktoken.Encoding("own", pat_str=encode.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for s in ("<|endoftext|> is text", "a" * 20000, " " * 3000 + "x", "Ünïcödé — “quotes” 12345 \r\n\r\n end ", "def f(x):\n    return x**2  # $\\frac{1}{2}$"):
        assert bpe.encode(s) == ref.encode_ordinary(s)
        assert b"".join(bpe.tokens[i] for i in bpe.encode(s)).decode() == s


def test_small_vocabulary_and_edge_rows(spark, tmp_path):
    path = tmp_path / "v.tiktoken"
    ranks = [bytes([i]) for i in range(256)] + [b"ab", b"abc", b"bc"]
    path.write_bytes(b"\n".join(base64.b64encode(t) + b" " + str(i).encode() for i, t in enumerate(ranks)))
    df = spark.createDataFrame([(1, "abc bc", "clash"), (2, "", "x"), (3, None, "x"), (None, "ab", "x"), (1, "abc bc", "clash")], "doc_id long, text string, ids string")
    got = sorted(map(tuple, encode.encode_column(df, "doc_id", "text", str(path)).collect()), key=str)
    assert got == sorted([(1, [257, 32, 258]), (1, [257, 32, 258]), (2, []), (3, []), (None, [256])], key=str)
    assert encode.encode_column(df.where("false"), "doc_id", "text", str(path)).count() == 0
