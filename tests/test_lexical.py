import math
from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gradeloom.functions import stemming
from gradeloom.functions import text as X
from gradeloom.operators import lexical

PAIR = ("The capital of France is Paris.", "The capital of France is Paris.")


def score(spark, metric, answer, truth):
    df = spark.createDataFrame([(answer, truth)], "answer string, ground_truth string")
    return df.select(metric(F.col("answer"), F.col("ground_truth")).alias("m")).first()["m"]


def test_identical_pair_scores_one(spark):
    for f in (lexical.exact_match, lexical.token_f1, lexical.bleu, lexical.rouge_n, lexical.rouge):
        assert math.isclose(score(spark, f, *PAIR)["score"], 1.0)
    assert score(spark, lexical.exact_match, "London is the capital of UK.", PAIR[1])["score"] == 0.0
    for f in (lexical.token_f1, lexical.bleu, lexical.rouge):
        assert score(spark, f, "London is the capital of UK.", PAIR[1])["score"] < 1.0


def test_missing_and_empty_texts(spark):
    for f in (lexical.exact_match, lexical.token_f1, lexical.bleu, lexical.rouge_n, lexical.rouge):
        for a, t in ((None, "x"), ("x", None), ("", ""), (None, None)):
            got = score(spark, f, a, t)
            assert got["score"] == 0.0 and got["reason"] == lexical.MISSING
    assert score(spark, lexical.token_f1, "the", "a")["reason"] == "Empty after normalization."
    assert score(spark, lexical.token_f1, "cat", "dog")["reason"] == "No common tokens."


def test_long_texts(spark):
    long = "word other thing " * 1500
    assert math.isclose(score(spark, lexical.token_f1, long, long)["score"], 1.0)
    assert math.isclose(score(spark, lexical.rouge, long, long)["score"], 1.0)


def test_token_f1_counts_repeated_tokens(spark):
    got = score(spark, lexical.token_f1, "cat cat dog", "cat dog dog")
    assert math.isclose(got["score"], 2 / 3)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(st.text("ab c.", max_size=20), st.text("ab c.", max_size=20)), min_size=1, max_size=8))
def test_multiset_overlap_matches_counters(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, a string, b string")
    a, b = X.split_words(F.col("a")), X.split_words(F.col("b"))
    got = {r["i"]: (r["n"], r["g"]) for r in df.select("i", X.multiset_overlap(a, b).alias("n"), X.multiset_overlap(X.ngrams(a, 2), X.ngrams(b, 2)).alias("g")).collect()}
    for i, (x, y) in enumerate(pairs):
        x, y = x.split(), y.split()
        bi = lambda t: Counter(zip(t, t[1:]))
        assert got[i] == (sum((Counter(x) & Counter(y)).values()), sum((bi(x) & bi(y)).values()))


def test_porter_examples():
    for word, want in {"caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "digitizer": "digit", "operator": "oper", "formative": "form", "electrical": "electr", "goodness": "good", "adjustment": "adjust", "adoption": "adopt", "probate": "probat", "controll": "control", "roll": "roll"}.items():
        assert stemming.stem(word) == want, word


def test_lcs():
    assert stemming.lcs(list("abcbdab"), list("bdcaba")) == 4
    assert stemming.lcs([], ["a"]) == 0


def test_text_functions(spark):
    df = spark.createDataFrame([("The cat sat on a mat", "Hello world. This is a test! Is it working? Mr. Smith says yes. Yes, he does.", "A" * 2000)], "a string, b string, c string")
    r = df.select(X.normalize_text(F.col("a")).alias("n"), X.chunk_sentences(F.col("b")).alias("s"), X.fixed_chunks(F.col("c")).alias("f"), X.count_tokens(F.col("a")).alias("t"), X.fixed_chunks(F.lit("")).alias("e"), X.fixed_chunks(F.lit(None)).alias("z")).first()
    assert r["n"] == "cat sat on mat" and len(r["s"]) == 5 and [len(x) for x in r["f"]] == [800, 800, 400] and r["t"] == 7 and r["e"] == r["z"] == []


def test_render_does_not_expand_values_again(spark):
    got = spark.range(1).select(X.render("Q: ${question} $x $$ $answer", question=F.lit("${answer}"), answer=F.lit("A")).alias("p")).first()["p"]
    assert got == "Q: ${answer} $x $ A"


def test_word_overlap(spark):
    f = lambda a, b: spark.range(1).select(X.word_overlap(F.lit(a), F.lit(b)).alias("x")).first()["x"]
    assert f("plants need light", "Plants need light") == 1.0 and f("a b", "c d") == 0.0 and f("", "x") == 0.0


def test_exact_token_counts(spark):
    import os

    import pytest

    path = "/opt/tokenizers/byte_bpe_50k"
    if not os.path.exists(path + ".tiktoken"):
        pytest.skip("no vocabulary")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path + ".json")
    t.encode_special_tokens = True
    texts = ["Hello world.", "", None, "  two  spaces\n\n", "It's 42 o'clock, isn't it?", "Größe été 東京 😊\ttab", "a" * 500, "<|endoftext|>"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    got = [r["n"] for r in df.select("i", X.exact_tokens(F.col("t"), path + ".tiktoken").alias("n")).orderBy("i").collect()]
    assert got == [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]


def test_overlap_without_stop_words(spark):
    df = spark.createDataFrame([("the cat and the hat", "the dog and a hat")], "s string, t string")
    got = df.select(X.word_overlap(F.col("s"), F.col("t")).alias("all"), X.word_overlap(F.col("s"), F.col("t"), ("the", "and", "a")).alias("some")).first()
    assert got["all"] == 0.8 and got["some"] == 0.5
