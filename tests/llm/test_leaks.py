import random

import numpy as np

from gradeloom.llm import leaks


def brute(docs, items, n=12):
    grams = {}
    for k, t in items:
        w = leaks.words(t or "")
        for s in range(len(w) - n + 1):
            grams.setdefault(tuple(w[s : s + n]), set()).add(k)
    out = set()
    for i, t in docs:
        w = leaks.words(t or "")
        for s in range(len(w) - n + 1):
            out |= {(i, k) for k in grams.get(tuple(w[s : s + n]), ())}
    return out


def data(seed):
    random.seed(seed)
    some = lambda n: " ".join(random.choice(["Red", "blue", "été", "42", "the", "a"]) for _ in range(n))
    items = [(k, some(random.randint(5, 40))) for k in range(25)] + [(90, None), (91, "")]
    docs = []
    for i in range(60):
        t = some(random.randint(0, 60))
        if i % 3 == 0:
            w = random.choice(items[:25])[1].split()
            s = random.randint(0, max(0, len(w) - 13))
            t += "\n- " + "; ".join(w[s : s + random.randint(9, 16)]).upper() + ". " + some(5)
        docs.append((i, t))
    return docs + [(100, None), (101, ""), (102, some(20000))], items


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, item_id string"), spark.createDataFrame([(k, t, "test") for k, t in items], "item_id long, text string, subset string")


def test_exact_runs_equal_brute_force(spark):
    for seed in (1, 2):
        docs, items = data(seed)
        got = [tuple(r) for r in leaks.exact_leaks(*frames(spark, docs, items)).collect()]
        assert set(got) == brute(docs, items) and len(got) == len(set(got)) > 0


def test_both_ways_give_the_same_rows(spark):
    docs, items = data(3)
    d, b = frames(spark, docs, items)
    show = lambda df: sorted((r["doc_id"], r["item_id"], r["score"], round(r["similarity"], 9), r["run_words"], r["stretch_words"]) for r in df.where(leaks.is_leak()).collect())
    one = show(leaks.find_leaks(d, b))
    assert one == show(leaks.find_leaks(d, b, block_bytes=500)) and len(one) > 10
    assert leaks.find_leaks(d, b.where("text is null or item_id > 50"), block_bytes=-1).count() == 0
    assert leaks.find_leaks(d.where("false"), b, block_bytes=-1).count() == 0


def planted(rate, seed, words=40, copies=60):
    """Items and documents that hold one of them with a share of its words changed, dropped or doubled."""
    random.seed(seed)
    vocab = [f"w{i}" for i in range(3000)]
    some = lambda n: [random.choice(vocab[: random.choice([50, 3000])]) for _ in range(n)]
    items = [(k, some(words)) for k in range(copies)]
    docs = []
    for k, w in items:
        out = []
        for x in w:
            r = random.random()
            out += [x] if r > rate else random.choice([[random.choice(vocab)], [], [x, random.choice(vocab)]])
        docs.append((k, " ".join(some(80) + out + some(80))))
    return docs, [(k, " ".join(w)) for k, w in items]


def test_recall_of_edited_copies(spark):
    """Against aligning every document with every item: at least 0.9 at each rate of edits (the seeds alone decide)."""
    for rate in (0.02, 0.05, 0.1):
        docs, items = planted(rate, 7)
        d, b = frames(spark, docs, items)
        ids = {}
        number = lambda t: np.array([ids.setdefault(w, len(ids)) for w in leaks.words(t)])
        true = {(i, k) for i, t in docs for k, x in items if i == k and leaks.align(number(x), number(t))[0] >= leaks.MIN_SIMILARITY * leaks.MATCH * 40}
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(d, b).where(leaks.is_leak()).collect()}
        assert len(true) >= 20 and len(got & true) >= 0.9 * len(true), (rate, len(true), len(got & true))
        assert all(i == k for i, k in got)


def test_edited_parts_and_short_items(spark):
    item = " ".join(f"word{i}" for i in range(60))
    part = " ".join("other" if i % 9 == 0 else f"word{i}" for i in range(20, 45))
    short = "seven bright lamps hang over the quay"
    d, b = frames(spark, [(1, f"before {part} after"), (2, f"Note: {short}!"), (3, "word1 word2 word3 word4 word5 word6 word7 and no more")], [(7, item), (8, short), (9, "three words only")])
    for size in (10**6, -1):
        got = {(r["doc_id"], r["item_id"]): r for r in leaks.find_leaks(d, b, block_bytes=size).where(leaks.is_leak()).collect()}
        assert set(got) == {(1, 7), (2, 8)}
        assert got[1, 7]["similarity"] < 0.5 and got[1, 7]["stretch_words"] >= 18 and got[1, 7]["run_words"] == 8


def test_edited_copies_score_high(spark):
    item = "a farmer sells eleven baskets of ripe pears and keeps seven of them for the winter while her brother carries the rest to the market"
    edited = "Note: a farmer sells eleven baskets of fresh ripe pears and keeps seven of them for winter while her brother carries the rest to the market today"
    d, b = frames(spark, [(1, edited), (2, "nothing like it"), (3, item)], [(7, item)])
    got = {r["doc_id"]: r for r in leaks.find_leaks(d, b).collect()}
    assert got[1]["run_words"] >= 8 and got[1]["similarity"] > 0.85 and got[3]["similarity"] == 1.0 and 2 not in got


def test_alignment_equals_the_textbook_recurrence():
    random.seed(4)
    for _ in range(50):
        a, b = ([random.randint(0, 3) for _ in range(random.randint(1, 12))] for _ in range(2))
        h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a, 1):
            for j, y in enumerate(b, 1):
                h[i][j] = max(0, h[i - 1][j - 1] + (2 if x == y else -1), h[i - 1][j] - 1, h[i][j - 1] - 1)
        assert leaks.align(np.array(a), np.array(b))[0] == max(map(max, h))


def test_empty_tables(spark):
    docs, items = data(1)
    d, b = frames(spark, docs, items)
    assert leaks.exact_leaks(d.where("false"), b).count() == 0 and leaks.exact_leaks(d, b.where("false")).count() == 0
