import random
from collections import defaultdict

from gradeloom.llm import spans

DDL = "doc_id long, text string, h string, w string, place string"


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y", "z") for i, t in texts], DDL)


def brute(texts, span):
    where = defaultdict(set)
    for i, t in texts:
        if i is not None and t is not None:
            for s in range(len(t) - span + 1):
                where[t[s : s + span]].add(i)
    pairs = {(a, b) for v in where.values() for a in v for b in v if a < b}
    share = {}
    for i, t in texts:
        if i is not None:
            m = bytearray(len(t or ""))
            for s in range(len(t or "") - span + 1):
                if len(where[t[s : s + span]]) > 1:
                    m[s : s + span] = b"\1" * span
            share[i] = sum(m)
    return pairs, share


def corpus(seed):
    random.seed(seed)
    word = lambda n: "".join(random.choice("abcdefg é😊") for _ in range(n))
    shared = [word(n) for n in (39, 40, 41, 70, 150)]
    texts = []
    for i in range(60):
        t = word(random.randint(0, 90))
        for _ in range(random.randint(0, 2)):
            t += random.choice(shared) + word(random.randint(0, 30))
        texts.append((i, t))
    texts += [(100, texts[3][1]), (101, texts[3][1]), (102, "x" * 300), (103, "y" + "x" * 45), (104, "ab" * 50), (105, "z" + "ba" * 40), (106, None), (107, "")]
    return texts


def test_pairs_and_shares_equal_brute_force(spark):
    for seed in (1, 2):
        texts = corpus(seed)
        pairs, share = brute(texts, 40)
        df = frame(spark, texts)
        got = [tuple(r) for r in spans.shared_pairs(df, 40).collect()]
        assert set(got) == pairs and len(got) == len(pairs)
        assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(df, 40).collect()} == share


def test_every_occurrence_inside_a_document_counts(spark):
    random.seed(7)
    word = lambda n: "".join(random.choice("abcdefgh") for _ in range(n))
    p = word(70)
    texts = [(1, p + word(60) + p), (3, word(50) + p[10:60] + word(50))]
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(frame(spark, texts), 40).collect()} == {1: 100, 3: 50}
    for i in range(10, 70):
        q, k, r = word(70), random.randint(0, 25), word(random.randint(3, 60))
        t = word(random.randint(0, 20)) + q + word(random.randint(0, 50)) + q + random.choice(["", q[5:] + word(30) + q])
        texts.append((i, t))
        texts.append((100 + i, random.choice([word(30) + q[k : k + 45] + word(30), q[k:] + q[: 45 + k], t[: len(t) // 2], word(9) + r * 30])))
        texts.append((200 + i, random.choice([word(20) + r * 9 + word(20) + r * 12, t[len(t) // 3 :], q + word(5) + q[: 50 + k % 20]])))
    random.shuffle(texts)
    pairs, share = brute(texts, 40)
    df = frame(spark, texts)
    assert {r["doc_id"]: r["shared_chars"] for r in spans.shared_share(df, 40).collect()} == share
    assert {tuple(r) for r in spans.shared_pairs(df, 40).collect()} == pairs


def test_groups_hold_every_pair_without_expanding_copies(spark):
    texts = ["Q" * 3 + "same text of many documents, again and again the same" + str(i % 2) for i in range(60)]
    texts = [(i, t) for i, t in enumerate([*texts, "no part of this one stands anywhere else at all, nowhere"])]
    g = spans.groups(frame(spark, texts), 40).collect()
    sets = {}
    for r in g:
        sets.setdefault((r["h"], r["w"]), set()).add(r["doc_id"])
    assert len(g) <= 3 * 60 and all(len(s) == r["n"] for r in g for s in [sets[r["h"], r["w"]]])
    pairs = {(a, b) for s in sets.values() for a in s for b in s if a < b}
    assert pairs == {tuple(r) for r in spans.shared_pairs(frame(spark, texts), 40).collect()} and len(pairs) == 60 * 59 // 2


def test_large_groups_are_paired_in_blocks(spark):
    old, spans.BLOCK = spans.BLOCK, 4
    try:
        texts = [(i, f"{i:03d} " * (i % 3) + "k" * 20 + "The same passage stands in every one of these." + str(i)) for i in range(15)]
        got = {tuple(r) for r in spans.shared_pairs(frame(spark, texts), 40).collect()}
    finally:
        spans.BLOCK = old
    assert got == {(a, b) for a in range(15) for b in range(15) if a < b} == brute(texts, 40)[0]


def test_long_texts_are_cut_into_overlapping_pieces():
    import numpy as np

    random.seed(5)
    t = "".join(random.choice("abcdef") for _ in range(3 << 21))
    codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
    whole = spans._long(codes, 400)
    a, b = 1 << 21, (1 << 21) + 5000
    part = spans.anchors(codes[a:b], np.array([0, b - a]), 400)
    want = {(int(p) + a, int(h)) for p, h in zip(part[1], part[4])}
    assert want <= {(int(p), int(h)) for p, h in zip(whole[1], whole[4])}
    covered = np.zeros(len(codes) - 399, np.int32)
    for lo, hi in zip(whole[2], whole[3]):
        covered[lo : hi + 1] += 1
    assert (covered == 1).all()


def test_rows_of_long_texts_are_whole_where_pieces_meet():
    import numpy as np

    random.seed(6)
    step = 1 << 21
    for t in ("".join(random.choice("abcdef") for _ in range(step + 9000)), "abcde" * ((step + 9000) // 5)):
        codes = np.frombuffer(t.encode("utf-32-le"), np.uint32)
        a, b = step - 4000, step + 4000
        t0, p, lo, hi, x, y = spans.anchors(codes[a:b], np.array([0, b - a]), 400)
        inner = (lo > 1000) & (hi < b - a - 1400)
        want = set(zip((p + a)[inner].tolist(), (lo + a)[inner].tolist(), (hi + a)[inner].tolist(), x[inner].tolist(), y[inner].tolist()))
        got = spans._long(codes, 400)
        assert want <= set(zip(*(c.tolist() for c in got[1:])))
        assert (got[2][1:] == got[3][:-1] + 1).all() and got[2][0] == 0 and got[3][-1] == len(codes) - 400


def test_nothing_to_find(spark):
    assert spans.shared_pairs(frame(spark, [])).count() == 0
    one = frame(spark, [(1, "a" * 1000), (1, "a" * 1000), (None, "a" * 1000), (2, None), (3, "short")])
    assert spans.shared_pairs(one).count() == 0
    got = {(r["doc_id"], r["shared_chars"]) for r in spans.shared_share(one).collect()}
    assert got == {(1, 0), (2, 0), (3, 0), (None, 0)}
