from pyspark.sql import functions as F

from gradeloom.llm import quota

T = "dimension string, category string, target_share double, min_rows long, sample_rows long"


def rows(spark, data):
    df = spark.createDataFrame(data, "id long, a string, b string, other int")
    return quota.usable_rows(df, "id", {"kind": F.col("a"), "level": F.col("b")})


def test_labels_and_redeliveries(spark):
    r = rows(spark, [(1, " Multi-Hop\t", "easy", 1), (1, " Multi-Hop\t", "easy", 1), (2, "multi hop", None, 1), (3, None, "EASY", 1), (None, "x", "y", 1)])
    t = spark.createDataFrame([("kind", "multi_hop", 0.5, 1, 6), ("level", "easy", 0.3, 1, 10), ("kind", "rare", 0.0, 2, 6), ("nowhere", "x", 0.1, 1, 10)], T)
    got = {(x["dimension"], x["category"]): (x["required"], x["available"], x["deficit"]) for x in quota.requirements(r, t, ["kind", "level"]).collect()}
    assert got == {("kind", "multi_hop"): (3, 2, 1), ("level", "easy"): (3, 2, 1), ("kind", "rare"): (2, 0, 2), ("nowhere", "x"): (1, 0, 1)}


def test_sample_meets_feasible_targets_exactly_and_is_stable(spark):
    data = [(i, ["x", "x", "x", "y"][i % 4], ["lo", "hi", "lo"][i % 3], 0) for i in range(6000)]
    t = spark.createDataFrame([("kind", "x", 0.5, 1, 200), ("kind", "y", 0.5, 1, 200), ("level", "lo", 0.4, 1, 200), ("level", "hi", 0.6, 1, 200)], T)
    r = rows(spark, data)
    cells = quota.plan(r, t, ["kind", "level"])
    one = quota.draw(r, cells, "id", ["kind", "level"])
    ids = sorted(x["id"] for x in one.collect())
    assert len(ids) == len(set(ids)) == 200
    rep = {(x["dimension"], x["category"]): x["sampled"] for x in quota.sample_report(quota.requirements(r, t, ["kind", "level"]), one, ["kind", "level"]).collect()}
    assert rep == {("kind", "x"): 100, ("kind", "y"): 100, ("level", "lo"): 80, ("level", "hi"): 120}
    again = quota.draw(r.repartition(7), cells, "id", ["kind", "level"])
    assert sorted(x["id"] for x in again.collect()) == ids


def test_joint_targets_are_met_where_they_can_be():
    import numpy as np

    rng = np.random.default_rng(1)
    for sizes in ((5, 4, 5), (4, 4, 30), (60, 4, 5)):
        cells = rng.integers(0, 30, int(np.prod(sizes)))
        keep = rng.random(len(cells)) < 0.4
        cells, index = cells[keep], [x[keep] for x in np.indices(sizes).reshape(3, -1)]
        some = rng.binomial(cells, 0.3)
        wanted = [np.bincount(i, some, n).astype(np.int64) for i, n in zip(index, sizes)]
        k, least = quota.allot(cells, index, wanted)
        assert least == 0 and (k >= 0).all() and (k <= cells).all()
        assert all((np.bincount(i, k, n) == w).all() for i, w, n in zip(index, wanted, sizes))
    # Five rows of each kind are wanted, but only four of the one level that all rows have.
    k, least = quota.allot(np.array([5, 5]), [np.array([0, 1]), np.array([0, 0])], [np.array([5, 5]), np.array([4])])
    assert least == 6


def test_a_cell_that_chance_leaves_short_is_topped_up(spark):
    r = rows(spark, [(i, "x", "lo", 0) for i in range(3000)])
    cells = spark.createDataFrame([("x", 100000, 2900, 0)], "kind string, observed long, wanted long, least_gap long")  # p is far too small
    assert quota.draw(r, cells, "id", ["kind"]).distinct().count() == 2900
    assert quota.draw(r, cells.withColumn("wanted", F.lit(3000)), "id", ["kind"]).distinct().count() == 3000


def test_small_categories_are_taken_whole_and_reported(spark):
    data = [(i, "rare" if i < 3 else "common", "lo", 0) for i in range(500)]
    t = spark.createDataFrame([("kind", "rare", 0.1, 10, 100), ("kind", "common", 0.9, 1, 100)], T)
    r = rows(spark, data)
    s = quota.draw(r, quota.plan(r, t, ["kind"]), "id", ["kind"])
    got = {x["category"]: (x["sampled"], x["deficit"]) for x in quota.sample_report(quota.requirements(r, t, ["kind"]), s, ["kind"]).collect()}
    assert got == {"rare": (3, 7), "common": (90, 0)}


def test_p4_found_is_read_off_drawn_samples(spark, tmp_path, monkeypatch):
    from gradeloom.llm import queries

    meta = "struct<question_type:string,difficulty:string,target_pedagogical_state:string>"
    data = [(i, (["multi hop", "Simple", "simple"][i % 3] if i < 90 else None, "hard" if i < 5 else "easy", "A")) for i in range(300)]
    spark.createDataFrame(data + data[:20], f"synth_id long, metadata {meta}").write.parquet(str(tmp_path / "synthetic_dataset.parquet"))
    t = [("question_type", "Multi-Hop", 0.5, 1, 100), ("question_type", "multi hop", 0.1, 1, 100), ("question_type", "simple", 0.5, 1, 100), ("question_type", "rare", 0.0, 1, 100), ("difficulty", "hard", 0.1, 1, 100), ("difficulty", "easy", 0.9, 1, 100), ("target_pedagogical_state", "a", 0.2, 1, 100), ("nowhere", "x", 0.1, 1, 100)]
    spark.createDataFrame(t, T).write.parquet(str(tmp_path / "sample_targets.parquet"))
    drawn, draw = [], quota.draw
    monkeypatch.setattr(quota, "draw", lambda rows, cells, key, dims, **k: drawn.append(list(dims)) or draw(rows, cells, key, dims, **k))
    got = sorted(map(tuple, queries.p4_found(spark, str(tmp_path)).collect()))
    assert got == [("difficulty", "hard"), ("nowhere", "x"), ("question_type", "Multi-Hop"), ("question_type", "rare")]
    assert drawn == [["question_type"], ["difficulty"], ["target_pedagogical_state"]]


def test_empty_tables(spark):
    r = rows(spark, [(1, "x", "y", 0)])
    t = spark.createDataFrame([("kind", "x", 1.0, 1, 5)], T)
    none = r.where("false")
    assert quota.draw(none, quota.plan(none, t, ["kind"]), "id", ["kind"]).count() == 0
    assert quota.requirements(none, t, ["kind"]).first()["deficit"] == 5
    assert quota.draw(r, quota.plan(r, t.where("false"), ["kind"]), "id", ["kind"]).count() == 0
