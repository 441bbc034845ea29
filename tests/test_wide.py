import math
import random

from gradeloom.operators import wide

DDL = "result_id long, run_id string, metric_name string, sample_index long, score double, reason string, metadata string, scored_at timestamp, ingested_at timestamp, attribute string"


def rows(spark, data):
    from datetime import datetime

    out = []
    for i, (run, m, s, v, r, at) in enumerate(data):
        out.append((i, run, m, s, v, r, None, datetime(2024, 1, at), datetime(2024, 2, 1), "clash"))
    return spark.createDataFrame(out, DDL)


def test_latest_valid_score_wins_and_contradictions_are_flagged(spark):
    df = rows(spark, [("r", " Token-F1 ", 1, 0.5, "a", 1), ("r", "token f1", 1, 0.7, "b", 2), ("r", "token_f1", 1, None, "c", 3), ("r", "pes", 1, 2.0, "d", 1), ("r", "PES", 2, 0.1, None, 1), (None, "pes", None, float("nan"), "e", 1), ("r", None, 1, 0.3, "x", 1)])
    got = {(r["run_id"], r["sample_index"]): r for r in wide.wide_results(df).collect()}
    assert got["r", 1]["token_f1_score"] == 0.7 and got["r", 1]["token_f1_reason"] == "b"
    assert got["r", 1]["pes_score"] is None and got["r", 1]["pes_reason"] == "d"
    assert got["r", 1]["flagged"] == ["token_f1"] and got["r", 2]["flagged"] == []
    assert got[None, None]["pes_score"] is None
    assert [tuple(r) for r in wide.contradicting_cells(wide.wide_results(df)).collect()] == [("r", 1, "token_f1")]


def test_same_as_brute_force_over_many_entities_and_batches(spark):
    random.seed(1)
    data = [(f"r{random.randint(0, 3)}", random.choice(["a", "b", "c"]), random.randint(0, 40), random.choice([0.1, 0.2, None, 0.3]), random.choice(["x", None, "y" * 5000]), random.randint(1, 28)) for _ in range(1500)]
    df = rows(spark, data)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r["run_id"], r["sample_index"]): r for r in wide.wide_results(df).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for i, (run, m, s, v, r, at) in enumerate(data):
        want.setdefault((run, s), {}).setdefault(m, []).append((v is not None, at, i, v, r))
    assert set(got) == set(want)
    for k, cells in want.items():
        for m in "abc":
            last = max(cells[m])[3:] if m in cells else (None, None)
            assert (got[k][f"{m}_score"], got[k][f"{m}_reason"]) == last
        assert got[k]["flagged"] == sorted(m for m, c in cells.items() if len({x[3] for x in c if x[3] is not None}) > 1)


def test_empty_table_and_one_hot_entity(spark):
    assert wide.wide_results(spark.createDataFrame([], DDL)).count() == 0
    hot = rows(spark, [("r", "pes", 7, 0.25, "same", 1)] * 500)
    got = wide.wide_results(hot).collect()
    assert len(got) == 1 and got[0]["pes_score"] == 0.25 and got[0]["flagged"] == []
    assert not math.isnan(got[0]["pes_score"])


def test_types_are_kept(spark):
    cells = spark.createDataFrame([("e", "k", 5, True), ("e", "gone", 1, False)], "entity string, attribute string, n int, ok boolean")
    got = wide.to_wide(cells, ["entity"], ["n", "ok"], ["k", "other"])
    assert got.schema.simpleString() == "struct<entity:string,k_n:int,k_ok:boolean,other_n:int,other_ok:boolean>"
    assert tuple(got.first()) == ("e", 5, True, None, None)
