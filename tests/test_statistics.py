import math
import random

from pyspark.sql import functions as F

from gradeloom.functions import pvalues as P
from gradeloom.operators import results as R
from gradeloom.operators import statistics as S


def test_critical_values():
    for t, df in ((2.776, 4), (2.228, 10)):
        assert abs(P.t_two_sided(t, df) - 0.05) < 2e-4
    for f, a, b in ((4.103, 2, 10), (3.098, 3, 20)):
        assert abs(P.f_upper(f, a, b) - 0.05) < 2e-4
    for x, df in ((5.991, 2), (7.815, 3)):
        assert abs(P.chi2_upper(x, df) - 0.05) < 2e-4
    assert P.t_two_sided(float("nan"), 4) == 1.0 and P.t_two_sided(float("inf"), 4) == 0.0
    assert P.mannwhitney_p(0, 3, 3, 0) == 0.1 and P.spearman_p(1.0, 10) == 0.0


def test_spearman_with_ties_nulls_and_constants(spark):
    random.seed(2)
    rows = [("g", float(random.randint(0, 5)), float(random.randint(0, 5))) for _ in range(60)] + [("c", 1.0, float(i)) for i in range(5)] + [("s", 1.0, 1.0)] + [("g", None, 1.0), ("g", float("nan"), 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    got = {r["k"]: r for r in S.spearman(df, "x", "y", ["k"]).collect()}

    def ranks(v):
        return [sum(w < x for w in v) + (sum(w == x for w in v) + 1) / 2 for x in v]

    x, y = ranks([r[1] for r in rows[:60]]), ranks([r[2] for r in rows[:60]])
    mx, my = sum(x) / 60, sum(y) / 60
    rho = sum((a - mx) * (b - my) for a, b in zip(x, y)) / math.sqrt(sum((a - mx) ** 2 for a in x) * sum((b - my) ** 2 for b in y))
    assert abs(got["g"]["rho"] - rho) < 1e-12 and got["g"]["n"] == 60
    assert got["c"]["rho"] is None and got["c"]["p_value"] is None and "s" not in got


def test_group_tests(spark):
    df = spark.createDataFrame([(g, float(v)) for g, vs in {"a": [1, 2, 3], "b": [4, 5, 6], "c": [7, 8, 9]}.items() for v in vs] + [(None, 1.0), ("a", None)], "g string, v double")
    a = S.anova(df, "g", "v").first()
    assert math.isclose(a["f_stat"], 27.0) and math.isclose(a["eta_squared"], 0.9) and abs(a["p_value"] - 0.001) < 1e-4
    k = S.kruskal(df, "g", "v").first()
    assert math.isclose(k["h_stat"], 7.2)
    u = {(r["group_a"], r["group_b"]): r for r in S.mannwhitney(df, "g", "v", ["a", "b", "c", "none"]).collect()}
    assert set(u) == {("a", "b"), ("a", "c"), ("b", "c")} and u["a", "b"]["u_stat"] == 0.0 and math.isclose(u["a", "b"]["p_value"], 0.1)
    tied = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0)], "g string, v double")
    assert S.kruskal(tied, "g", "v").first()["h_stat"] is None and S.anova(tied, "g", "v").first()["eta_squared"] == 0.0
    assert S.anova(df.where("false"), "g", "v").count() == 0


def test_paired_compare(spark):
    base = spark.createDataFrame([("m", 0, i, 0.5) for i in range(5)] + [("only", 0, 0, 0.1)], "metric_name string, sample_index long, seq int, score double")
    cand = base.where("metric_name = 'm'").withColumn("score", F.lit(0.9)).withColumn("config", F.lit("up")).unionByName(base.where("metric_name = 'm'").withColumn("config", F.lit("same")))
    got = {r["config"]: r for r in S.paired_compare(base, cand).collect()}
    assert abs(got["up"]["delta"] - 0.4) < 1e-12 and got["up"]["significant_improvement"] and got["up"]["p_value"] == 0.0
    assert got["same"]["delta"] == 0.0 and got["same"]["p_value"] == 1.0 and not got["same"]["significant_improvement"]
    assert len(got) == 2


def test_results_algebra(spark):
    r = spark.createDataFrame([("r", i, "m", s, "why") for i, s in enumerate([0.0, 0.05, 0.5, 1.0])], "run_id string, sample_index long, metric_name string, score double, reason string")
    h = {x["bin"]: x["n"] for x in R.histogram(r).collect()}
    assert h == {0: 2, 1: 0, 2: 0, 3: 0, 4: 0, 5: 1, 6: 0, 7: 0, 8: 0, 9: 1}
    assert R.sparkline(R.histogram(r)).first()["sparkline"] == "█▁▁▁▁▄▁▁▁▄"
    e = R.extremes(r).first()
    assert (e["best_sample_index"], e["worst_sample_index"]) == (3, 0)
    s = R.summary(r.where("sample_index = 2")).first()
    assert s["stdev"] == 0.0 and s["n"] == 1
    up = R.upsert(r.select("sample_index", "score"), spark.createDataFrame([(3, 0.2), (9, 0.9)], "sample_index long, score double"), ["sample_index"])
    assert {x["sample_index"]: x["score"] for x in up.collect()} == {0: 0.0, 1: 0.05, 2: 0.5, 3: 0.2, 9: 0.9}
    assert R.next_index(r).first()[0] == 4 and R.next_index(r.where("false")).first()[0] == 0
    assert R.mean_scores(r.where("false")).count() == 0


def test_canonical_results_survive_permutation_and_redelivery(spark):
    rows = [(1, "r", "A b", 1, 0.5, "x", None, "2024-01-01 00:00:00"), (1, "r", "A b", 1, 0.5, "x", None, "2024-01-01 00:00:00"), (2, "r", "a-b", 1, 1.5, "y", None, "2024-01-02 00:00:00"), (3, None, None, None, None, None, None, None)]
    ddl = "result_id long, run_id string, metric_name string, sample_index long, score double, reason string, metadata string, at string"
    one = R.canonical_results(spark.createDataFrame(rows, ddl).withColumn("scored_at", F.to_timestamp("at"))).collect()
    two = R.canonical_results(spark.createDataFrame(rows[::-1], ddl).withColumn("scored_at", F.to_timestamp("at")).repartition(8)).collect()
    assert one == two and len(one) == 1 and one[0]["score"] == 0.5


def test_exact_u_of_any_size():
    from itertools import combinations

    from gradeloom.functions.pvalues import mannwhitney_p

    for n1, n2 in ((3, 4), (2, 6)):
        us = [sum(a - i for i, a in enumerate(c)) for c in combinations(range(n1 + n2), n1)]
        for u in range(n1 * n2 + 1):
            hi = max(u, n1 * n2 - u)
            assert abs(mannwhitney_p(u, n1, n2, 0) - min(1.0, 2 * sum(x >= hi for x in us) / len(us))) < 1e-12
    assert abs(mannwhitney_p(100, 8, 61, 0) - mannwhitney_p(8 * 61 - 100, 61, 8, 0)) < 1e-15
    # Exact and approximate values come near each other as the groups grow; ties use the approximation.
    assert abs(mannwhitney_p(700, 8, 250, 0) - mannwhitney_p(700, 8, 250, 1e-9)) < 0.01


def test_medians_and_slices_over_many_partitions(spark):
    import random
    import statistics

    from gradeloom.operators import ordering, study
    from gradeloom.operators import results as R

    random.seed(3)
    rows = [(f"m{i % 3}", i, random.choice([0.0, 0.5, round(random.random(), 3)])) for i in range(2000)]
    df = spark.createDataFrame(rows, "metric_name string, sample_index long, score double").repartition(7)
    for r in R.summary(df).collect():
        assert r["median"] == statistics.median(x[2] for x in rows if x[0] == r["metric_name"])
    q = ordering.quantiles(df.where("score is not null"), [], "score", [0.0, 0.25, 1.0]).first()["q"]
    s = sorted(x[2] for x in rows)
    assert q[0] == s[0] and q[2] == s[-1] and abs(q[1] - (s[499] + 0.75 * (s[500] - s[499]))) < 1e-12
    got = sorted(r["sample_index"] for r in study.sample_slice(df, 1990).collect())
    assert got == list(range(1990, 2000)) and study.sample_slice(df, 10, 5).count() == 5
