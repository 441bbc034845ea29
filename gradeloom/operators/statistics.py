"""Statistics over score frames as aggregations over distinct values and their ranks; p-values come from one row per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import pvalues as P
from gradeloom.operators.ordering import rank_correlation, ranked_rows, running_total, value_ranks
from gradeloom.session import cut


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str] = (), least: int = 3) -> DataFrame:
    """rho, n and p per group of at least ``least`` complete pairs."""
    whole = df.where(F.col(x).isNotNull() & F.col(y).isNotNull() & ~F.isnan(x) & ~F.isnan(y)).select(*by, x, y)
    got = ranked_rows(whole, by, [x, y]).groupBy(*by).agg(F.coalesce(F.sum("__m"), F.lit(0)).alias("n"), rank_correlation(f"{x}_rank", f"{y}_rank").alias("rho")).where(F.col("n") >= least)
    return got.withColumn("p_value", P.spearman_pvalue(F.col("rho"), F.col("n").cast("double")))


def spearman_matrix(df: DataFrame, columns: Sequence[str], least: int = 5) -> DataFrame:
    """rho of every pair of columns over the rows complete in all of them (at least ``least``)."""
    ranked = ranked_rows(df.select(*columns).na.drop(), [], columns)
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i:]]
    got = ranked.agg(F.coalesce(F.sum("__m"), F.lit(0)).alias("n"), *[(F.lit(1.0) if a == b else rank_correlation(f"{a}_rank", f"{b}_rank")).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    rows = F.explode(F.array(*[F.struct(F.lit(a).alias("x"), F.lit(b).alias("y"), F.col(f"{i}").alias("rho")) for i, (a, b) in enumerate(pairs)]))
    return got.where(F.col("n") >= least).select(rows.alias("r"), "n").select("r.*", "n")


def anova(df: DataFrame, group: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """One-way F, p and eta squared; at least two groups. Computed from counts, means and variances per group."""
    keys = list(by)
    g = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).groupBy(*keys, group).agg(F.count("*").alias("c"), F.avg(score).alias("m"), F.var_pop(score).alias("v"))
    t = g.groupBy(*keys).agg(
        F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("c") * F.col("v")).alias("ssw"), (F.sum(F.col("c") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("c") * F.col("m")), 2) / F.sum("c")).alias("ssb")
    )
    t = t.where("k >= 2")
    f = F.try_divide(F.col("ssb") / (F.col("k") - 1), F.nullif(F.try_divide(F.col("ssw"), F.col("n") - F.col("k")), F.lit(0.0)))
    eta = F.coalesce(F.try_divide(F.col("ssb"), F.nullif(F.col("ssb") + F.col("ssw"), F.lit(0.0))), F.lit(0.0))
    out = t.select(*keys, "k", "n", f.alias("f_stat"), eta.alias("eta_squared"))
    return out.withColumn("p_value", P.f_p(F.col("f_stat"), (F.col("k") - 1).cast("double"), (F.col("n") - F.col("k")).cast("double")))


def _ties() -> Column:
    return F.sum(F.pow(F.col("n").cast("double"), F.lit(3)) - F.col("n")).alias("ties")


def kruskal(df: DataFrame, group: str, score: str) -> DataFrame:
    """Tie-corrected H and p; null where all values are tied. Works on the counts per value and group."""
    x = df.where(F.col(group).isNotNull() & F.col(score).isNotNull()).select(group, score)
    ranks = cut(value_ranks(x, [], score))
    per = x.groupBy(group, score).agg(F.count("*").alias("__c")).join(ranks.select(score, "rank"), score)
    r = per.groupBy(group).agg(F.sum("__c").cast("double").alias("c"), F.sum(F.col("__c") * F.col("rank")).alias("s"))
    t = r.agg(F.count("*").alias("k"), F.sum("c").alias("n"), F.sum(F.col("s") * F.col("s") / F.col("c")).alias("q")).crossJoin(F.broadcast(ranks.agg(_ties())))  # one row each
    n = F.col("n")
    h = F.try_divide(12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1), F.nullif(1 - F.try_divide(F.col("ties"), n * n * n - n), F.lit(0.0)))
    out = t.where("k >= 2").select("k", n.cast("long").alias("n"), h.alias("h_stat"))
    return out.withColumn("p_value", P.chi2_p(F.col("h_stat"), (F.col("k") - 1).cast("double")))


def mannwhitney(df: DataFrame, group: str, score: str, order: Sequence[str]) -> DataFrame:
    """Two-sided U and p of all pairs of the listed groups, earlier group first; pairs with an empty group are absent.

    Works on the counts per value and group; each takes part in one comparison per other group of the caller's list.
    """
    at = {g: i for i, g in enumerate(order)}
    pairs = df.sparkSession.createDataFrame([(a, b) for a in order for b in order if at[a] < at[b]], "group_a string, group_b string")
    x = df.where(F.col(group).isin(*order) & F.col(score).isNotNull()).groupBy(F.col(group).alias("g"), F.col(score).alias("v")).agg(F.count("*").alias("c"))
    member = x.join(F.broadcast(pairs), (F.col("g") == F.col("group_a")) | (F.col("g") == F.col("group_b")))
    keys = ["group_a", "group_b"]
    mine = F.col("g") == F.col("group_a")
    per = member.groupBy(*keys, "v").agg(F.sum("c").alias("n"), F.sum(F.when(mine, F.col("c")).otherwise(0)).alias("a"))
    ranked = running_total(per, keys, ["v"], F.col("n")).withColumn("rank", F.col("__before") + (F.col("n") + 1) / 2)
    got = ranked.groupBy(*keys).agg(F.sum("a").cast("double").alias("n_a"), F.sum(F.col("n") - F.col("a")).cast("double").alias("n_b"), F.sum(F.col("a") * F.col("rank")).alias("r"), _ties())
    got = got.where("n_a > 0 and n_b > 0")
    u = F.col("r") - F.col("n_a") * (F.col("n_a") + 1) / 2
    out = got.select(*keys, F.col("n_a").cast("long").alias("n_a"), F.col("n_b").cast("long").alias("n_b"), u.alias("u_stat"), "ties")
    return out.withColumn("p_value", P.mannwhitney_pvalue(F.col("u_stat"), F.col("n_a").cast("double"), F.col("n_b").cast("double"), F.col("ties"))).drop("ties")


def ols(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def stars(p: Column) -> Column:
    return F.when(p < 0.001, "***").when(p < 0.01, "**").when(p < 0.05, "*").otherwise("n.s.")


def paired_compare(baseline: DataFrame, candidates: DataFrame) -> DataFrame:
    """Paired t-test per configuration and metric.

    baseline: (metric_name, sample_index, score[, seq]); candidates: the same with ``config``. Scores are paired by
    position in order of sample_index (ties: seq); the longer side is cut to the shorter by the join. Only metrics of
    both sides appear. No variation at all gives p = 1; a constant difference other than 0 gives p = 0.
    """

    def numbered(df: DataFrame, keys: list[str]) -> DataFrame:
        o = [c for c in ("sample_index", "seq") if c in df.columns]
        return running_total(df, keys, o, F.lit(1)).withColumn("rn", F.col("__before"))

    b = numbered(baseline, ["metric_name"]).select("metric_name", "rn", F.col("score").alias("b"))
    c = numbered(candidates, ["config", "metric_name"]).select("config", "metric_name", "rn", F.col("score").alias("c"))
    d = F.col("c") - F.col("b")
    got = c.join(b, ["metric_name", "rn"]).groupBy("config", "metric_name").agg(
        F.count("*").alias("n"), F.avg("b").alias("baseline_mean"), F.avg("c").alias("candidate_mean"), F.avg(d).alias("__d"), F.stddev_samp(d).alias("__s")
    )
    flat = (F.col("__s") <= 1e-12 * F.greatest(F.lit(1.0), F.abs("__d"))) | F.col("__s").isNull()
    t = F.when(flat, F.when(F.abs("__d") <= 1e-12, F.lit(float("nan"))).otherwise(F.signum("__d") * F.lit(float("inf")))).otherwise(F.try_divide(F.col("__d"), F.col("__s") / F.sqrt(F.col("n"))))
    got = got.withColumn("delta", F.col("candidate_mean") - F.col("baseline_mean")).withColumn("__t", t)
    got = got.withColumn("p_value", F.when(F.col("n") > 1, F.coalesce(P.t_p(F.col("__t"), (F.col("n") - 1).cast("double")), F.lit(1.0))).otherwise(1.0))
    sure = F.col("p_value") < 0.05
    return got.select(
        "config", "metric_name", "n", "baseline_mean", "candidate_mean", "delta", F.col("__t").alias("t_stat"), "p_value", (sure & (F.col("delta") > 0)).alias("significant_improvement"), (sure & (F.col("delta") < 0)).alias("significant_degradation")
    )
