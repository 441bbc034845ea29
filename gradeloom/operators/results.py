"""The algebra of the long results table (run_id, sample_index, metric_name, score, reason, metadata, ...)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.ordering import quantiles
from gradeloom.operators.wide import normal_name, valid_score


def canonical_results(df: DataFrame) -> DataFrame:
    """One row per run, sample and metric: the latest valid score. Rows without any valid score are dropped."""
    v = valid_score(F.col("score"))
    order = F.struct(v.isNotNull(), F.col("scored_at"), F.col("result_id"))
    row = F.struct(v.alias("score"), "reason", "metadata", "scored_at", "result_id")
    x = df.where(F.col("metric_name").isNotNull()).withColumn("metric_name", normal_name(F.col("metric_name")))
    got = x.groupBy("run_id", "sample_index", "metric_name").agg(F.max_by(row, order).alias("r"))
    return got.select("run_id", "sample_index", "metric_name", "r.*").where(F.col("score").isNotNull())


def mean_scores(results: DataFrame, by: Sequence[str] = ("metric_name",)) -> DataFrame:
    return results.groupBy(*by).agg(F.avg("score").alias("mean_score"))


def summary(results: DataFrame, by: Sequence[str] = ("metric_name",)) -> DataFrame:
    """Mean, median, sample standard deviation (0 for one row), extremes and count. No task holds a group's values."""
    got = results.groupBy(*by).agg(
        F.count("*").alias("n"),
        F.avg("score").alias("mean"),
        F.coalesce(F.nullif(F.stddev_samp("score"), F.lit(float("nan"))), F.lit(0.0)).alias("stdev"),
        F.min("score").alias("min"),
        F.max("score").alias("max"),
    )
    return with_quantiles(got, results, list(by), "score", {"median": 0.5}).select(*by, "n", "mean", "median", "stdev", "min", "max")


def with_quantiles(stats: DataFrame, rows: DataFrame, by: Sequence[str], column: str, names: dict[str, float]) -> DataFrame:
    """``stats`` (one row per group) with exact quantiles of the rows' column; null where a group has no value."""
    q = quantiles(rows, by, column, list(names.values())).select(*[F.col(c).alias(f"__q_{c}") for c in by], "q")
    on = F.lit(True)
    for c in by:
        on = on & F.col(c).eqNullSafe(F.col(f"__q_{c}"))
    out = stats.join(q, on, "left")
    return out.select(*stats.columns, *[F.col("q")[i].alias(n) for i, n in enumerate(names)])


def histogram(results: DataFrame, by: Sequence[str] = ("metric_name",), bins: int = 10) -> DataFrame:
    """Counts of all bins, empty ones included; the top score belongs to the last bin."""
    b = F.least(F.floor(F.col("score") * bins).cast("int"), F.lit(bins - 1))
    got = results.groupBy(*by, b.alias("bin")).agg(F.count("*").alias("n"))
    grid = results.select(*by).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(got, [*by, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


# The eight heights of a sparkline.
TICKS = "▁▂▃▄▅▆▇█"


def sparkline(hist: DataFrame, by: Sequence[str] = ("metric_name",)) -> DataFrame:
    """One character per bin, scaled to the fullest bin."""
    top = F.max("n").over(Window.partitionBy(*by))
    level = F.when(top > 0, F.floor(F.col("n") / top * 7).cast("int")).otherwise(0)
    bars = hist.select(*by, "bin", F.substring(F.lit(TICKS), level + 1, F.lit(1)).alias("tick"))
    return bars.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bin", "tick"))), lambda x: x["tick"]), "").alias("sparkline"))


def extremes(results: DataFrame, by: Sequence[str] = ("metric_name",), order: Sequence[str] = ("sample_index", "run_id")) -> DataFrame:
    """Best and worst row per group; the first by ``order`` wins ties."""
    # The greatest score with the least order is the least of (-score, order).
    best = F.min(F.when(F.col("score").isNotNull(), F.struct((-F.col("score")).alias("down"), "score", *order))).alias("best")
    worst = F.min(F.when(F.col("score").isNotNull(), F.struct("score", *order))).alias("worst")
    j = results.groupBy(*by).agg(best, worst)
    return j.select(*by, F.col("best.score").alias("best_score"), *[F.col(f"best.{c}").alias(f"best_{c}") for c in order], F.col("worst.score").alias("worst_score"), *[F.col(f"worst.{c}").alias(f"worst_{c}") for c in order])


def per_sample_mean(results: DataFrame) -> DataFrame:
    return results.groupBy("run_id", "sample_index").agg(F.avg("score").alias("mean_score"), F.count("*").alias("n_metrics"))


def comparative(results: DataFrame, configs: Sequence[str]) -> DataFrame:
    """Mean per metric, one column per configuration (0 where absent), and the spread between them."""
    cols = [F.coalesce(F.round(F.avg(F.when(F.col("run_id") == c, F.col("score"))), 4), F.lit(0.0)).alias(c) for c in configs]
    got = results.where(F.col("run_id").isin(*configs)).groupBy("metric_name").agg(*cols)
    if len(configs) < 2:
        return got.withColumn("delta", F.lit(0.0))
    named = [F.col(f"`{c}`") for c in configs]
    return got.withColumn("delta", F.round(F.greatest(*named) - F.least(*named), 4))


def group_stats(df: DataFrame, label: str, score: str, order: Sequence[str]) -> DataFrame:
    """Statistics per label in a fixed label order; labels without rows stay as rows of nulls."""
    labels = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(order)], f"position int, {label} string")
    got = df.groupBy(label).agg(
        F.count(score).alias("count"), *[F.round(f(score), 4).alias(n) for n, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    )
    got = with_quantiles(got, df, [label], score, {"median": 0.5}).withColumn("median", F.round("median", 4)).select(label, "count", "mean", "median", "std", "min", "max")
    return F.broadcast(labels).join(got, label, "left").orderBy("position")  # as many rows as the caller listed


def two_key_mean(df: DataFrame, row: str, column: str, score: str, order: Sequence[str]) -> DataFrame:
    return df.groupBy(row).pivot(column, list(order)).agg(F.avg(score)).na.fill(0.0, list(order))


def upsert(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """Union in which rows of ``new`` replace rows of ``old`` with the same key, whatever their number of deliveries."""
    tagged = old.withColumn("__batch", F.lit(0)).unionByName(new.withColumn("__batch", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in tagged.columns if c not in (*key, "__batch")]
    got = tagged.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col("__batch")).alias("__r"))
    return got.select(*key, *[F.col(f"__r.{c}").alias(c) for c in rest])


def merge_raw(old: DataFrame, new: DataFrame, key: str = "sample_index") -> DataFrame:
    """Old rows whose key is not evaluated again, and the new rows."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def next_index(results: DataFrame) -> DataFrame:
    return results.agg(F.coalesce(F.max("sample_index") + 1, F.lit(0)).alias("next_index"))


def remaining(samples: DataFrame, results: DataFrame) -> DataFrame:
    """Samples without any result: fills holes where an offset would skip them."""
    return samples.join(results.select("sample_index").distinct(), "sample_index", "left_anti")


def batch_number(size: int, start: int = 0) -> Column:
    return F.floor((F.col("sample_index") + start) / size).cast("long")


def unpivot(scored: DataFrame, metrics: Sequence[str], keys: Sequence[str] = ("sample_index",)) -> DataFrame:
    """Struct columns (score, reason, ...) to the long results table; null structs (dropped rows) leave no row."""
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric_name"), F.col(f"`{m}`.score").alias("score"), F.col(f"`{m}`.reason").alias("reason")) for m in metrics]))
    return scored.select(*keys, rows.alias("r")).select(*keys, "r.*").where(F.col("score").isNotNull())


def metadata_costs(results: DataFrame) -> DataFrame:
    """Totals of the judges' usage kept in metadata; absent values count 0."""
    get = lambda k, t: F.coalesce(F.try_variant_get(F.try_parse_json("metadata"), f"$.{k}", t), F.lit(0).cast(t))
    return results.agg(
        F.coalesce(F.sum(get("prompt_tokens", "bigint")), F.lit(0)).alias("total_input_tokens"),
        F.coalesce(F.sum(get("completion_tokens", "bigint")), F.lit(0)).alias("total_output_tokens"),
        F.round(F.coalesce(F.sum(get("estimated_cost", "double")), F.lit(0.0)), 6).alias("total_cost"),
    )
