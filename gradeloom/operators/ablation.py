"""Re-scoring of a score frame under a grid of weights.

The grid is a few hundred rows made here; every row of the frame meets each of them once, in one pass. Rank
correlations work on distinct values per grid point, and no task holds all values of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import pvalues as P
from gradeloom.functions import scoring as K
from gradeloom.operators.ordering import rank_correlation, running_total, value_ranks
from gradeloom.operators.skew import join_spread
from gradeloom.session import cut

# The named configurations (uptake, language, disclosure).
NAMED = {
    "Default (State C)": (0.15, 0.25, 0.60), "Default (State A)": (0.40, 0.40, 0.20), "Default (State B)": (0.20, 0.30, 0.50),
    "Equal weights": (0.33, 0.33, 0.34), "M3-only": (0.00, 0.00, 1.00), "M1-only": (1.00, 0.00, 0.00), "M2-only": (0.00, 1.00, 0.00),
    "No-M1": (0.00, 0.30, 0.70), "M3-heavy": (0.05, 0.15, 0.80), "M2+M3 balanced": (0.00, 0.50, 0.50), "M3-dominant": (0.10, 0.10, 0.80),
    "Pedagogical-focused": (0.05, 0.20, 0.75),
}


def weight_grid(spark: SparkSession, parts: int = 20) -> DataFrame:
    """(w1, w2, w3): all weights that are whole multiples of 1 / ``parts`` and sum to 1."""
    axis = F.sequence(F.lit(0), F.lit(parts))
    lattice = spark.range(1).select(F.explode(axis).alias("i")).select("i", F.explode(axis).alias("j")).where(F.col("i") + F.col("j") <= parts)
    weight = lambda k: F.round(k / F.lit(float(parts)), 4)
    return lattice.select(weight(F.col("i")).alias("w1"), weight(F.col("j")).alias("w2"), weight(F.lit(parts) - F.col("i") - F.col("j")).alias("w3"))


def named_grid(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, *v) for k, v in NAMED.items()], "config string, w1 double, w2 double, w3 double")


def rescored(m: tuple[Column, Column, Column], w: tuple[Column, Column, Column], gate_failed: Column) -> Column:
    """Missing parts count 0.5; a failed gate scores 0; values above 1 stay as they are."""
    half = lambda c: F.when(c.isNull() | F.isnan(c), 0.5).otherwise(c)
    return F.when(F.coalesce(gate_failed, F.lit(False)), 0.0).otherwise(K.geometric_mean(tuple(map(half, m)), w, upper=False))


def ablate(frame: DataFrame, grid: DataFrame, truth: str, m: tuple[str, str, str] = ("m1", "m2", "m3"), gate: str = "gate_failed") -> DataFrame:
    """Per grid row: mean re-scored value, rho against ``truth`` and p. Rows without a truth are left out."""
    keys = grid.columns
    valid = frame.where(F.col(truth).isNotNull() & ~F.isnan(F.col(truth).cast("double")))
    # The truth is the same at every point of the grid: ranked once, equal rows together.
    rows = cut(valid.groupBy(*[F.col(c) for c in m], F.col(gate).alias("__gate"), F.col(truth).cast("double").alias("truth")).agg(F.count("*").alias("__k")))
    ranks = value_ranks(valid.select(F.col(truth).cast("double").alias("truth")), [], "truth").select("truth", F.col("rank").alias("truth_rank"))
    known = join_spread(rows, ranks, ["truth"], rows.groupBy("truth").agg(F.count("*").alias("n")), F.struct(*m), "inner")
    x = known.crossJoin(F.broadcast(grid))  # a few hundred rows of our own making
    x = x.select(*keys, F.round(rescored(tuple(F.col(c) for c in m), (F.col("w1"), F.col("w2"), F.col("w3")), F.col("__gate")), 12).alias("pes"), "truth_rank", "__k")
    x = cut(x.groupBy(*keys, "pes", "truth_rank").agg(F.sum("__k").alias("__m")))
    per = x.groupBy(*keys, "pes").agg(F.sum("__m").alias("n"), F.count("*").alias("__rows"))
    scored = running_total(per, keys, ["pes"], F.col("n")).select(*keys, "pes", (F.col("__before") + (F.col("n") + 1) / 2).alias("pes_rank"))
    both = join_spread(x, scored, [*keys, "pes"], per, F.col("truth_rank"), "inner", "__rows")
    got = both.groupBy(*keys).agg(F.sum("__m").alias("n"), (F.sum(F.col("pes") * F.col("__m")) / F.sum("__m")).alias("pes_mean"), rank_correlation("pes_rank", "truth_rank").alias("rho"))
    return got.withColumn("p_value", P.spearman_pvalue(F.col("rho"), F.col("n").cast("double")))


def top(grid_scores: DataFrame, k: int = 10) -> DataFrame:
    return grid_scores.where("rho is not null").orderBy(F.desc(F.round("rho", 10)), "w1", "w2").limit(k)


def slices(grid_scores: DataFrame, at: tuple[float, ...] = (0.0, 0.15, 0.30), step: float = 0.05) -> DataFrame:
    """Rows of the grid near the given w2, for heat maps of w1 against w3."""
    near = F.lit(None).cast("double")
    for a in at:
        near = F.when(F.abs(F.col("w2") - a) < step / 2, F.lit(a)).otherwise(near)
    return grid_scores.select(near.alias("slice"), "w1", "w3", "rho").where("slice is not null")
