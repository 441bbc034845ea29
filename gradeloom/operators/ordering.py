"""Order statistics without a task that holds a whole group: rows are range-partitioned, summed per partition, and each
partition's sum is added to those behind it."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradeloom.operators.skew import join_spread
from gradeloom.session import cut


def running_total(df: DataFrame, by: Sequence[str], order: Sequence[str], weight: Column) -> DataFrame:
    """``df`` with ``__before``, the sum of ``weight`` over the rows before it within ``by`` in the order given, and
    ``__total``, that over the whole group. Nulls are a group, and a value, of their own."""
    local = df.withColumn("__w", weight).repartitionByRange(*[F.col(c) for c in (*by, *order)])
    parts = cut(local.withColumn("__p", F.spark_partition_id()))  # fixes which row is in which partition
    w = Window.partitionBy("__p", *by).orderBy(*order)
    inside = F.coalesce(F.sum("__w").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = parts.groupBy("__p", *by).agg(F.sum("__w").alias("__s"))  # a row per partition and group
    g = Window.partitionBy(*by)
    earlier = F.coalesce(F.sum("__s").over(g.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sums.select(F.col("__p").alias("__q"), *[F.col(c).alias(f"__q_{c}") for c in by], earlier.alias("__o"), F.sum("__s").over(g).alias("__total"))
    on = reduce(Column.__and__, [F.col(c).eqNullSafe(F.col(f"__q_{c}")) for c in by], F.col("__p") == F.col("__q"))
    out = parts.withColumn("__i", inside).join(offsets, on)
    return out.select(*df.columns, (F.col("__o") + F.col("__i")).alias("__before"), "__total")


def value_ranks(df: DataFrame, by: Sequence[str], column: str) -> DataFrame:
    """(by..., column, n, rank, __total): the distinct values, how often each occurs, and their mean rank."""
    per = df.groupBy(*by, column).agg(F.count("*").alias("n"))
    got = running_total(per, by, [column], F.col("n"))
    return got.select(*by, column, "n", (F.col("__before") + (F.col("n") + 1) / 2).alias("rank"), "__total")


def ranked_rows(df: DataFrame, by: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The distinct rows of by and columns with ``__m``, how often each occurs, and ``<column>_rank`` (ties share their
    mean rank) within each group."""
    rows = cut(df.groupBy(*by, *columns).agg(F.count("*").alias("__m")))
    out = rows
    for c in columns:
        ranks = cut(value_ranks(df.select(*by, c), by, c))
        here = rows.groupBy(*by, c).agg(F.count("*").alias("n"))
        out = join_spread(out, ranks.select(*by, c, F.col("rank").alias(f"{c}_rank")), [*by, c], here, F.struct(*[F.col(x) for x in columns]), "inner")
    return out


def rank_correlation(a: str, b: str, m: str = "__m") -> Column:
    """Spearman's rho from sums over distinct rows of mean ranks; null where either side does not vary."""
    n = F.sum(m).cast("double")
    middle = n * F.pow((n + 1) / 2, F.lit(2))
    x, y = F.col(a), F.col(b)
    cov, vx, vy = (F.sum(F.col(m) * p * q) - middle for p, q in ((x, y), (x, x), (y, y)))
    least = 1e-9 * n * n * n
    return F.when((vx > least) & (vy > least), F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy)))


def quantiles(df: DataFrame, by: Sequence[str], column: str, probabilities: Sequence[float]) -> DataFrame:
    """(by..., q): exact quantiles of the non-null values, interpolated between neighbours, as an array."""
    got = value_ranks(df.where(F.col(column).isNotNull()).select(*by, column), by, column)
    before = F.col("rank") - (F.col("n") + 1) / 2

    def at(position: Column) -> Column:
        return F.max(F.when((before <= position) & (position < before + F.col("n")), F.col(column)))

    out = []
    for p in probabilities:
        h = (F.col("__total") - 1) * F.lit(float(p))
        lo, hi = at(F.floor(h)), at(F.ceil(h))
        out.append(lo + (hi - lo) * F.max(h - F.floor(h)))
    return got.groupBy(*by).agg(F.array(*out).alias("q"))
