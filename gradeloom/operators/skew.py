"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A key is hot if it alone would give a task more than 1 / HOT_SHARE of a usual task's rows.
HOT_SHARE = 4


def join_spread(left: DataFrame, right: DataFrame, on: Sequence[str], counts: DataFrame, spread: Column, how: str = "left", n: str = "n") -> DataFrame:
    """``left.join(right, on, how)`` (inner or left; keys compare null-safe) with the rows of hot keys spread over tasks.

    counts: how many rows of ``left`` each key has (``on``..., ``n``); keys that it lacks are not hot. spread: any value
    that differs between rows of one key. Of p shuffle partitions fewer than HOT_SHARE * p keys can hold more than
    1 / (HOT_SHARE * p) of the rows: only these reach the driver and are broadcast. Their rows of ``right`` are
    repeated, in all fewer than 2 * HOT_SHARE * p times; all other keys are joined as they are.
    """
    spark = left.sparkSession
    parts = HOT_SHARE * int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole, most = counts.agg(F.coalesce(F.sum(n), F.lit(0)), F.coalesce(F.max(n), F.lit(0))).first()
    same = lambda a, b: reduce(Column.__and__, [F.col(f"{a}{c}").eqNullSafe(F.col(f"{b}{c}")) for c in on])
    keyed = right.select(*[F.col(c).alias(f"__r_{c}") for c in on], *[c for c in right.columns if c not in on])
    if most * parts <= whole:
        return left.join(keyed, same("", "__r_"), how).drop(*[f"__r_{c}" for c in on])
    share = -(-int(whole) // parts)
    hot = counts.where(F.col(n) > share).select(*[F.col(c).alias(f"__h_{c}") for c in on], F.ceil(F.col(n) / share).cast("int").alias("__ways"))
    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in hot.schema.fields)
    hot = F.broadcast(spark.createDataFrame(hot.collect(), kind))  # fewer than ``parts`` rows
    drop = ["__ways", *[f"__h_{c}" for c in on]]
    many = left.join(hot, same("", "__h_"), "left").withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(spread), F.col("__ways")).cast("int"), F.lit(0))).drop(*drop)
    copies = keyed.join(hot, same("__r_", "__h_"), "left").withColumn("__s", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__ways"), F.lit(1)) - 1))).drop(*drop)
    return many.join(copies, same("", "__r_") & (F.col("__salt") == F.col("__s")), how).drop("__salt", "__s", *[f"__r_{c}" for c in on])
