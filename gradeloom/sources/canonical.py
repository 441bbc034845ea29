"""The canonical tables: what a delivery means once redeliveries and missing values are settled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(df: DataFrame, key: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The last row of every key by ``order`` (nulls first); other columns as they stand.

    One partial aggregation: a key that is delivered any number of times shrinks before the shuffle.
    """
    rest = [c for c in df.columns if c not in key]
    o = F.struct(*[F.coalesce(F.col(c) if isinstance(c, str) else c) for c in order])
    got = df.groupBy(*key).agg(F.max_by(F.struct(*rest), o).alias("__row"))
    return got.select(*key, *[F.col(f"__row.{c}").alias(c) for c in rest]).select(*df.columns)


def samples(df: DataFrame) -> DataFrame:
    """One row per sample_index with missing texts as empty strings and missing contexts as an empty array.

    Rows without sample_index are left out; columns besides the canonical ones stay.
    """
    once = latest(df.where(F.col("sample_index").isNotNull()), ["sample_index"], ["ingested_at"]) if "ingested_at" in df.columns else df.where(F.col("sample_index").isNotNull()).dropDuplicates(["sample_index"])
    texts = {c: F.coalesce(F.col(c), F.lit("")) for c in ("question", "answer", "ground_truth") if c in once.columns}
    return once.withColumns({**texts, "contexts": F.coalesce(F.col("contexts"), F.array().cast("array<string>"))})
