"""Entity-attribute-value rows to one wide typed row per entity.

Cells are first reduced by the JVM's partial aggregation (so an entity or cell delivered any number of times, or one
run that holds a third of all rows, shrinks before the shuffle), then hash-bucketed by entity. Each bucket is sorted by
entity and streamed through Arrow: entities and attributes are dictionary-encoded, values are scattered into one
array per column by (row, column) index and emitted as Arrow batches. Memory is bounded by the Arrow batch, not by
the bucket.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Attributes become columns; more than this many is a modelling error, reported instead of building such a table.
MAX_ATTRIBUTES = 2000


def normal_name(c: Column) -> Column:
    """Trimmed, lower case, spaces and hyphens as underscores."""
    trimmed = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.regexp_replace(F.lower(trimmed), r"(?U)[\s-]", "_")


def valid_score(c: Column) -> Column:
    """The score where it is usable (not null, not NaN, within 0..1), else null."""
    return F.when(c.isNotNull() & ~F.isnan(c) & (c >= 0.0) & (c <= 1.0), c)


def metric_cells(results: DataFrame) -> DataFrame:
    """One row per (run_id, sample_index, metric_name): latest score and reason, and the spread of valid scores.

    Redelivered rows are equal but for ``ingested_at`` and so cannot change any aggregate. Of rescored cells the
    latest ``scored_at`` wins (ties: greater ``result_id``); a valid score is preferred to none. Null run, sample or
    metric keys form their own cells; rows with a null metric name are dropped (they name no column).
    """
    v = valid_score(F.col("score"))
    order = F.struct(v.isNotNull().alias("ok"), F.coalesce(F.col("scored_at"), F.lit("1970-01-01").cast("timestamp")).alias("at"), F.coalesce(F.col("result_id"), F.lit(-1)).alias("id"))
    return (
        results.where(F.col("metric_name").isNotNull())
        .select("run_id", "sample_index", normal_name(F.col("metric_name")).alias("attribute"), v.alias("v"), "reason", order.alias("o"))
        .groupBy("run_id", "sample_index", "attribute")
        .agg(
            F.max_by(F.struct("v", "reason"), "o").alias("last"),
            F.min("v").alias("lo"),
            F.max("v").alias("hi"),
        )
        .select(
            "run_id",
            "sample_index",
            "attribute",
            F.col("last.v").alias("score"),
            F.col("last.reason").alias("reason"),
            F.coalesce(F.col("lo") < F.col("hi"), F.lit(False)).alias("contradicts"),
        )
    )


def to_wide(cells: DataFrame, entity: Sequence[str], values: Sequence[str], attributes: Sequence[str] | None = None, flag: str | None = None) -> DataFrame:
    """One row per entity with a typed column ``<attribute>_<value>`` per attribute and value.

    cells: (entity..., attribute, values...[, flag boolean]), one row per entity and attribute (later rows win in
    arrival order otherwise). ``flag`` adds ``flagged array<string>``: the attributes whose cell carries the flag.
    Attributes not listed are dropped; absent cells are null; an empty table gives no rows. ``attributes=None`` takes
    the sorted distinct names, at most MAX_ATTRIBUTES (an error otherwise).
    """
    if attributes is None:
        found = [r[0] for r in cells.select("attribute").distinct().limit(MAX_ATTRIBUTES + 1).collect()]
        if len(found) > MAX_ATTRIBUTES:
            raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
        attributes = sorted(a for a in found if a is not None)
    names = list(attributes)
    fields = {f.name: f for f in cells.schema.fields}
    out_fields = [fields[e] for e in entity]
    for a in names:
        out_fields += [T.StructField(f"{a}_{v}", fields[v].dataType, True) for v in values]
    if flag:
        out_fields.append(T.StructField("flagged", T.ArrayType(T.StringType()), True))
    schema = T.StructType(out_fields)
    keys = list(entity)
    use = cells.select(*keys, "attribute", *values, *([flag] if flag else []))

    def scatter(t: pa.Table) -> pa.RecordBatch:
        n = t.num_rows
        change = np.zeros(n, bool)
        change[:1] = True
        for k in keys:
            codes = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
            change[1:] |= codes[1:] != codes[:-1]
        row = np.cumsum(change) - 1
        rows = int(row[-1]) + 1
        first = np.flatnonzero(change)
        where = {a: j for j, a in enumerate(names)}
        enc = pc.dictionary_encode(t.column("attribute").combine_chunks())
        col_of = np.array([where.get(a, -1) for a in enc.dictionary.to_pylist()] + [-1], np.int64)
        idx = enc.indices.fill_null(len(col_of) - 1).to_numpy(zero_copy_only=False)
        col = col_of[idx]
        keep = col >= 0
        cells_of = np.flatnonzero(keep)
        cells_of = cells_of[np.argsort(col[cells_of], kind="stable")]
        edges = np.searchsorted(col[cells_of], np.arange(len(names) + 1))
        arrays = [t.column(k).combine_chunks().take(pa.array(first)) for k in keys]
        vals = {v: t.column(v).combine_chunks() for v in values}
        for j in range(len(names)):
            mine = cells_of[edges[j] : edges[j + 1]]
            place = np.full(rows, -1, np.int64)
            place[row[mine]] = mine
            at = pa.array(np.maximum(place, 0), mask=place < 0)
            arrays += [vals[v].take(at) for v in values]
        if flag:
            hit = np.flatnonzero(t.column(flag).combine_chunks().fill_null(False).to_numpy(zero_copy_only=False).astype(bool) & keep)
            lists: list[list[str]] = [[] for _ in range(rows)]
            for i in hit:
                lists[row[i]].append(names[col[i]])
            arrays.append(pa.array([sorted(x) for x in lists], pa.list_(pa.string())))
        return pa.RecordBatch.from_arrays(arrays, names=[f.name for f in out_fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            if rest is not None:
                t = pa.concat_tables([rest, t]).combine_chunks()
            last = t.num_rows - 1
            same = np.ones(t.num_rows, bool)  # rows of the last entity wait for the next batch
            for k in keys:
                codes = pc.dictionary_encode(t.column(k).combine_chunks(), null_encoding="encode").indices.to_numpy(zero_copy_only=False)
                same &= codes == codes[last]
            cut_at = int(np.flatnonzero(~same)[-1]) + 1 if (~same).any() else 0
            if cut_at:
                yield scatter(t.slice(0, cut_at).combine_chunks())
            rest = t.slice(cut_at)
        if rest is not None and rest.num_rows:
            yield scatter(rest.combine_chunks())

    return use.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys).mapInArrow(run, schema)


def wide_results(results: DataFrame, attributes: Sequence[str] | None = None) -> DataFrame:
    """eval_results as one row per run_id and sample_index: ``<metric>_score``, ``<metric>_reason`` and ``flagged``,
    the metrics with two or more different valid scores."""
    cells = metric_cells(results)
    if attributes is None:
        attributes = metric_columns(results)
    return to_wide(cells, ["run_id", "sample_index"], ["score", "reason"], attributes, flag="contradicts")


def metric_columns(results: DataFrame) -> list[str]:
    """The sorted normalised metric names of ``results`` (a schema, so at most MAX_ATTRIBUTES; reads one column)."""
    raw = results.select("metric_name").where(F.col("metric_name").isNotNull()).distinct()
    found = [r[0] for r in raw.select(normal_name(F.col("metric_name")).alias("m")).distinct().limit(MAX_ATTRIBUTES + 1).collect()]
    if len(found) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} metrics")
    return sorted(found)


def contradicting_cells(wide: DataFrame) -> DataFrame:
    """(run_id, sample_index, metric_name) of the flagged cells of ``wide_results``."""
    return wide.select("run_id", "sample_index", F.explode("flagged").alias("metric_name"))
