"""Dataset scans: JSON arrays, JSON lines, CSV and registered adapters, all to the canonical sample columns."""

from __future__ import annotations

import logging
import os
import uuid
from collections.abc import Mapping
from itertools import islice
from pathlib import PurePosixPath

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gradeloom.session import ensure_checkpoint_dir

log = logging.getLogger(__name__)

FORMATS = ("json", "jsonl", "csv", "hf")
COLUMNS = ("question", "answer", "ground_truth", "contexts", "metadata")


def load_dataset(spark: SparkSession, path: str, format: str | None = None, column_mapping: Mapping[str, str] | None = None, limit: int | None = None) -> DataFrame:
    """Samples of a file or folder. The format follows the suffix (.json, .jsonl, .csv; anything else is a hub name).

    An unknown format is a ValueError. Unknown columns are ignored, missing texts become empty strings and missing
    contexts an empty array; a source without ``question`` is a ValueError. ``sample_index`` numbers the rows in file
    order; ``limit`` keeps the first ones. An empty file gives no rows.
    """
    kind = format or {".json": "json", ".jsonl": "jsonl", ".csv": "csv"}.get(PurePosixPath(path).suffix.lower(), "hf")
    if kind not in FORMATS:
        raise ValueError(f"unknown dataset format {kind!r}")
    df = {"json": read_json_array, "jsonl": read_json_lines, "csv": read_csv, "hf": read_hub}[kind](spark, path)
    df = canonical(map_columns(df, column_mapping or {}))
    return df if limit is None else df.where(F.col("sample_index") < limit)


def read_json_array(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rows, or an object that holds it under ``data``."""
    df = spark.read.option("multiLine", True).json(path)
    if "data" in df.columns and isinstance(df.schema["data"].dataType, T.ArrayType) and isinstance(df.schema["data"].dataType.elementType, T.StructType):
        df = df.select(F.posexplode("data").alias("__seq", "__row")).select("__seq", "__row.*")
    return df


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line; blank lines are skipped."""
    return spark.read.option("mode", "FAILFAST").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header; ``contexts`` is a JSON list or one context."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    if "contexts" in df.columns:
        df = df.withColumn("contexts", parse_contexts(F.col("contexts")))
    return df


def parse_contexts(c: Column) -> Column:
    return F.when(c.isNull(), F.array().cast("array<string>")).otherwise(F.coalesce(F.from_json(c, "array<string>"), F.array(c)))


#: Rows of a hub dataset that are held in memory at once.
HUB_ROWS = 10_000


def read_hub(spark: SparkSession, name: str, split: str = "train", folder: str | None = None) -> DataFrame:
    """A split of a hub dataset; needs the optional ``datasets`` package and a network.

    The rows are streamed in Parquet files of HUB_ROWS to a folder that all executors see (by default one below the
    checkpoint folder) and scanned from there.
    """
    try:
        import datasets
    except ImportError as e:
        raise RuntimeError("reading a hub dataset needs the optional package 'datasets'") from e
    rows = iter(datasets.load_dataset(name, split=split, streaming=True))
    target = folder or f"{ensure_checkpoint_dir(spark)}/hub-{uuid.uuid4().hex}"
    schema = None
    while batch := list(islice(rows, HUB_ROWS)):
        part = spark.createDataFrame(pd.DataFrame(batch), schema)
        schema = schema or part.schema
        part.coalesce(1).write.mode("append").parquet(target)
    if schema is None:
        raise ValueError(f"{name} has no rows in split {split!r}")
    return spark.read.parquet(target)


def map_columns(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Rename source columns; absent sources are ignored and a later mapping overwrites an existing column."""
    for src, dest in mapping.items():
        if src in df.columns and src != dest:
            df = df.drop(dest) if dest in df.columns else df
            df = df.withColumnRenamed(src, dest)
    return df


def canonical(df: DataFrame) -> DataFrame:
    """The sample columns with defaults, and sample_index in file order."""
    if "question" not in df.columns:
        raise ValueError("the dataset has no column 'question'")
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in df.columns else F.lit("")
    if "contexts" not in df.columns:
        contexts = F.array().cast("array<string>")
    elif isinstance(df.schema["contexts"].dataType, T.ArrayType):
        contexts = F.coalesce(F.col("contexts").cast("array<string>"), F.array().cast("array<string>"))
    else:
        contexts = parse_contexts(F.col("contexts").cast("string"))
    if "metadata" not in df.columns:
        metadata = F.lit(None).cast("string")
    elif isinstance(df.schema["metadata"].dataType, T.StringType):
        metadata = F.col("metadata")
    else:
        metadata = F.to_json("metadata")
    out = df.select(
        *([F.col("__seq").cast("long").alias("sample_index")] if "__seq" in df.columns else []), text("question").alias("question"), text("answer").alias("answer"), text("ground_truth").alias("ground_truth"), contexts.alias("contexts"), metadata.alias("metadata")
    )
    return out if "__seq" in df.columns else number_rows(out)


def number_rows(df: DataFrame, name: str = "sample_index") -> DataFrame:
    """Consecutive numbers in source order, without one task sorting all rows: partition sizes first, then offsets."""
    x = df.withColumn("__id", F.monotonically_increasing_id())
    part, pos = F.shiftright("__id", 33), F.col("__id").bitwiseAND((1 << 33) - 1)
    sizes = x.groupBy(part.alias("__p")).agg(F.count("*").alias("__n"))  # one row per partition
    offsets = sizes.select("__p", (F.sum("__n").over(Window.orderBy("__p")) - F.col("__n")).alias("__o"))
    out = x.withColumn("__p", part).join(F.broadcast(offsets), "__p")
    return out.select((F.col("__o") + pos).alias(name), *df.columns)


def validate(samples: DataFrame) -> dict[str, int]:
    """Counts of missing answers, contexts and ground truths; warns, never fails."""
    row = samples.agg(F.count("*").alias("n"), F.count_if(F.col("answer") == "").alias("missing_answers"), F.count_if(F.size("contexts") == 0).alias("missing_contexts"), F.count_if(F.col("ground_truth") == "").alias("missing_ground_truths")).first()
    out = row.asDict()
    for k, v in out.items():
        if k != "n" and v:
            log.warning("%d of %d samples: %s", v, out["n"], k.replace("_", " "))
    return out


def statistics(samples: DataFrame) -> DataFrame:
    """Number of samples, contexts per sample, characters per context (0 without contexts) and missing fields."""
    chars = F.aggregate(F.transform("contexts", F.length), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return samples.agg(
        F.count("*").alias("num_samples"),
        F.avg(F.size("contexts")).alias("avg_contexts_per_sample"),
        F.coalesce(F.try_divide(F.sum(chars), F.nullif(F.sum(F.size("contexts")), F.lit(0))), F.lit(0.0)).alias("avg_context_length"),
        F.count_if(F.col("answer") == "").alias("missing_answers"),
        F.count_if(F.size("contexts") == 0).alias("missing_contexts"),
        F.count_if(F.col("ground_truth") == "").alias("missing_ground_truths"),
    )


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Whole UTF-8 text files as (path, text); PDF files are refused."""
    if path.lower().endswith(".pdf"):
        raise ValueError("PDF files are not supported; convert them to text")
    return spark.read.option("wholetext", True).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_report(spark: SparkSession, path: str) -> DataFrame:
    """Result rows (with ``seq``) of a saved JSON report: a document with ``results``, perhaps below ``report``, or a
    folder that ``sinks.write_json`` wrote. Anything else is a ValueError."""
    if os.path.isdir(path) and os.path.isdir(os.path.join(path, "results")):
        return number_rows(spark.read.json(os.path.join(path, "results")), "seq")
    df = spark.read.option("multiLine", True).json(path)
    if "report" in df.columns and isinstance(df.schema["report"].dataType, T.StructType) and "results" in df.schema["report"].dataType.names:
        root = "report.results"
    elif "results" in df.columns:
        root = "results"
    else:
        raise ValueError(f"{path} is no report: it has no results")
    if not isinstance(df.select(root).schema[0].dataType, T.ArrayType) or not isinstance(df.select(root).schema[0].dataType.elementType, T.StructType):
        return spark.createDataFrame([], "seq int, metric_name string, score double, sample_index long, reason string")
    return df.select(F.posexplode(root).alias("seq", "r")).select("seq", "r.*")
