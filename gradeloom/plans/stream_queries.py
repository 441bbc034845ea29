"""Streaming queries, run to completion over the event log, and their batch equivalents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.sources import canonical, sinks
from gradeloom.operators import results as R
from gradeloom.plans import sqltext as Q
from gradeloom.plans.lexical_queries import ORACLE as LEXICAL
from gradeloom.plans.wide_queries import METRICS
from gradeloom.session import ensure_checkpoint_dir, kept, read
from gradeloom.streaming import incremental


def _work(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/stream-{uuid.uuid4().hex}"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = read(spark, sf_dir, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(f"{sf_dir}/events.parquet*")


def stream_call_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly calls by a stream in update of whole windows, written by foreachBatch and read back."""
    out = _work(spark)
    q = incremental.evaluate_stream(_events(spark, sf_dir), incremental.call_rates_batch, f"{out}/rows", f"{out}/checkpoint")
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/rows").groupBy("start", "event_type").agg(F.sum("calls").alias("calls"), F.round(F.sum("value"), 4).alias("value"))
    return kept(got, out)


def stream_window_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly calls as a windowed aggregation with a watermark; every batch rewrites the whole table."""
    out = _work(spark)
    rates = incremental.call_rates(_events(spark, sf_dir).withColumn("ts", F.col("ts").cast("timestamp")))  # watermarks need a zone
    write = lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/rows")
    q = rates.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    got = spark.read.parquet(f"{out}/rows")
    return kept(got.withColumns({"start": F.col("start").cast("timestamp_ntz"), "value": F.round("value", 4)}), out)


def call_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incremental.call_rates_batch(read(spark, sf_dir, "events")).withColumn("value", F.round("value", 4))


def csv_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = R.canonical_results(read(spark, sf_dir, "eval_results")).where("sample_index is not null")
    return sinks.csv_wide(r, ("run_id", "sample_index"))


def plot_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = sinks.plot_data(read(spark, sf_dir, "orders"), "o_orderstatus", "o_totalprice")
    return got.withColumns({c: F.round(c, 3) for c in ("q1", "median", "q3", "low", "high", "mean")})


def evaluate_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The evaluator over all samples with column metrics: one wide pass, then long results and their statistics."""
    from gradeloom.evaluator import evaluate

    s = canonical.samples(read(spark, sf_dir, "samples"))
    got = R.summary(evaluate(s, ["exact_match", "token_f1", "bleu-4"]))
    return got.withColumns({c: F.round(c, 6) for c in ("mean", "median", "stdev", "min", "max")})


QUERIES = {f.__name__: f for f in (stream_call_rates, stream_window_rates, call_rates, csv_wide, plot_quartiles, evaluate_lexical)}

_RATES = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS calls, round(sum(value), 4) AS value FROM events GROUP BY 1, 2"
ORACLE = {
    "stream_call_rates": _RATES,
    "evaluate_lexical": "SELECT metric_name, count(*) AS n, round(avg(score), 6) AS mean, round(median(score), 6) AS median, round(coalesce(stddev_samp(score), 0.0), 6) AS stdev, round(min(score), 6) AS min, round(max(score), 6) AS max FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric_name, score FROM ({LEXICAL[k]})" for m, k in (("exact_match", "exact_match"), ("token_f1", "token_f1"), ("bleu-4", "bleu4")))
    + ") GROUP BY 1",
    "stream_window_rates": _RATES,
    "call_rates": _RATES,
    "csv_wide": f"""SELECT run_id AS "Run_Id", sample_index AS "Sample_Index", {", ".join(f"coalesce((max(score) FILTER (metric_name = '{m}'))::VARCHAR, '') AS {m}_Score, coalesce(max(reason) FILTER (metric_name = '{m}'), '') AS {m}_Reason" for m in METRICS)}
 FROM {Q.RESULTS} WHERE sample_index IS NOT NULL GROUP BY 1, 2""",
    "plot_quartiles": "SELECT o_orderstatus, round(quantile_cont(o_totalprice, 0.25), 3) AS q1, round(quantile_cont(o_totalprice, 0.5), 3) AS median, round(quantile_cont(o_totalprice, 0.75), 3) AS q3, round(min(o_totalprice), 3) AS low, round(max(o_totalprice), 3) AS high, round(avg(o_totalprice), 3) AS mean, count(o_totalprice) AS n FROM orders GROUP BY 1",
}
