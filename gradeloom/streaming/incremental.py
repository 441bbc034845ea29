"""Incremental evaluation on Structured Streaming: scored micro-batches, cache expiry, duplicates and run state."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gradeloom.operators.results import canonical_results


def evaluate_stream(samples: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, on_batch: Callable[[DataFrame, int], None] | None = None, once: bool = True) -> StreamingQuery:
    """Score each micro-batch of samples and write it under its batch number, so that a replayed batch overwrites itself."""

    def each(batch: DataFrame, n: int) -> None:
        got = score(batch)
        got.write.mode("overwrite").parquet(f"{path}/batch={n}")
        if on_batch is not None:
            on_batch(batch.sparkSession.read.parquet(f"{path}/batch={n}"), n)

    w = samples.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def distinct_events(events: DataFrame, key: str = "event_id", ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Each key once; keys are remembered for ``delay`` of event time."""
    return events.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def call_rates(events: DataFrame, ts: str = "ts", window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """Calls and their value per hour and type; late rows count up to ``delay``."""
    got = events.withWatermark(ts, delay).groupBy(F.window(ts, window).alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value"))
    return got.select(F.col("w.start").alias("start"), "event_type", "calls", "value")


def call_rates_batch(events: DataFrame) -> DataFrame:
    """The same table from a finished log."""
    return events.groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("calls"), F.sum("value").alias("value")).select(F.col("w.start").alias("start"), "event_type", "calls", "value")


def running_best(scores: DataFrame) -> DataFrame:
    """(metric_name, n, best) as a running state per metric; a metric that stays silent for a day is forgotten."""

    def update(key: tuple[Any, ...], rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        n, best = state.get if state.exists else (0, float("-inf"))
        for r in rows:
            s = r["score"].dropna()
            n += len(r)
            best = max([best, *s.tolist()])
        state.update((n, best))
        state.setTimeoutDuration(86_400_000)
        yield pd.DataFrame([(key[0], n, best)], columns=["metric_name", "n", "best"])

    return scores.groupBy("metric_name").applyInPandasWithState(update, "metric_name string, n long, best double", "n long, best double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def latest_results(spark, path: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """The results table of all batches written so far, later deliveries of a cell winning."""
    return canonical_results(spark.read.parquet(path))
