from datetime import datetime

from pyspark.sql import functions as F

from gradeloom.streaming import incremental

DDL = "event_id long, ts timestamp, event_type string, value double"


def test_stream_equals_batch_and_replays_are_harmless(spark, tmp_path):
    rows = [(i, datetime(2024, 1, 1, i % 5), "ab"[i % 2], float(i)) for i in range(40)]
    src = str(tmp_path / "in")
    spark.createDataFrame(rows, DDL).repartition(4).write.parquet(src)
    seen = []
    for _ in range(2):  # the second run finds nothing new
        stream = spark.readStream.schema(DDL).option("maxFilesPerTrigger", 2).parquet(src)
        incremental.evaluate_stream(stream, incremental.call_rates_batch, str(tmp_path / "out"), str(tmp_path / "cp"), lambda df, n: seen.append(n)).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("start", "event_type").agg(F.sum("calls").alias("calls"), F.sum("value").alias("value"))
    want = incremental.call_rates_batch(spark.read.parquet(src))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and seen == [0, 1]


def test_duplicates_and_late_rows(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, datetime(2024, 1, 1), "a", 1.0), (1, datetime(2024, 1, 1), "a", 1.0), (2, datetime(2024, 1, 1, 2), "a", None)], DDL).coalesce(1).write.parquet(src)
    q = incremental.distinct_events(spark.readStream.schema(DDL).parquet(src)).writeStream.format("memory").queryName("distinct_events").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination()
    assert sorted(r["event_id"] for r in spark.table("distinct_events").collect()) == [1, 2]
    q = incremental.call_rates(spark.readStream.schema(DDL).parquet(src)).writeStream.outputMode("update").format("memory").queryName("call_rates").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp2")).start()
    q.awaitTermination()
    assert sum(r["calls"] for r in spark.table("call_rates").collect()) == 3
