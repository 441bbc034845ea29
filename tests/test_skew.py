from pyspark.sql import functions as F

from gradeloom.operators.skew import join_spread


def test_hot_keys_are_spread_and_the_join_is_whole(spark):
    rows = [(i, "hot" if i % 2 else (f"k{i % 40}" if i % 3 else None)) for i in range(4000)]
    left = spark.createDataFrame(rows, "id long, k string")
    right = spark.createDataFrame([("hot", 1), ("hot", 2), (None, 3), ("k2", 4), ("unused", 5)], "k string, v int")
    counts = left.groupBy("k").agg(F.count("*").alias("n"))
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_spread(left, right, ["k"], counts, F.col("id"), how).select("id", "k", "v").collect()), key=str)
        want = []
        for i, k in rows:
            found = {"hot": [1, 2], None: [3], "k2": [4]}.get(k, [] if how == "inner" else [None])
            want += [(i, k, v) for v in found]
        assert got == sorted(want, key=str)
    assert join_spread(left.where("false"), right, ["k"], counts.where("false"), F.col("id")).count() == 0
    even = left.withColumn("k", F.col("id").cast("string"))
    assert join_spread(even, right, ["k"], even.groupBy("k").agg(F.count("*").alias("n")), F.col("id")).count() == 4000
