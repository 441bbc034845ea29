"""Judge calls: cache table, usage and cost."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradeloom.functions import scoring as K


def cache_rows(cache: DataFrame) -> DataFrame:
    """(cache_key, text, tokens, model, provider, cost, latency, cached_at); entries without a response are left out."""
    r = "response."
    return cache.where("response is not null").select(
        "cache_key", F.col(r + "text").alias("text"), F.coalesce(F.col(r + "input_tokens"), F.lit(0)).alias("input_tokens"), F.coalesce(F.col(r + "output_tokens"), F.lit(0)).alias("output_tokens"), F.col(r + "model").alias("model"), F.col(r + "provider").alias("provider"),
        F.coalesce(F.col(r + "cost_estimate"), F.lit(0.0)).alias("cost"), F.col(r + "latency_ms").alias("latency_ms"), "cached_at",
    )


def usage(rows: DataFrame) -> DataFrame:
    """Totals per provider/model, and over all (model_key null)."""
    key = F.concat_ws("/", "provider", "model")
    got = rows.withColumn("model_key", key).rollup("model_key").agg(F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.round(F.sum("cost"), 6).alias("cost"), F.count("*").alias("calls"))
    return got.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))


def alive(cache: DataFrame, now: float, ttl: float | None) -> DataFrame:
    return cache if ttl is None else cache.where(F.lit(now) - F.col("cached_at") <= ttl)


def cache_stats(asked: DataFrame, cache: DataFrame) -> DataFrame:
    """hits, misses, hit_rate (0 without requests) and entries of requests (key) against a cache (cache_key)."""
    keys = cache.select("cache_key").distinct()
    hit = asked.join(keys.withColumn("hit", F.lit(1)), asked["key"] == keys["cache_key"], "left").agg(F.count("hit").alias("hits"), F.count_if(F.col("hit").isNull()).alias("misses"))
    n = keys.agg(F.count("*").alias("entries"))
    total = F.nullif(F.col("hits") + F.col("misses"), F.lit(0))
    return hit.crossJoin(F.broadcast(n)).select("hits", "misses", F.coalesce(F.try_divide(F.col("hits"), total), F.lit(0.0)).alias("hit_rate"), "entries")  # one row each


def priced(answers: DataFrame, model: str, provider: str) -> DataFrame:
    """(provider, model, input_tokens, output_tokens, cost) of answered calls; unknown counts are 0."""
    tokens = [F.coalesce(F.col(c), F.lit(0)).alias(c) for c in ("input_tokens", "output_tokens")]
    x = answers.where(F.col("text").isNotNull()).select(F.lit(provider).alias("provider"), F.lit(model).alias("model"), *tokens)
    return x.withColumn("cost", K.cost(F.col("model"), F.col("input_tokens"), F.col("output_tokens"), F.col("provider")))


def totals(rows: DataFrame) -> dict[str, float]:
    """The totals of ``priced`` rows under the names that reports give them."""
    r = rows.agg(F.coalesce(F.sum("input_tokens"), F.lit(0)), F.coalesce(F.sum("output_tokens"), F.lit(0)), F.coalesce(F.sum("cost"), F.lit(0.0))).first()
    return {"total_input_tokens": int(r[0]), "total_output_tokens": int(r[1]), "total_estimated_cost": round(float(r[2]), 6)}


def put(answers: DataFrame, path: str, now: float) -> None:
    """Append answered requests (key, text) to the cache table at ``path``; failed ones are not kept."""
    rows = answers.where(F.col("text").isNotNull()).select(F.col("key").alias("cache_key"), "text", F.lit(now).alias("cached_at"))
    rows.write.mode("append").parquet(path)


CACHE = "cache_key string, text string, cached_at double"


def empty(spark) -> DataFrame:  # type: ignore[no-untyped-def]
    return spark.createDataFrame([], CACHE)


def load(spark, path: str) -> DataFrame:  # type: ignore[no-untyped-def]
    """The latest entry per key; rows without key or text (a broken write) are left out. A missing table is empty."""
    try:
        got = spark.read.schema(CACHE).parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return empty(spark)
    good = got.where("cache_key is not null and text is not null")
    return good.groupBy("cache_key").agg(F.max_by("text", "cached_at").alias("text"), F.max("cached_at").alias("cached_at"))


def clear(spark, path: str) -> None:  # type: ignore[no-untyped-def]
    empty(spark).write.mode("overwrite").parquet(path)
