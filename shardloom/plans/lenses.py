"""Views of the test tables as the data model's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts: Column) -> Column:
    """Seconds since 1970 of a zoneless timestamp, whatever the session's zone."""
    return (F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long") * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)).cast("long")


def blocks(spark: SparkSession, d: str) -> DataFrame:
    """seq_no, gen_utime, shard, is_key, failed, value of events."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("seq_no"), seconds(F.col("ts")).alias("gen_utime"), F.col("user_id").alias("shard"), (F.col("event_type") == "signup").alias("is_key"), (F.col("event_type") == "error").alias("failed"), "value", "event_type")


BLOCKS_SQL = "(select event_id as seq_no, epoch_us(ts) // 1000000 as gen_utime, user_id as shard, event_type = 'signup' as is_key, event_type = 'error' as failed, value, event_type from events)"
