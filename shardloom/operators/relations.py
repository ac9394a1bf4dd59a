"""Joins, aggregates, retention and paging over typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAGE = 8
#: Rows of a table of tops (one a shard) that are broadcast; with more, joins are shuffled.
BROADCAST_TOPS = 1_000_000


def tops_hint(tops: DataFrame) -> DataFrame:
    return F.broadcast(tops) if tops.count() <= BROADCAST_TOPS else tops


def top_blocks(df: DataFrame, shard: str, seq: str, upto: Column | None = None) -> DataFrame:
    return (df if upto is None else df.filter(upto)).groupBy(shard).agg(F.max(seq).alias("top"))


def retention_delete(df: DataFrame, tops: DataFrame, shard: str, seq: str, is_key: Column) -> DataFrame:
    """Rows below their shard's top that are neither the first block nor key blocks; rows of unknown shards go too."""
    rows = df.join(tops_hint(tops), shard, "left")
    return rows.filter(~F.coalesce(F.col(seq) >= F.col("top"), F.lit(False)) & (F.col(seq) != 0) & ~is_key).drop("top")


def prefix_join(left: DataFrame, right: DataFrame, lp: str, rp: str, bits: int) -> DataFrame:
    """Pairs whose prefixes overlap, as an equi-join: each prefix meets all prefixes of the other side's that start it.

    A left row gives its own prefixes (at most bits + 1) to match shorter right ones, and right rows theirs.
    """
    starts = lambda c: F.transform(F.sequence(F.lit(0), F.length(c)), lambda n: F.left(c, n))
    shorter = left.withColumn("_k", F.explode(starts(F.col(lp)))).join(right.withColumn("_k", F.col(rp)), "_k")
    longer = left.withColumn("_k", F.col(lp)).join(right.filter(F.length(rp) > 0).withColumn("_k", F.explode(F.filter(starts(F.col(rp)), lambda p: F.length(p) < F.length(F.col(rp))))), "_k")
    return shorter.drop("_k").unionByName(longer.drop("_k"))


def refcount_merge(deltas: DataFrame, key: str, delta: str, order: str, payload: str) -> DataFrame:
    """Sum of deltas and the first payload that came with a positive one; zero sums are dropped, negative ones keep no payload."""
    up = F.col(delta) > 0
    rows = deltas.groupBy(key).agg(F.sum(delta).alias("rc"), F.min_by(payload, F.when(up, F.col(order))).alias("_p"))
    return rows.filter("rc <> 0").select(key, "rc", F.when(F.col("rc") > 0, F.col("_p")).alias("payload"))


def insert_if_absent(existing: DataFrame, incoming: DataFrame, key: str) -> DataFrame:
    """incoming with status: created where the key is new, else fetched."""
    known = existing.select(F.col(key).alias("_k")).distinct()
    return incoming.join(known, F.col(key) == F.col("_k"), "left").withColumn("status", F.when(F.col("_k").isNull(), "created").otherwise("fetched")).drop("_k")


def set_once_conflicts(df: DataFrame, key: str, ref: Column) -> DataFrame:
    return df.withColumn("_r", F.when(ref != 0, ref)).groupBy(key).agg(F.min("_r").alias("lo"), F.max("_r").alias("hi")).filter("lo < hi")


def quorum(df: DataFrame, group: str, weight: Column, signed: Column) -> DataFrame:
    """True where signers weigh more than two thirds, strictly."""
    w = weight.cast("decimal(28,2)")
    return df.groupBy(group).agg((F.coalesce(F.sum(F.when(signed, w)), F.lit(0)) * 3 > F.sum(w) * 2).alias("ok"))


def key_page(df: DataFrame, seq: str, start: int, limit: int) -> DataFrame:
    """A page of at most min(limit, PAGE) rows from start, that row included, and whether it falls short of limit."""
    rows = df.filter(F.col(seq) >= start).orderBy(seq).limit(min(limit, PAGE))
    return rows.withColumn("incomplete", F.count("*").over(Window.partitionBy(F.lit(0))) < limit)


def concat_segments(df: DataFrame, group: str, order: str, data: Column, between: str = "") -> DataFrame:
    items = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), data.alias("d"))))
    return df.groupBy(group).agg(F.array_join(F.transform(items, lambda x: x["d"]), between).alias("data"))


def disk_usage(name: str, df: DataFrame, key: Column, value: Column) -> DataFrame:
    return df.agg(F.lit(name).alias("table_name"), F.sum(F.octet_length(key.cast("string"))).cast("long").alias("key_bytes"), F.sum(F.octet_length(value.cast("string"))).cast("long").alias("value_bytes"))


def cover(df: DataFrame, ids: list[int], seq: str, tolerance: int) -> DataFrame:
    """Greatest of a short list of ids at or before each row, if less than tolerance before it."""
    best = F.lit(None).cast("long")
    for i in sorted(ids):
        best = F.when(F.col(seq) >= i, F.lit(i).cast("long")).otherwise(best)
    return df.withColumn("archive_id", F.when(F.col(seq) < best + tolerance, best))
