"""Operators over ordered sequences. Sequences are dealt out by shard; the few that run along the whole chain look
only at its sparse key rows, or carry their state over fixed buckets of the sequence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERSISTENT_BITS = 17
ARCHIVE_STEP, ARCHIVE_ALIGN = 100, 20_000
BUCKET = 1 << 16


def persistent_boundaries(keys: DataFrame, bits: int = PERSISTENT_BITS) -> DataFrame:
    """Key rows whose time bucket differs from the previous key row's."""
    rows = last_before(keys, "seq_no", F.col("gen_utime"), "prev_utime", False)
    return rows.filter(F.shiftright("gen_utime", bits) != F.shiftright("prev_utime", bits))


def last_before(df: DataFrame, order: str, value: Column, name: str, inclusive: bool, bucket: int = BUCKET, tie: str | None = None) -> DataFrame:
    """Last non-null value at or before each row of a long order column, without one task for the whole chain.

    Rows of one place are in order of tie, if it is given. Rows meet inside buckets of the order; what a bucket starts with comes from a window over one row a bucket.
    """
    b = F.floor(F.col(order) / bucket)
    rows = df.withColumns({"_b": b, "_v": value})
    w = Window.partitionBy("_b").orderBy(order, *([tie] if tie else [])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    rows = rows.withColumn("_in", F.last("_v", ignorenulls=True).over(w))
    ends = rows.groupBy("_b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col(order))).alias("_end"))
    carried = ends.select("_b", F.last("_end", ignorenulls=True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    return rows.join(carried, "_b").withColumn(name, F.coalesce("_in", "_from")).drop("_b", "_v", "_in", "_from")


def ranked(df: DataFrame, order: str, name: str, bucket: int = BUCKET) -> DataFrame:
    """Rows with their place (0 first) in the order of a long column without ties, counted by bucket."""
    rows = df.withColumn("_b", F.floor(F.col(order) / bucket))
    before = rows.groupBy("_b").agg(F.count("*").alias("_n"))
    before = before.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return rows.withColumn("_place", place).join(before, "_b").withColumn(name, F.col("_before") + F.col("_place")).drop("_b", "_place", "_before")


def gaps(df: DataFrame, part: list[str], order: str, bucket: int = BUCKET) -> DataFrame:
    """Holes in the sequence as (hole_from, hole_to), inclusive."""
    if part:
        rows = df.withColumn("_p", F.lag(order).over(Window.partitionBy(*part).orderBy(order)))
    else:
        rows = last_before(df, order, F.col(order), "_p", False, bucket)
    return rows.filter(F.col(order) - F.col("_p") > 1).select(*part, (F.col("_p") + 1).alias("hole_from"), (F.col(order) - 1).alias("hole_to"))


def contiguity(df: DataFrame, order: str) -> DataFrame:
    return df.agg(F.min(order).alias("lo"), F.max(order).alias("hi"), F.count("*").alias("n")).withColumn("contiguous", F.col("lo") + F.col("n") == F.col("hi") + 1)


def archive_ids(df: DataFrame, order: str, is_key: Column, step: int = ARCHIVE_STEP, align: int = ARCHIVE_ALIGN) -> DataFrame:
    """Archive of each row of a gap-free sequence: a new one at key rows, at aligned places and every step after either."""
    rows = last_before(df, order, F.when(is_key, F.col(order)), "_key", True)
    start = F.greatest(F.coalesce("_key", F.lit(0)), F.col(order) - F.col(order) % align)
    return rows.withColumn("archive_id", (start + step * F.floor((F.col(order) - start) / step)).cast("long")).drop("_key")


def archive_ids_gapped(df: DataFrame, order: str, is_key: str, step: int = ARCHIVE_STEP, align: int = ARCHIVE_ALIGN) -> DataFrame:
    """The same over a sequence with holes, where the rule is a fold. Every aligned stretch starts afresh, so each folds alone."""
    import pandas as pd

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows, at, out = rows.sort_values(order), None, []
        for s, key in zip(rows[order], rows[is_key], strict=True):
            base = s - s % align
            if key:
                at = s
            else:
                at = base if at is None else max(at, base)
                if s >= at + step:
                    at = s
            out.append(at)
        return rows.assign(archive_id=out).drop(columns="_stretch")

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema) + ", archive_id long"
    return df.withColumn("_stretch", F.floor(F.col(order) / align)).groupBy("_stretch").applyInPandas(fold, kind)


def ewma(df: DataFrame, key: str, order: str, value: Column) -> DataFrame:
    """Integer mean of old and new, from the first value on; each key's values are folded in order.

    The fold streams over each key's rows as they are sorted, so no key's values are held at once.
    """
    import pandas as pd

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("k"), F.col(order).alias("o"), value.cast("long").alias("v")).repartition("k").sortWithinPartitions("k", "o")

    def fold(parts):
        now, acc = None, 0
        for part in parts:
            out = []
            for k, v in zip(part["k"].tolist(), part["v"].tolist(), strict=True):
                if k != now:
                    if now is not None:
                        out.append((now, acc))
                    now, acc = k, 0
                acc = (acc + v) // 2 if acc > 0 else v
            yield pd.DataFrame(out, columns=["k", "r"])
        if now is not None:
            yield pd.DataFrame([(now, acc)], columns=["k", "r"])

    return rows.mapInPandas(fold, f"k {kind}, r long").select(F.col("k").alias(key), F.col("r").alias("roundtrip"))


def unreliability(df: DataFrame, key: str, order: str, failed: Column) -> DataFrame:
    """+1 on failure, -1 on success, never below 0: running sum less its running minimum."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.withColumn("_s", F.sum(F.when(failed, 1).otherwise(-1)).over(w))
    rows = rows.withColumn("_m", F.least(F.min("_s").over(w), F.lit(0)))
    return rows.groupBy(key).agg(F.max_by(F.col("_s") - F.col("_m"), order).cast("long").alias("unreliability"))


def classify_ingest(df: DataFrame, order: str, start: int) -> DataFrame:
    """late, next, or hole for rows in arrival of their sequence, against the row before (start before the first)."""
    rows = last_before(df, order, F.col(order), "_p", False)
    prev = F.coalesce("_p", F.lit(start))
    return rows.withColumn("verdict", F.when(F.col(order) <= start, "late").when(F.col(order) == F.greatest(prev, F.lit(start)) + 1, "next").otherwise("hole")).drop("_p")
