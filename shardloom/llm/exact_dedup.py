"""Exact dedup by an extendible-hash index kept on shared files, in DataFrame operations only.

A text's key is the 64-bit hash of its normal form. The directory has a slot for each value of the key's first bits and
says how many of them the slot's bucket goes by. It starts as one bucket; a bucket whose texts hold more bytes than its
capacity splits in two, and the directory doubles where that bucket already used all of its bits. Each bucket has one
owner task: all its texts go there, are grouped by key and chained by their bytes, so texts that only share a key become
separate links of its chain. A key with more bytes of copies than a bucket holds is dealt out over several owners first,
whose counts are added up after their bytes have been compared. The index is written by owner, in order of bucket and
key, beside its directory; it can be opened again, looked up, and extended by further documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, fresh, lower_ascii, shared_dir, sized

#: Bytes of text that a bucket holds. With more than BUCKETS times that in all, buckets hold accordingly more, so the
#: directory stays small enough to send to every task.
CAPACITY = 4 << 20
BUCKETS = 1 << 19
#: Bits that the directory goes by at most. With evenly spread keys it ends far before.
MOST_BITS = 21


def _prefix(h: Column, depth: int) -> Column:
    return F.shiftrightunsigned(h, 64 - depth) if depth else F.lit(0).cast("long")


def _shift(col: str, by: Column) -> Column:
    return F.call_function("shiftright", F.col(col), by.cast("int"))


def _norm(text_col: str) -> Column:
    return lower_ascii(F.coalesce(F.col(f"`{text_col}`"), F.lit("")))


class Directory:
    """bits: how many of a key's first bits name a slot; slots: slot -> depth, the bits that the slot's bucket goes by."""

    def __init__(self, bits: int, slots: DataFrame):
        self.bits, self.slots = bits, slots

    @classmethod
    def build(cls, keys: DataFrame, capacity: int = CAPACITY, start: Directory | None = None) -> Directory:
        """keys: h, load (bytes, at most a bucket's) of every different key. start: a directory to go on from."""
        spark = keys.sparkSession
        capacity = max(capacity, (keys.agg(F.sum("load")).first()[0] or 0) // BUCKETS)
        cells = cut(keys.groupBy(_prefix(F.col("h"), MOST_BITS).alias("cell")).agg(F.sum("load").alias("load"), F.count("*").alias("n")), "cells")
        bits, slots = (start.bits, start.slots) if start else (0, spark.range(1).select(F.col("id").alias("slot"), F.lit(0).alias("depth")))
        while True:
            # A slot's cells; loads go to the slot's bucket, which is the slot without the bits that it doesn't go by.
            in_slot = cells.groupBy(F.shiftright("cell", MOST_BITS - bits).alias("slot")).agg(F.sum("load").alias("load"), F.sum("n").alias("n"))
            bucket = _shift("slot", F.lit(bits) - F.col("depth")).alias("bucket")
            loads = slots.join(in_slot, "slot", "left").groupBy("depth", bucket).agg(F.sum("load").alias("load"), F.sum("n").alias("n"))
            over = cut(loads.filter((F.col("load") > capacity) & (F.col("n") > 1) & (F.col("depth") < MOST_BITS)).select("depth", "bucket"), "overfull")
            if over.isEmpty():
                return cls(bits, slots)
            if not over.filter(F.col("depth") == bits).isEmpty():
                slots = slots.select(F.explode(F.array(F.col("slot") * 2, F.col("slot") * 2 + 1)).alias("slot"), "depth")
                bits += 1
            own = slots.withColumn("bucket", _shift("slot", F.lit(bits) - F.col("depth")))
            split = own.join(over.withColumn("more", F.lit(1)), ["depth", "bucket"], "left")
            slots = cut(split.select("slot", (F.col("depth") + F.coalesce("more", F.lit(0))).cast("int").alias("depth")), "directory")

    def assign(self, df: DataFrame, h: str = "h") -> DataFrame:
        """Adds depth and prefix: the bucket of each row's key."""
        slots = F.broadcast(self.slots.withColumnRenamed("slot", "_slot"))
        rows = df.withColumn("_slot", _prefix(F.col(h), self.bits)).join(slots, "_slot")
        return rows.withColumn("prefix", _shift("_slot", F.lit(self.bits) - F.col("depth"))).drop("_slot")


def _chained(owned: DataFrame) -> DataFrame:
    """depth, prefix, h, sha, keep_id, group_size, by owner -> also link, which numbers the different texts of a key."""
    sums = owned.groupBy("depth", "prefix", "h", "sha").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    chain = Window.partitionBy("depth", "prefix", "h").orderBy("sha")
    return sums.withColumn("link", F.row_number().over(chain) - 1)


class Index:
    """An index on shared files: entries (depth, prefix, h, sha, keep_id, group_size, link) and the directory."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        head = spark.read.json(f"{path}/head").first()
        self.capacity, self.entries = head["capacity"], spark.read.parquet(f"{path}/entries")
        self.directory = Directory(head["bits"], spark.read.parquet(f"{path}/slots"))

    @classmethod
    def write(cls, entries: DataFrame, directory: Directory, capacity: int, path: str | None = None) -> Index:
        spark = entries.sparkSession
        path = path or f"{shared_dir(spark)}/shardloom/index-{uuid.uuid4().hex}"
        entries.repartition("depth", "prefix").sortWithinPartitions("depth", "prefix", "h", "link").write.parquet(f"{path}/entries")
        directory.slots.coalesce(1).write.parquet(f"{path}/slots")
        spark.range(1).coalesce(1).select(F.lit(capacity).cast("long").alias("capacity"), F.lit(directory.bits).alias("bits")).write.json(f"{path}/head")
        return cls(spark, path)

    def lookup(self, keys: DataFrame) -> DataFrame:
        """keys with h and sha -> the same with keep_id, group_size, link. Bucket by bucket, so an owner's files meet its keys."""
        return self.directory.assign(keys).join(self.entries, ["depth", "prefix", "h", "sha"]).drop("depth", "prefix")

    def extend(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Index:
        """A further version of the index with the texts of docs too; buckets that they overfill split.

        Texts of the earlier versions aren't kept, so old and new ones are held against each other by key and SHA-256.
        """
        _, keys, texts = _scanned(docs, id_col, text_col)
        old = self.entries.groupBy("h").agg(F.count("*").alias("load"))
        loads = keys.join(old.withColumnRenamed("load", "had"), "h", "full").select("h", F.least(F.coalesce("load", F.lit(0)) + F.coalesce("had", F.lit(0)), F.lit(self.capacity)).alias("load"))
        directory = Directory.build(cut(loads, "loads"), self.capacity, self.directory)
        new = _owned(texts, keys, directory, self.capacity)
        had = directory.assign(self.entries.select("h", "sha", "keep_id", "group_size"))
        return Index.write(_chained(had.unionByName(new)), directory, self.capacity, path)


def _scanned(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, h, sha, bytes) of every row, (h, load, n) of every key, and the rows with their texts."""
    texts = docs.select(F.col(f"`{id_col}`").alias("id"), _norm(text_col).alias("norm")).withColumn("h", F.xxhash64("norm"))
    rows = cut(texts.select("id", "h", F.sha2("norm", 256).alias("sha"), F.octet_length("norm").cast("long").alias("bytes")), "rows")
    keys = cut(rows.groupBy("h").agg((F.sum("bytes") + F.count("*")).alias("load")), "keys")
    return rows, keys, texts


def _owned(texts: DataFrame, keys: DataFrame, directory: Directory, capacity: int) -> DataFrame:
    """Each different text of each bucket, as its owners find it: depth, prefix, h, sha, keep_id, group_size.

    A key with more bytes than a bucket has as many owners as it fills buckets; their rows are still to be added up.
    """
    hot = cut(keys.filter(F.col("load") > capacity).select("h", F.ceil(F.col("load") / capacity).alias("owners")), "hot")
    rows, owner = directory.assign(texts), ["depth", "prefix"]
    if not hot.isEmpty():
        share = F.pmod(F.xxhash64("id", F.lit(3)), F.col("owners"))
        rows, owner = rows.join(sized(hot), "h", "left").withColumn("share", F.coalesce(share, F.lit(0))), [*owner, "share"]
    rows = rows.select(*owner, "h", "norm", "id").repartition(*owner)
    found = rows.groupBy(*owner, "h", "norm").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    return found.select("depth", "prefix", "h", F.sha2("norm", 256).alias("sha"), "keep_id", "group_size")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """id, keep_id, group_size, kept, text_sha256 for every row.

    Null text counts as empty. Of equal texts the row with the largest id stays. Rows that repeat an id with an
    equal text are all marked alike (a repeated largest id is kept as often as it occurs); a null id is kept only
    where its whole group has null ids. An empty table gives no rows; other columns are ignored.
    """
    rows, keys, texts = _scanned(docs, id_col, text_col)
    directory = Directory.build(keys.select("h", F.least("load", F.lit(capacity)).alias("load")), capacity)
    index = Index.write(_chained(_owned(texts, keys, directory, capacity)), directory, capacity)
    joined = index.lookup(rows.select("id", "h", "sha"))
    return joined.select(
        F.col("id").alias(id_col), "keep_id", "group_size",
        (F.col("id").eqNullSafe(F.col("keep_id"))).alias("kept"), F.col("sha").alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the copies, all columns kept; of rows that repeat the kept id with an equal text one stays.

    Rows are told apart by id and text: what shares an id, or has none, but differs in text is judged by its own group.
    """
    own = fresh(docs.columns, "_own")
    id_, sha = fresh([*docs.columns, own], "_id"), fresh([*docs.columns, own], "_sha")
    kept = exact_groups(docs, id_col, text_col).filter("kept").select(F.col(f"`{id_col}`").alias(id_), F.unhex("text_sha256").alias(sha))
    pairs = cut(kept.groupBy(id_, sha).count(), "pairs")
    rows = docs.withColumn(own, F.unhex(F.sha2(_norm(text_col), 256)))
    found = rows.join(sized(pairs.select(id_, sha)), F.col(f"`{id_col}`").eqNullSafe(F.col(id_)) & (F.col(own) == F.col(sha)), "left_semi")
    return (found if pairs.filter("count > 1").isEmpty() else found.dropDuplicates([id_col, own])).drop(own)
