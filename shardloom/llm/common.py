"""Shared pieces: table access, lineage cuts on the shared checkpoint folder, text blocks."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shipping import ship

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
WORD = r"[^\x20\x09-\x0D]+"
BLOCK_BYTES = 1 << 20


#: Bytes of an Arrow batch at most. Rows are whole texts, and a task holds a batch several times over, in the JVM and in
#: its Python worker; Spark's own bound of 64 MB is too much for that.
ARROW_BYTES = 4 << 20
_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows that a Parquet reader decodes at once. Its buffers are single arrays, which grow by doubling to hold that many texts.
READ_ROWS = 512
_ROWS_CONF = "spark.sql.parquet.columnarReaderBatchSize"


def ready(spark: SparkSession) -> None:
    """Make the session fit for Python code over texts: the package on every worker, short batches of Parquet and Arrow."""
    ship(spark)
    if int(spark.conf.get(_ROWS_CONF)) > READ_ROWS:
        spark.conf.set(_ROWS_CONF, str(READ_ROWS))
    now = spark.conf.get(_BYTES_CONF).removesuffix("b")
    if not now.isdigit() or int(now) > ARROW_BYTES:
        spark.conf.set(_BYTES_CONF, str(ARROW_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where it is unset, a temporary one on a local master, which has one machine; else an error."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        found = "file://" + os.path.join(tempfile.gettempdir(), "shardloom-checkpoints")
    return found.rstrip("/")


def cut(df: DataFrame, name: str = "cut") -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends there, any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/shardloom/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows of a narrow table (an id and a number or two) that may be broadcast; with more, the join is shuffled.
BROADCAST_ROWS = 1_000_000


def sized(small: DataFrame) -> DataFrame:
    """small, marked for broadcast if it has at most BROADCAST_ROWS rows. It is counted, so it should be cut already."""
    return F.broadcast(small) if small.count() <= BROADCAST_ROWS else small


def fresh(names, base: str) -> str:
    """A column name that is none of names, whatever their case."""
    taken = {n.lower() for n in names}
    while base.lower() in taken:
        base = "_" + base
    return base


def whole_number(df: DataFrame, col: str) -> Column:
    """A column of whole numbers as long; other kinds of ids are an error at once, not in the middle of a job."""
    kind = df.schema[col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError(f"{col} is {kind}; ids are whole numbers here")
    return F.col(f"`{col}`").cast("long")


def keep_ids(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Rows of docs whose id is among ids (one column); null equals null."""
    own = fresh(docs.columns, "_id")
    ids = sized(cut(ids.toDF(own).distinct(), "ids"))
    return docs.join(ids, F.col(f"`{id_col}`").eqNullSafe(F.col(own)), "left_semi")


def lower_ascii(text: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(text: Column) -> Column:
    """128 bits of xxhash64 under two seeds, as 32 hex digits."""
    return F.concat(*[F.lower(F.lpad(F.hex(F.xxhash64(F.lit(seed), text)), 16, "0")) for seed in (1, 2)])


def blocks(sizes, limit: int = BLOCK_BYTES):
    """Ranges of rows whose sizes sum to about limit; a larger row stands alone."""
    start, total = 0, 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
