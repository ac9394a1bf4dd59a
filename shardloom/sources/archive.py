"""Archive packages: a header, then frames of name and data; and the refcount value codec.

Layout (fixed values): magic 0x ae8fdd01 little-endian; each frame has magic 0x1e8b, name length (2 bytes), data length
(4 bytes), all little-endian, then name and data. Zero-length data is allowed, a truncated tail is an error in strict mode.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs
from ..shipping import ship

ARCHIVE_MAGIC, ENTRY_MAGIC = 0xAE8FDD01, 0x1E8B


class ArchiveError(ValueError):
    pass


def frame(name: str, data: bytes) -> bytes:
    n = name.encode()
    return struct.pack("<HHI", ENTRY_MAGIC, len(n), len(data)) + n + data


def package(entries: list[tuple[str, bytes]]) -> bytes:
    return struct.pack("<I", ARCHIVE_MAGIC) + b"".join(frame(n, d) for n, d in entries)


def entries(blob: bytes, strict: bool = True) -> Iterator[tuple[int, str, bytes]]:
    """(ordinal, name, data). Lenient reading ends silently at a tail shorter than a frame's head."""
    if len(blob) < 4 or struct.unpack_from("<I", blob)[0] != ARCHIVE_MAGIC:
        raise ArchiveError("invalid archive header")
    at, i = 4, 0
    while at < len(blob):
        if len(blob) - at < 8:
            if strict:
                raise ArchiveError("truncated frame head")
            return
        magic, n, m = struct.unpack_from("<HHI", blob, at)
        if magic != ENTRY_MAGIC:
            raise ArchiveError("invalid frame magic")
        if at + 8 + n + m > len(blob):
            raise ArchiveError("truncated frame")
        yield i, blob[at + 8 : at + 8 + n].decode(), blob[at + 8 + n : at + 8 + n + m]
        at, i = at + 8 + n + m, i + 1


def is_whole(blob: bytes) -> bool:
    try:
        return all(True for _ in entries(blob))
    except ArchiveError:
        return False


def read_archives(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """path (a folder or glob of package files) -> path, ordinal, name, data."""
    return parse_archives(spark.read.format("binaryFile").load(path).select("path", "content"), "path", "content", strict)


def parse_archives(df: DataFrame, id_col: str, data_col: str, strict: bool = True) -> DataFrame:
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for key, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = list(entries(blob, strict))
                cols = [[key] * len(rows), [r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows]]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema.types[0]), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.binary())], [id_col, "ordinal", "name", "data"])

    ship(df.sparkSession)
    return df.select(id_col, data_col).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, ordinal int, name string, data binary")


class Verifier:
    """Checks an archive that comes in pieces cut anywhere. It holds no more than a frame's head of them."""

    def __init__(self):
        self.held, self.skip, self.want, self.frames = b"", 0, 4, 0

    def feed(self, piece: bytes) -> None:
        at = 0
        while at < len(piece):
            if self.skip:
                step = min(self.skip, len(piece) - at)
                self.skip, at = self.skip - step, at + step
                continue
            step = min(self.want - len(self.held), len(piece) - at)
            self.held, at = self.held + piece[at : at + step], at + step
            if len(self.held) < self.want:
                return
            if self.want == 4:
                if struct.unpack("<I", self.held)[0] != ARCHIVE_MAGIC:
                    raise ArchiveError("invalid archive header")
            else:
                magic, n, m = struct.unpack("<HHI", self.held)
                if magic != ENTRY_MAGIC:
                    raise ArchiveError("invalid frame magic")
                self.skip, self.frames = n + m, self.frames + 1
            self.held, self.want = b"", 8

    def finish(self) -> int:
        """Number of frames of a whole archive; a cut one is an error, one whose last data are empty is not."""
        if self.held or self.skip or self.want == 4:
            raise ArchiveError("truncated archive")
        return self.frames


def block_maps(entries_of: DataFrame, key: str) -> DataFrame:
    """Entries (key, name, data) of archives -> key, workchain, shard, seq, root, file, block, proof, is_link: one row a block.

    Names that aren't a block's, full proofs outside the masterchain and links inside it are passed over. A block without
    its proof, or a proof without its block, has a null there.
    """
    x = entries_of.select(key, codecs.parse_file_name(F.col("name")).alias("x"), "data").select(key, "x.*", "data")
    mc = F.col("workchain") == -1
    kept = x.filter((F.col("kind") == "block") | (F.col("kind") == "proof") & mc | (F.col("kind") == "prooflink") & ~mc)
    of = lambda cond: F.max(F.when(cond, F.col("data")))
    pairs = kept.groupBy(key, "workchain", "shard", "seq", "root", "file").agg(of(F.col("kind") == "block").alias("block"), of(F.col("kind") != "block").alias("proof"))
    return pairs.withColumn("is_link", F.col("workchain") != -1)


def build_archives(df: DataFrame, group: str, order: str, name: str, data: str) -> DataFrame:
    """One package a group, in order; frames are built and joined as binaries by column expressions."""
    n, d = F.col(name).cast("binary"), F.col(data).cast("binary")
    one = F.concat(F.unhex(F.lit(struct.pack("<H", ENTRY_MAGIC).hex())), codecs.packed(F.octet_length(n), 2, False), codecs.packed(F.octet_length(d), 4, False), n, d)
    rows = df.select(F.col(group).alias(group), F.col(order).alias("_o"), one.alias("_f"))
    head = F.unhex(F.lit(struct.pack("<I", ARCHIVE_MAGIC).hex()))
    return rows.groupBy(group).agg(F.concat(head, F.expr("listagg(_f) within group (order by _o)")).alias("content"))


def merge_segments(segments: DataFrame, key: str = "archive_id", order: str = "segment_no", data: str = "data") -> DataFrame:
    """Segments of archives in order, joined as binaries; the archive's head stays on the first of them only."""
    head = F.unhex(F.lit(struct.pack("<I", ARCHIVE_MAGIC).hex()))
    bare = F.when(F.substring(F.col(data), 1, 4) == head, F.expr(f"substring(`{data}`, 5)")).otherwise(F.col(data))
    rows = segments.select(key, F.col(order).alias("_o"), bare.alias("_d"))
    return rows.groupBy(key).agg(F.concat(head, F.expr("listagg(_d) within group (order by _o)")).alias("data"))


def decode_rc(raw: bytes) -> tuple[int, bytes | None]:
    """(count, payload) of a stored value: a little-endian signed count, then the payload; shorter than 8 bytes is nothing."""
    if len(raw) < 8:
        return 0, None
    rc = struct.unpack_from("<q", raw)[0]
    return rc, (raw[8:] if rc > 0 else None)
