"""Column codecs: block flags, package file names, shard prefixes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Bits above the 32 of the reference sequence number, and file name prefixes by kind.
FLAGS = ("has_data", "has_proof", "has_proof_link", "reserved", "has_state", "has_persistent_state", "has_next1", "has_next2", "has_prev1", "has_prev2", "is_applied", "is_key_block", "moving_to_archive", "moved_to_archive")
KINDS = ("block", "proof", "prooflink")
CLEAR_DATA = ("has_data", "has_proof", "has_proof_link")
BASE = 32


def pack_flags(ref_seq: Column, flags: dict[str, Column]) -> Column:
    """Reference sequence number in the low half, a bit for each true flag above."""
    out = ref_seq.cast("long").bitwiseAND(F.lit((1 << BASE) - 1))
    for name, on in flags.items():
        out = out.bitwiseOR(F.when(on, F.lit(1 << (BASE + FLAGS.index(name)))).otherwise(F.lit(0)).cast("long"))
    return out


def flag(packed: Column, name: str) -> Column:
    return F.shiftright(packed, BASE + FLAGS.index(name)).bitwiseAND(F.lit(1)) == 1


def ref_seq(packed: Column) -> Column:
    return packed.bitwiseAND(F.lit((1 << BASE) - 1))


def clear_data(packed: Column) -> Column:
    mask = sum(1 << (BASE + FLAGS.index(f)) for f in CLEAR_DATA)
    return packed.bitwiseAND(F.lit(~mask))


def file_name(kind: Column, workchain: Column, shard: Column, seq: Column, root: Column, file: Column) -> Column:
    """kind_(workchain,shard as 16 hex digits,seq):ROOT:FILE; root and file are hex strings."""
    return F.concat(kind, F.lit("_("), workchain.cast("string"), F.lit(","), F.lower(F.lpad(F.hex(shard), 16, "0")), F.lit(","), seq.cast("string"), F.lit("):"), F.upper(root), F.lit(":"), F.upper(file))


FILE_NAME = r"^(block|proof|prooflink)_\((-?[0-9]+),([0-9a-f]{16}),([0-9]+)\):([0-9A-F]{64}):([0-9A-F]{64})$"


def parse_file_name(name: Column) -> Column:
    """Struct of the parts, or null where the name isn't well formed."""
    part = lambda i: F.regexp_extract(name, FILE_NAME, i)
    # Sixteen hex digits are a bit pattern: halves are put together so that patterns of 2^63 and above wrap.
    half = lambda s: F.conv(s, 16, 10).cast("long")
    shard = F.shiftleft(half(F.substring(part(3), 1, 8)), 32).bitwiseOR(half(F.substring(part(3), 9, 8)))
    parsed = F.struct(part(1).alias("kind"), part(2).cast("int").alias("workchain"), shard.alias("shard"), part(4).cast("long").alias("seq"), F.lower(part(5)).alias("root"), F.lower(part(6)).alias("file"))
    return F.when(name.rlike(FILE_NAME), parsed)


def prefix(value: Column, bits: int) -> Column:
    """The low bits of a number as a string of 0 and 1."""
    return F.lpad(F.bin(value.bitwiseAND(F.lit((1 << bits) - 1))), bits, "0")


def overlaps(a: Column, b: Column) -> Column:
    """Shards intersect if one prefix starts the other."""
    return a.startswith(b) | b.startswith(a)


def parent(p: Column) -> Column:
    """The shard that p came from by a split; '' has none and stays as it is."""
    return F.left(p, F.greatest(F.length(p) - 1, F.lit(0)))


def is_right_child(p: Column) -> Column:
    return p.endswith("1")


def is_ancestor(a: Column, p: Column) -> Column:
    """Strictly: a shard isn't its own ancestor."""
    return p.startswith(a) & (F.length(a) < F.length(p))


def shard_id(p: Column) -> Column:
    """A prefix as the 64-bit pattern: its bits, a one, zeros."""
    bits = F.rpad(F.concat(p, F.lit("1")), 64, "0")
    half = lambda at: F.conv(F.substring(bits, at, 32), 2, 10).cast("long")
    return F.shiftleft(half(1), 32).bitwiseOR(half(33))


def shard_prefix(id_: Column) -> Column:
    """The prefix of a 64-bit pattern; null for zero, which is none."""
    bits = F.lpad(F.bin(id_), 64, "0")
    return F.when(id_ != 0, F.regexp_extract(bits, "^([01]*)10*$", 1))


def children(p: Column) -> Column:
    return F.array(F.concat(p, F.lit("0")), F.concat(p, F.lit("1")))


def unsigned(b: Column, at: int, n: int, big_endian: bool = True) -> Column:
    """n bytes of a binary from at (0 first) as a number, two's complement in a long where n is 8."""
    part = F.substring(b, at + 1, n)
    digits = F.hex(part) if big_endian else F.concat(*[F.substring(F.hex(part), 2 * i + 1, 2) for i in reversed(range(n))])
    if n < 8:
        return F.conv(digits, 16, 10).cast("long")
    half = lambda x: F.conv(x, 16, 10).cast("long")
    return F.shiftleft(half(F.substring(digits, 1, 8)), 32).bitwiseOR(half(F.substring(digits, 9, 8)))


def signed32(b: Column, at: int, big_endian: bool = True) -> Column:
    x = unsigned(b, at, 4, big_endian)
    return F.when(x >= 1 << 31, x - (1 << 32)).otherwise(x).cast("int")


def packed(value: Column, n: int, big_endian: bool = True) -> Column:
    """The low n bytes of a number as a binary."""
    digits = F.right(F.lpad(F.hex(value.cast("long")), 16, "0"), F.lit(2 * n))
    return F.unhex(digits if big_endian else F.concat(*[F.substring(digits, 2 * i + 1, 2) for i in reversed(range(n))]))


def entry_key(workchain: Column, shard: Column, seq: Column, root: Column, kind: Column) -> Column:
    """Key of a package entry, 49 bytes: workchain, shard, number, root hash (big-endian, so bytes sort as numbers), kind."""
    return F.concat(packed(workchain, 4), packed(shard, 8), packed(seq, 4), root, packed(kind, 1))


def id_to_bytes(workchain: Column, shard: Column, seq: Column, root: Column, file: Column) -> Column:
    """A block id as 80 bytes, numbers little-endian."""
    return F.concat(packed(workchain, 4, False), packed(shard, 8, False), packed(seq, 4, False), root, file)


def id_from_bytes(b: Column) -> Column:
    """The inverse; null for another length than 80."""
    parts = F.struct(signed32(b, 0, False).alias("workchain"), unsigned(b, 4, 8, False).alias("shard"), unsigned(b, 12, 4, False).alias("seq"), F.substring(b, 17, 32).alias("root"), F.substring(b, 49, 32).alias("file"))
    return F.when(F.octet_length(b) == 80, parts)


def short_name(workchain: Column, shard: Column, seq: Column) -> Column:
    """workchain:shard as 16 hex digits:number."""
    return F.concat(workchain.cast("string"), F.lit(":"), F.lower(F.lpad(F.hex(shard), 16, "0")), F.lit(":"), seq.cast("string"))


def bytes_to_fit(x: Column) -> Column:
    """Bytes that a number takes at least; none for 0."""
    return F.when(x == 0, 0).otherwise(F.ceil(F.length(F.bin(x)) / 8)).cast("int")


def fixed_base64(text: Column, n: int) -> Column:
    """A binary of n bytes from base64, null where it isn't that."""
    b = F.try_to_binary(text, F.lit("base64"))
    return F.when(F.octet_length(b) == n, b)


def fixed_hex(text: Column, n: int) -> Column:
    b = F.try_to_binary(text, F.lit("hex"))
    return F.when((F.octet_length(b) == n) & (F.length(text) == 2 * n), b)


def upload_key(archive_id: Column) -> Column:
    """Name of an uploaded archive: nine digits."""
    return F.lpad(archive_id.cast("string"), 9, "0")


def upload_digest(data: Column) -> Column:
    return F.base64(F.unhex(F.md5(data)))


def aligned(t: Column, every: int, offset: int = 0) -> Column:
    return t - F.pmod(t, F.lit(every)) + offset


def less(a: Column, b: Column) -> Column:
    """a - b, not below 0."""
    return F.greatest(a - b, F.lit(0))


def human_size(n: Column) -> Column:
    """For display: bytes in the largest of B, KiB to TiB that leaves at least 1, two decimals."""
    out = F.concat(n.cast("string"), F.lit(" B"))
    for i, unit in enumerate(("KiB", "MiB", "GiB", "TiB"), 1):
        out = F.when(n >= 1 << (10 * i), F.concat(F.format_number(n / float(1 << (10 * i)), 2), F.lit(" " + unit))).otherwise(out)
    return out


def proof_or_link(workchain: Column, has_proof: Column, has_link: Column) -> Column:
    return F.when(workchain == -1, has_proof).otherwise(has_link)


def master_ref(workchain: Column, seq: Column, ref: Column) -> Column:
    """The masterchain block that a block belongs to: itself in the masterchain, else the stored reference."""
    return F.when(workchain == -1, seq).otherwise(ref)


def is_key(packed_flags: Column, seq: Column) -> Column:
    """Whether a handle is a key block's; block 0 always is."""
    return flag(packed_flags, "is_key_block") | (seq == 0)
