"""The read API as joins: each function answers a table of requests, one row a request, so that one lookup and a million of
them are the same plan. handles: id, workchain, shard, seq_no, gen_utime, flags; entries: id, kind, data; edges: id,
direction, to_id; key_blocks: seq_no, id. Requests have a column id unless a function says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs
from . import ordered, proofs, relations, shards
from .store import BLOCK, LINK, PROOF

PAGE, SLICE, SPAN = 8, 2 << 20, 100
CAPABILITIES = (2, 1)  # version, capability bits (fixed values)


def _has(name: str) -> Column:
    return F.coalesce(codecs.flag(F.col("flags"), name), F.lit(False))


def handles_of(requests: DataFrame, handles: DataFrame) -> DataFrame:
    return requests.join(handles, "id", "left")


def connection(requests: DataFrame, edges: DataFrame, direction: str) -> DataFrame:
    """requests with to_id, null where there is no such edge."""
    return requests.join(edges.filter(F.col("direction") == direction).select("id", "to_id"), "id", "left")


def next_block_description(requests: DataFrame, edges: DataFrame) -> DataFrame:
    return connection(requests, edges, "next1")


def _variant(requests: DataFrame, handles: DataFrame, allow_partial: bool) -> DataFrame:
    rows = handles_of(requests, handles)
    return rows.withColumn("answer", proofs.proof_variant(_has("has_proof"), _has("has_proof_link"), F.lit(allow_partial)))


def prepare_block_proof(requests: DataFrame, handles: DataFrame, allow_partial: bool = True) -> DataFrame:
    return _variant(requests, handles, allow_partial).select("id", "answer")


def prepare_key_block_proof(requests: DataFrame, handles: DataFrame, allow_partial: bool = True) -> DataFrame:
    """answer is error for a block that is known and no key block."""
    rows = _variant(requests, handles, allow_partial)
    return rows.select("id", F.when(F.col("flags").isNotNull() & ~codecs.is_key(F.col("flags"), F.col("seq_no")), "error").otherwise(F.col("answer")).alias("answer"))


def prepare_block(requests: DataFrame, handles: DataFrame) -> DataFrame:
    return handles_of(requests, handles).select("id", _has("has_data").alias("found"))


def prepare_persistent_state(requests: DataFrame, snapshots: DataFrame, served: bool = True) -> DataFrame:
    """requests and snapshots: mc_seq_no, id."""
    known = snapshots.select("mc_seq_no", "id").distinct().withColumn("found", F.lit(served))
    return requests.join(known, ["mc_seq_no", "id"], "left").withColumn("found", F.coalesce("found", F.lit(False)))


def persistent_state_part(requests: DataFrame, snapshots: DataFrame) -> DataFrame:
    """requests: mc_seq_no, id, offset, max_size (at most SLICE) -> part, empty where there is nothing."""
    rows = requests.join(snapshots.select("mc_seq_no", "id", "data"), ["mc_seq_no", "id"], "left")
    ok = (F.col("max_size") <= SLICE) & (F.col("offset") < F.octet_length("data"))
    part = F.when(ok, F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("max_size").cast("int"))).otherwise(F.lit(b""))
    return rows.select("mc_seq_no", "id", "offset", F.coalesce(part, F.lit(b"")).alias("part"))


def prepare_zero_state(requests: DataFrame) -> DataFrame:
    """Zero states are not served."""
    return requests.withColumn("found", F.lit(False))


def next_key_blocks(requests: DataFrame, key_blocks: DataFrame) -> DataFrame:
    """requests: request, workchain, seq_no, id, max_size -> request, ids, incomplete, error: the key blocks from the start
    block on, that one included, at most PAGE. A start that is no masterchain block, or no key block under that id, is an error.

    Key blocks are few and each request reads at most PAGE of them, by their ranks.
    """
    rank = ordered.ranked(key_blocks.select("seq_no", "id"), "seq_no", "r")
    start = requests.join(rank.select("seq_no", F.col("id").alias("_id"), F.col("r").alias("_r")), "seq_no", "left")
    bad = (F.col("workchain") != shards.MASTERCHAIN) | F.col("_id").isNull() | (F.col("_id") != F.col("id"))
    size = F.least("max_size", F.lit(PAGE))
    start = start.withColumns({"error": bad, "_size": F.greatest(size, F.lit(0))})
    wanted = start.filter(~F.col("error") & (F.col("_size") > 0)).select("request", "_size", F.explode(F.sequence(F.col("_r"), F.col("_r") + F.col("_size") - 1)).alias("r"))
    got = wanted.join(rank.select("r", "seq_no", "id"), "r").groupBy("request").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq_no", "id"))), lambda x: x["id"]).alias("ids"))
    rows = start.select("request", "error", "max_size").join(got, "request", "left")
    ids = F.coalesce("ids", F.array().cast(got.schema["ids"].dataType))
    return rows.select("request", ids.alias("ids"), (~F.col("error") & (F.size(ids) < F.col("max_size"))).alias("incomplete"), "error")


def _payload(requests: DataFrame, handles: DataFrame, entries: DataFrame, kind: int, flag: str) -> DataFrame:
    """requests with data, null unless the handle's flag says that it is there."""
    rows = requests.join(handles.select("id", "flags", "seq_no", "workchain"), "id", "left")
    data = entries.filter(F.col("kind") == kind).select("id", "data")
    return rows.join(data, "id", "left").withColumn("data", F.when(_has(flag), F.col("data")))


def block(requests: DataFrame, handles: DataFrame, entries: DataFrame) -> DataFrame:
    """id, data, error: the block's bytes, or an error."""
    return _payload(requests, handles, entries, BLOCK, "has_data").select("id", "data", F.col("data").isNull().alias("error"))


def block_proof(requests: DataFrame, handles: DataFrame, entries: DataFrame, key_only: bool = False, link: bool = False) -> DataFrame:
    """id, data, error: the full proof's bytes, or those of the link, or an error. key_only: other blocks are errors."""
    rows = _payload(requests, handles, entries, LINK if link else PROOF, "has_proof_link" if link else "has_proof")
    data = F.when(codecs.is_key(F.col("flags"), F.col("seq_no")), F.col("data")) if key_only else F.col("data")
    return rows.select("id", data.alias("data")).withColumn("error", F.col("data").isNull())


def block_full(requests: DataFrame, handles: DataFrame, entries: DataFrame) -> DataFrame:
    """id, found, is_link, proof, data: a block with its proof (masterchain) or link, or nothing of it."""
    rows = handles_of(requests.select("id"), handles.select("id", "workchain", "flags"))
    mc = shards.is_masterchain(F.col("workchain"))
    rows = rows.withColumn("_ok", _has("has_data") & F.coalesce(codecs.proof_or_link(F.col("workchain"), _has("has_proof"), _has("has_proof_link")), F.lit(False)))
    kinds = entries.groupBy("id").agg(*[F.max(F.when(F.col("kind") == k, F.col("data"))).alias(f"_{k}") for k in (BLOCK, PROOF, LINK)])
    rows = rows.join(kinds, "id", "left")
    proof = F.when(mc, F.col(f"_{PROOF}")).otherwise(F.col(f"_{LINK}"))
    found = F.col("_ok") & F.col(f"_{BLOCK}").isNotNull() & proof.isNotNull()
    return rows.select("id", found.alias("found"), F.when(found, ~mc).alias("is_link"), F.when(found, proof).alias("proof"), F.when(found, F.col(f"_{BLOCK}")).alias("data"))


def next_block_full(requests: DataFrame, edges: DataFrame, handles: DataFrame, entries: DataFrame) -> DataFrame:
    """id, next_id, found, is_link, proof, data: the same of the block after id."""
    after = connection(requests.select("id"), edges, "next1").withColumnRenamed("id", "_from")
    full = block_full(after.filter("to_id is not null").select(F.col("to_id").alias("id")).distinct(), handles, entries)
    rows = after.join(full, F.col("to_id") == F.col("id"), "left").drop("id")
    return rows.select(F.col("_from").alias("id"), F.when(F.col("found"), F.col("to_id")).alias("next_id"), F.coalesce("found", F.lit(False)).alias("found"), "is_link", "proof", "data")


def archive_info(requests: DataFrame, archives: DataFrame, last_mc: int, last_shards: int) -> DataFrame:
    """requests: seq_no -> archive_id, null past either offset or where no archive starts less than SPAN before."""
    known = archives.select(F.col("archive_id").alias("seq_no")).distinct().withColumn("_a", F.col("seq_no"))
    asked = requests.select("seq_no").distinct().withColumn("_a", F.lit(None).cast("long"))
    rows = ordered.last_before(asked.withColumn("_q", F.lit(1)).unionByName(known.withColumn("_q", F.lit(0))), "seq_no", F.col("_a"), "archive_id", True, tie="_q")
    found = rows.filter("_q = 1").select("seq_no", F.when((F.col("seq_no") < F.col("archive_id") + SPAN) & (F.col("seq_no") <= min(last_mc, last_shards)), F.col("archive_id")).alias("archive_id"))
    return requests.join(found, "seq_no")


def archive_slice(requests: DataFrame, archives: DataFrame) -> DataFrame:
    """requests: archive_id, offset, max_size -> data, error. archives: archive_id, data (merged). An offset at or past the end is an error."""
    rows = requests.join(archives.select("archive_id", "data"), "archive_id", "left")
    ok = F.coalesce(F.col("offset") < F.octet_length("data"), F.lit(False))
    return rows.select("archive_id", "offset", F.when(ok, F.substring(F.col("data"), (F.col("offset") + 1).cast("int"), F.col("max_size").cast("int"))).alias("data"), (~ok).alias("error"))


def capabilities(requests: DataFrame) -> DataFrame:
    return requests.withColumns({"version": F.lit(CAPABILITIES[0]), "capabilities": F.lit(CAPABILITIES[1])})


def is_synced(last_mc: Column, client: Column, last_mc_utime: Column, now: Column, behind: int = 32, seconds: int = 600) -> Column:
    """At most behind masterchain blocks between the offsets, and the last of them younger than seconds."""
    return (client + behind >= last_mc) & (last_mc_utime + seconds > now)


def last_applied(last_mc: Column, client: Column) -> Column:
    return F.least(last_mc, client)


def key_handles(key_blocks: DataFrame, handles: DataFrame) -> DataFrame:
    """Handles of all key blocks; a key block without one is an error in the result's first action."""
    rows = key_blocks.select("seq_no", "id").join(handles.drop("seq_no"), "id", "left")
    return rows.withColumn("flags", F.when(F.col("flags").isNull(), F.raise_error(F.lit("a key block without a handle")).cast("long")).otherwise(F.col("flags")))


def page_of(rows: DataFrame, seq: str, start: int, limit: int, forward: bool = True) -> DataFrame:
    """Rows from start on, or back from it, in that order."""
    if forward:
        return relations.key_page(rows, seq, start, limit)
    return rows.filter(F.col(seq) <= start).orderBy(F.desc(seq)).limit(limit)


def choose_key_block(key_blocks: DataFrame, now: int, age: int = 300, bits: int = ordered.PERSISTENT_BITS) -> DataFrame:
    """The newest key block (seq_no, gen_utime) that is persistent and at least age seconds old. The first of all counts as persistent."""
    first = key_blocks.orderBy("seq_no").limit(1).select("seq_no", "gen_utime")
    rows = ordered.persistent_boundaries(key_blocks.select("seq_no", "gen_utime"), bits).select("seq_no", "gen_utime").unionByName(first)
    return rows.filter(F.col("gen_utime") + age <= now).orderBy(F.desc("seq_no")).limit(1)


def closest_proof(blocks: DataFrame, order: str = "seq_no") -> DataFrame:
    """Each block with the one after it along next1, for walks along the chain."""
    return blocks.withColumn("next_seq", F.lead(order).over(Window.partitionBy("workchain", "shard").orderBy(order)))
