"""Checks of headers and proofs as columns: every row keeps the names of what is wrong with it, so that a caller can split a
table into rows that pass and rows to set aside, in one pass over it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASTERCHAIN = -1
#: Configuration parameters that a key block must have (fixed values): the validators; those that must be readable.
VALIDATORS, READABLE = 34, (28, *range(32, 39))


def _faults(**checks: Column) -> Column:
    """Names of the checks that are true; null counts as false."""
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for name, c in checks.items()]))


def header_faults(headers: DataFrame) -> DataFrame:
    """headers with seq_no, id_seq_no, workchain, shard, after_split, after_merge, is_key, prev_key_seq -> also faults."""
    mc = F.col("workchain") == MASTERCHAIN
    return headers.withColumn(
        "faults",
        _faults(
            seq_no=F.col("seq_no") != F.col("id_seq_no"), split_and_merge=F.col("after_split") & F.col("after_merge"), split_of_full=F.col("after_split") & (F.col("shard") == ""),
            masterchain_split=mc & (F.col("after_split") | F.col("after_merge")), key_outside_masterchain=F.col("is_key") & ~mc, prev_key=(F.col("prev_key_seq") >= F.col("seq_no")) & (F.col("seq_no") > 0),
        ),
    )


def key_faults(blocks: DataFrame, params: str = "params") -> DataFrame:
    """Key blocks with a map of configuration parameters -> also faults: parameters that are missing or empty."""
    missing = lambda i: F.coalesce(F.octet_length(F.col(params)[i]) == 0, F.lit(True))
    return blocks.withColumn("faults", _faults(**{f"parameter_{i}": missing(i) for i in sorted({VALIDATORS, *READABLE})}))


def prev_key_faults(proofs: DataFrame, keys: DataFrame) -> DataFrame:
    """proofs (seq_no, prev_key_seq) held against the blocks they name (keys: seq_no, is_key) -> also prev_key, fault.

    The named block must be known, a key block, and stand before the proof's own.
    """
    named = keys.select(F.col("seq_no").alias("prev_key"), F.col("is_key").alias("_is_key"))
    rows = proofs.drop("is_key").join(named, F.col("prev_key_seq") == F.col("prev_key"), "left")
    fault = F.when(F.col("prev_key_seq").isNull(), "undeclared").when(F.col("prev_key").isNull(), "missing").when(~F.col("_is_key"), "not_key").when(F.col("prev_key") >= F.col("seq_no"), "order")
    return rows.withColumn("fault", fault).drop("_is_key")


def within_state(prev_key: Column, state_seq: Column, seq: Column) -> Column:
    """A given state can judge a block if it is no older than the block's key block and no newer than the block."""
    return state_seq.between(prev_key, seq)


def proof_variant(has_proof: Column, has_link: Column, allow_link: Column) -> Column:
    """Which proof can be served: full, a link where that is allowed, else empty."""
    return F.when(has_proof, "full").when(has_link & allow_link, "link").otherwise("empty")


def proof_faults(proofs: DataFrame) -> DataFrame:
    """proofs with id, proof_for, workchain, is_link, root_hash, virtual_hash -> also faults."""
    outside = F.col("workchain") != MASTERCHAIN
    return proofs.withColumn("faults", _faults(other_block=F.col("id") != F.col("proof_for"), full_proof_of_shard=outside & ~F.col("is_link"), root_hash=F.col("virtual_hash") != F.col("root_hash")))


def accepted(rows: DataFrame, hard_forks: DataFrame, id_col: str = "id") -> DataFrame:
    """rows with ok -> ok also where the id is a listed hard fork. The list is configuration and short."""
    listed = F.broadcast(hard_forks.select(F.col(id_col)).distinct().withColumn("_listed", F.lit(True)))
    return rows.join(listed, id_col, "left").withColumn("ok", F.col("ok") | F.coalesce("_listed", F.lit(False))).drop("_listed")


def stuff_faults(states: DataFrame) -> DataFrame:
    """States with shard, seq_no and those of the id they were stored under -> also faults."""
    return states.withColumn("faults", _faults(shard=F.col("shard") != F.col("id_shard"), seq_no=F.col("seq_no") != F.col("id_seq_no")))


def content_faults(blocks: DataFrame, data: str = "data", file_hash: str = "file_hash") -> DataFrame:
    """Blocks whose bytes must have the SHA-256 of their id -> also faults."""
    return blocks.withColumn("faults", _faults(file_hash=F.unhex(F.sha2(data, 256)) != F.col(file_hash), no_data=F.col(data).isNull()))


def broadcast_faults(broadcasts: DataFrame, validators: DataFrame, signatures: DataFrame) -> DataFrame:
    """broadcasts: id, set_hash; validators: set_hash, key, weight; signatures: id, key, valid -> id, fault.

    The named set must be known, no signature of a member invalid, and the signers' weight more than two thirds.
    """
    total = validators.groupBy("set_hash").agg(F.sum(F.col("weight").cast("decimal(28,0)")).alias("_all"))
    signed = signatures.join(broadcasts.select("id", "set_hash"), "id").join(validators, ["set_hash", "key"])
    signed = signed.dropDuplicates(["id", "key", "valid"]).groupBy("id").agg(F.sum(F.when(F.col("valid"), F.col("weight").cast("decimal(28,0)"))).alias("_signed"), F.bool_and("valid").alias("_valid"))
    rows = broadcasts.join(total, "set_hash", "left").join(signed, "id", "left")
    fault = F.when(F.col("_all").isNull(), "unknown_set").when(~F.coalesce("_valid", F.lit(True)), "bad_signature").when(F.coalesce("_signed", F.lit(0)) * 3 <= F.col("_all") * 2, "weight")
    return rows.select("id", fault.alias("fault"))


def collator_range(rows: DataFrame, ranges: DataFrame) -> DataFrame:
    """rows (shard, seq_no) with the one range (shard, first, last, collator) that holds them; several are an error."""
    hits = rows.join(ranges, (rows["shard"] == ranges["shard"]) & F.col("seq_no").between(F.col("first"), F.col("last")), "left").drop(ranges["shard"])
    one = hits.groupBy("shard", "seq_no").agg(F.count("collator").alias("_n"), F.first("collator", ignorenulls=True).alias("collator"))
    return one.withColumn("collator", F.when(F.col("_n") <= 1, F.col("collator")).otherwise(F.raise_error(F.lit("several ranges hold a block")).cast("string"))).drop("_n")
