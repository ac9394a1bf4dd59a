"""State that follows the chain: the current persistent block, the least referenced block, offsets, archives in order.

Each class keeps its state in a table of the caller's (load, store) and is called with micro-batches (foreachBatch). State
goes with the number of the batch that made it, so a batch that is delivered again changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import ordered, shards

ARCHIVE_SPAN, NEAR_SECONDS = 100, 1800


@dataclass(frozen=True)
class Kept:
    """Last key block seen, current persistent block, and the batch that brought them."""

    batch: int = -1
    seq_no: int = -1
    gen_utime: int = 0
    persistent_seq: int = -1
    persistent_utime: int = 0


def keep(state: Kept, keys: DataFrame, batch_id: int, bits: int = ordered.PERSISTENT_BITS) -> Kept:
    """The state after a batch's key blocks (seq_no, gen_utime). Those at or before the last one seen change nothing."""
    if batch_id <= state.batch:
        return state
    new = keys.filter(F.col("seq_no") > state.seq_no).select("seq_no", "gen_utime").distinct()
    if state.seq_no >= 0:
        seed = keys.sparkSession.range(1).select(F.lit(state.seq_no).cast("long").alias("seq_no"), F.lit(state.gen_utime).cast("long").alias("gen_utime"))
        new = new.unionByName(seed)
    last = new.agg(F.max_by(F.struct("seq_no", "gen_utime"), "seq_no").alias("x")).first()["x"]
    found = ordered.persistent_boundaries(new, bits).agg(F.max_by(F.struct("seq_no", "gen_utime"), "seq_no").alias("x")).first()["x"]
    if last is None:
        return Kept(batch_id, *[getattr(state, f) for f in ("seq_no", "gen_utime", "persistent_seq", "persistent_utime")])
    persistent = (found["seq_no"], found["gen_utime"]) if found else (state.persistent_seq, state.persistent_utime)
    return Kept(batch_id, last["seq_no"], last["gen_utime"], *persistent)


class Keeper:
    """For foreachBatch: calls found with the persistent block of a batch that brought one."""

    def __init__(self, load: Callable[[], Kept], store: Callable[[Kept], None], found: Callable[[Kept], None] = lambda k: None):
        self.load, self.store, self.found = load, store, found

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        old = self.load()
        new = keep(old, batch.filter("is_key"), batch_id)
        if new.persistent_seq != old.persistent_seq:
            self.found(new)
        self.store(new)


def init_blocks(keys: DataFrame, bits: int = ordered.PERSISTENT_BITS) -> DataFrame:
    """Each key block with the last persistent one up to it: where a sync that has come this far would start anew."""
    marks = ordered.persistent_boundaries(keys.select("seq_no", "gen_utime"), bits).select("seq_no", F.lit(True).alias("_mark"))
    rows = keys.join(marks, "seq_no", "left")
    return ordered.last_before(rows, "seq_no", F.when(F.col("_mark"), F.col("seq_no")), "init_seq", True).drop("_mark")


def min_refs(counts: DataFrame, ops: DataFrame) -> DataFrame:
    """counts: mc_seq_no, n; ops: mc_seq_no, delta (+1 insert, -1 drop) -> counts without zeros. Its least mc_seq_no is the
    block that nothing before may be collected of."""
    rows = counts.select("mc_seq_no", "n").unionByName(ops.select("mc_seq_no", F.col("delta").cast("long").alias("n")))
    sums = rows.groupBy("mc_seq_no").agg(F.sum("n").alias("n"))
    checked = F.when(F.col("n") < 0, F.raise_error(F.lit("a reference was dropped more often than taken")).cast("long")).otherwise(F.col("n"))
    return sums.withColumn("n", checked).filter("n > 0")


def min_after_each(ops: DataFrame, key: list[str] | None = None) -> DataFrame:
    """ops: key, step, mc_seq_no, delta, a log for each key -> key, step, least: the least referenced block after each step.

    A block is referenced over spans of steps; a step meets the spans of its own log that hold it.
    """
    on = key or []
    w = Window.partitionBy(*on, "mc_seq_no").orderBy("step")
    at = ops.withColumn("_n", F.sum("delta").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("_until", F.lead("step").over(w))
    spans = at.filter("_n > 0").select(*[F.col(c).alias(f"_{c}") for c in on], "mc_seq_no", F.col("step").alias("_from"), F.coalesce("_until", F.lit((1 << 63) - 1)).alias("_until"))
    steps = ops.select(*on, "step").distinct()
    same = (F.col("step") >= F.col("_from")) & (F.col("step") < F.col("_until"))
    for c in on:
        same = same & (F.col(c) == F.col(f"_{c}"))
    return steps.join(spans, same, "left").groupBy(*on, "step").agg(F.min("mc_seq_no").alias("least"))


def archives_in_order(archives: DataFrame, next_seq: int) -> DataFrame:
    """archives: archive_id, first, last (numbers of masterchain blocks in them) -> those that can be taken from next_seq on,
    one after another, each starting no later than the one before it ended plus one; with taken: whether it can.

    Archives that end before next_seq are passed over.
    """
    rows = archives.filter(F.col("last") >= next_seq)
    order = Window.partitionBy(F.floor(F.col("archive_id") / ordered.BUCKET)).orderBy("archive_id")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    ends = rows.groupBy(F.floor(F.col("archive_id") / ordered.BUCKET).alias("_b")).agg(F.max("last").alias("_end"))
    carried = ends.select("_b", F.max("_end").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)).alias("_from"))
    rows = rows.withColumn("_before", before).withColumn("_b", F.floor(F.col("archive_id") / ordered.BUCKET)).join(carried, "_b")
    reach = F.greatest(F.coalesce("_before", F.lit(next_seq - 1)), F.coalesce("_from", F.lit(next_seq - 1)), F.lit(next_seq - 1))
    rows = rows.withColumn("_gap", F.col("first") > reach + 1)
    hole = rows.filter("_gap").agg(F.min("archive_id").alias("_hole"))
    return rows.join(F.broadcast(hole)).select(*archives.columns, (F.col("_hole").isNull() | (F.col("archive_id") < F.col("_hole"))).alias("taken"))


def fits_request(archive_id: int, next_seq: int) -> bool:
    """Whether an archive may hold the block asked for: it starts no later, and less than ARCHIVE_SPAN before."""
    return archive_id <= next_seq < archive_id + ARCHIVE_SPAN


def prefetches(last_utime: int, now: int) -> bool:
    """Archives are fetched ahead while the chain's end is more than NEAR_SECONDS away."""
    return last_utime + NEAR_SECONDS < now


class ArchiveSink:
    """For foreachBatch over archives' blocks (archive_id, workchain, shard, seq_no, ...): verifies that the batch's blocks go on
    from the edge, hands them on by masterchain block, then stores edge and offset, with the batch's number, in one call."""

    def __init__(self, load: Callable[[], tuple[int, int, DataFrame | None]], store: Callable[[int, int, DataFrame], None], apply: Callable[[DataFrame, int], None]):
        self.load, self.store, self.apply = load, store, apply

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        done, mc_seq, tops = self.load()
        if batch_id <= done:
            return
        blocks = batch.persist()
        try:
            faults = shards.map_faults(blocks).limit(3).collect()
            if faults:
                raise ValueError(f"an archive with holes: {faults}")
            if tops is not None:
                one = batch.sparkSession.range(1).select(F.lit(0).alias("k"), F.lit(mc_seq).cast("long").alias("mc_seq_no"))
                verdict = shards.verify_edge(blocks.withColumn("k", F.lit(0)), tops.filter("workchain >= 0").select(F.lit(0).alias("k"), "shard", "top"), one, ["k"]).first()
                if not verdict["ok"]:
                    raise ValueError(verdict["error"])
            new = shards.to_process(blocks, tops)
            self.apply(new, batch_id)
            heads = blocks.groupBy("workchain", "shard").agg(F.max("seq_no").alias("top"))
            high = blocks.filter("workchain = -1").agg(F.max("seq_no").alias("m")).first()["m"]
            self.store(batch_id, mc_seq if high is None else high, heads)
        finally:
            blocks.unpersist()
