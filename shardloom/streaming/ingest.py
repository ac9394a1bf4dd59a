"""Ordered ingest as Structured Streaming: sequence offsets play the part of the watermark.

Each micro-batch is split against the last applied number: late rows are dropped, an equal number with another identity
or a hole fails the batch, so that it is tried again from the checkpoint; the rest is handed on, then the offset moves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

AHEAD = 8


class HoleError(RuntimeError):
    pass


class OrderedSink:
    """For foreachBatch. load and store keep the offset (seq, hash) where the caller's tables are; apply gets the new rows."""

    def __init__(self, load: Callable[[], tuple[int, str | None]], store: Callable[[int, str], None], apply: Callable[[DataFrame, int], None], seq: str = "seq_no", identity: str = "hash"):
        self.load, self.store, self.apply, self.seq, self.identity = load, store, apply, seq, identity

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        last, last_hash = self.load()
        if last_hash is not None and not batch.filter((F.col(self.seq) == last) & (F.col(self.identity) != last_hash)).isEmpty():
            raise HoleError(f"another block {last} than the one applied")
        new = batch.filter(F.col(self.seq) > last).dropDuplicates([self.seq, self.identity]).persist()
        try:
            s = new.agg(F.min(self.seq).alias("lo"), F.max(self.seq).alias("hi"), F.count("*").alias("n"), F.max_by(self.identity, self.seq).alias("h")).first()
            if s["n"] and (s["lo"] != last + 1 or s["hi"] - s["lo"] + 1 != s["n"]):
                raise HoleError(f"rows after {last} are not {last + 1} and on without holes")
            if s["n"]:
                self.apply(new, batch_id)
                self.store(s["hi"], s["h"])
        finally:
            new.unpersist()


def admission(df: DataFrame, last_mc: int, last_key: int, client: int, ahead: int = AHEAD) -> DataFrame:
    """kind (mc or shard), seq_no, prev_key, mc_ref, known -> verdict: skip, drop, apply, preapply or ignore."""
    verdict = (
        F.when(F.col("known"), "skip").when(F.col("prev_key") > last_key, "drop")
        .when(F.col("kind") == "mc", F.when(F.col("seq_no") == last_mc + 1, "apply").otherwise("ignore"))
        .when(F.col("mc_ref") <= client + ahead, "preapply").otherwise("ignore")
    )
    return df.withColumn("verdict", verdict)
