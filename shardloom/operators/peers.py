"""Statistics of peers: folds over each peer's events, scores and choices. events: peer, ord and what a fold reads."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shipping import ship

#: Constants of scores (fixed values).
BASE, BAD, PENALTY, PING_MS = 10, 5, 100, 1000


def folded(df: DataFrame, key: str, order: str, cols: list[str], start: Callable[[], object], step: Callable, result: str, out: Callable[[object], tuple]) -> DataFrame:
    """Each key's rows in order, folded; the rows stream by, so no key's rows are held at once."""
    ship(df.sparkSession)
    names = [c.split()[0] for c in result.split(", ")]
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(key).alias("_k"), F.col(order).alias("_o"), *cols).repartition("_k").sortWithinPartitions("_k", "_o")

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, state, first = None, None, True
        for part in parts:
            done = []
            for k, *values in zip(part["_k"].tolist(), *[part[c].tolist() for c in cols], strict=True):
                if first or k != now:
                    if not first:
                        done.append((now, *out(state)))
                    now, state, first = k, start(), False
                state = step(state, *values)
            yield pd.DataFrame(done, columns=["_k", *names])
        if not first:
            yield pd.DataFrame([(now, *out(state))], columns=["_k", *names])

    return rows.mapInPandas(run, f"_k {kind}, {result}").withColumnRenamed("_k", key)


def checks(events: DataFrame, key: str = "peer", order: str = "ord") -> DataFrame:
    """events with success, counted, probe -> attempts, failures, penalty of each peer.

    Counted queries make attempts and failures. A probe makes a peer active; the next counted query takes that back, and
    costs PENALTY if it fails.
    """
    w = Window.partitionBy(key).orderBy(order)
    rows = events.withColumn("_g", F.coalesce(F.sum(F.col("counted").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    active = F.max("probe").over(Window.partitionBy(key, "_g").orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = rows.withColumn("_active", active)
    missed = F.col("counted") & ~F.col("success")
    return rows.groupBy(key).agg(F.count_if("counted").alias("attempts"), F.count_if(missed).alias("failures"), (F.count_if(missed & F.col("_active")) * PENALTY).alias("penalty"))


def backoff(events: DataFrame, key: str = "peer", order: str = "ord", failed: str = "failed", initial: int = 500, most: int = 5000, factor: float = 1.5) -> DataFrame:
    """Waiting time after each key's tries: multiplied and cut to a whole number on failure, up to most; the first one again on success."""
    step = lambda t, bad: min(most, math.floor(t * factor)) if bad else initial
    return folded(events, key, order, [failed], lambda: initial, step, "timeout long", lambda t: (t,))


def average_failures(df: DataFrame, key: str, failed: Column) -> DataFrame:
    return df.groupBy(key).agg((F.count_if(failed) / F.greatest(F.count("*"), F.lit(1))).alias("failures"))


def progress_steps(df: DataFrame, key: str, order: str, percent: Column, every: int = 5) -> DataFrame:
    """Rows where a key's progress enters another bucket of every percent."""
    w = Window.partitionBy(key).orderBy(order)
    rows = df.withColumn("_b", F.floor(percent / every)).withColumn("_p", F.lag("_b").over(w))
    return rows.filter(F.col("_p").isNull() | (F.col("_b") != F.col("_p"))).select(*df.columns, (F.col("_b") * every).alias("step"))


def hit_ratio(hits: Column, misses: Column) -> Column:
    """In percent; 0 where nothing hit."""
    return F.when(hits > 0, hits * 100.0 / (hits + misses)).otherwise(F.lit(0.0))


def next_for_ping(peers: DataFrame, now_ms: int, n: int = 1) -> DataFrame:
    """Peers (peer, last_ping in ms) to ping next: those not pinged within PING_MS come first, then the longest ago."""
    rows = peers.withColumn("_recent", F.coalesce(F.col("last_ping") + PING_MS > now_ms, F.lit(False)))
    return rows.orderBy("_recent", F.asc_nulls_first("last_ping"), "peer").limit(n).drop("_recent")


def to_replace(peers: DataFrame, seed: int = 0) -> DataFrame:
    """The peer (peer, unreliability) that a new one replaces: the least reliable if worse than BAD, else any, by hash."""
    worst = F.when(F.col("unreliability") > BAD, F.col("unreliability")).otherwise(-1)
    return peers.orderBy(F.desc(worst), F.xxhash64("peer", F.lit(seed)), "peer").limit(1)


def choose(peers: DataFrame, seed: int, able: Column | None = None) -> DataFrame:
    """One peer by weight 2^(BASE - unreliability), reproducibly: the smallest exponential drawn from the peer's hash."""
    rows = peers if able is None else peers.filter(able)
    weight = F.pow(F.lit(2.0), F.lit(BASE) - F.least(F.col("unreliability"), F.lit(BASE)))
    u = (F.pmod(F.xxhash64("peer", F.lit(seed)), F.lit(1 << 40)) + 1) / float(1 << 40)
    return rows.withColumn("_draw", -F.log(u) / weight).orderBy("_draw", "peer").limit(1).drop("_draw")
