"""Mixing sources to target weights by entropy balancing.

Each source gets a target of words. Among all document rates r in [0, MOST] that meet the targets, the mix takes the
one nearest to taking each document once in relative entropy: r = min(MOST, exp(lam_s * size / mean_s)). The duals
lam_s come from safeguarded Newton steps; each step is one aggregation over (source, size) counts, which hold all that
the duals need. Rates become copies by carrying the rounding error along each source's sizes, and what words are then
missing or over are made up from the largest size that still fits, so a source ends within its smallest size of its
target unless capacity runs out. Copies are whole: a source that is mostly one long text can miss by up to that text.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, cut, fresh, ready, sized

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MOST = 2
STEPS = 60
NEAR = 1e-9
#: Documents of one (source, size) that are ranked together.
RANKED = 1000


def source_key(source: Column) -> Column:
    """Sorts by code point, null last, and equals itself."""
    return F.coalesce(F.concat(F.lit("a"), source), F.lit("b"))


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """totals: key, total (words of a source) -> key, total, docs..., target.

    Filling by weight up to the caps ends where every source below its cap has the same words per weight; sorted by
    cap per weight, the capped ones come first, so running sums find them. One row a source.
    """
    place = F.row_number().over(Window.orderBy("key")) - 1
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (place % len(weights) + 1).cast("int"))
    rows = totals.withColumn("w", w).withColumn("cap", F.col("total") * float(most))
    order = Window.orderBy(F.col("cap") / F.col("w"), "key")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    left = F.sum("total").over(Window.partitionBy(F.lit(0))) * float(share) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    rows = rows.withColumn("level", left / F.sum("w").over(after))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("capped", F.min(F.col("level") * F.col("w") >= F.col("cap")).over(upto))
    level = F.first(F.when(~F.col("capped"), F.col("level")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return rows.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(F.col("w") * level)).drop("w", "cap", "level", "capped")


def duals(cells: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """cells: key, size, n; goals: key, total, n_docs, target -> key, lam, mean.

    A target at its cap (or at nothing) has no finite dual: lam is infinite there.
    """
    state = goals.select(
        "key", "target", (F.col("total") / F.col("n_docs")).alias("mean"), F.lit(0.0).alias("lam"), F.lit(-math.inf).alias("lo"), F.lit(math.inf).alias("hi"),
        ((F.col("target") >= F.col("total") * most * (1 - NEAR)) | (F.col("total") == 0)).alias("full"),
    )
    state = cut(state.withColumn("lam", F.when(F.col("full"), math.inf).otherwise(0.0)).withColumn("done", F.col("full")), "duals")
    for step in range(STEPS):
        x = F.col("size") / F.col("mean")
        tilt = F.exp(F.least(F.col("lam") * x, F.lit(50.0)))
        rate = F.least(F.lit(float(most)), tilt)
        sums = cells.join(state.filter("not done"), "key").groupBy("key").agg(
            (F.sum(F.col("n") * F.col("size") * rate) - F.first("target")).alias("over"),
            F.sum(F.when(tilt < most, F.col("n") * F.col("size") * x * tilt).otherwise(0.0)).alias("slope"),
        )
        rows = state.join(sums, "key", "left").withColumn("lo", F.when(F.col("over") < 0, F.col("lam")).otherwise(F.col("lo"))).withColumn("hi", F.when(F.col("over") > 0, F.col("lam")).otherwise(F.col("hi")))
        newton = F.col("lam") - F.col("over") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = newton.isNotNull() & (newton > F.col("lo")) & (newton < F.col("hi")) & (F.abs(newton - F.col("lam")) < 8)
        halfway = F.when(F.col("lo") == -math.inf, F.least(F.col("hi") * 2, F.col("hi") - 1)).when(F.col("hi") == math.inf, F.greatest(F.col("lo") * 2, F.col("lo") + 1)).otherwise((F.col("lo") + F.col("hi")) / 2)
        met = F.abs("over") <= NEAR * F.col("target") + 1e-6
        rows = rows.withColumn("now", F.col("done") | met).withColumn("lam", F.when(F.col("now"), F.col("lam")).otherwise(F.when(inside, newton).otherwise(halfway)))
        state = cut(rows.select("key", "target", "mean", "lam", "lo", "hi", "full", F.col("now").alias("done")), "duals")
        if state.filter("not done").isEmpty():
            break
    return state.select("key", "mean", "lam")


def round_cells(rows: pd.DataFrame, most: int = MOST) -> pd.DataFrame:
    """One source's sizes -> the copies each size gives in all. Rows: its distinct sizes, at most the longest text's words."""
    rows = rows.sort_values("size", ascending=False).reset_index(drop=True)
    size, n = rows["size"].to_numpy(np.int64), rows["n"].to_numpy(np.int64)
    lam, mean, target = rows["lam"].iloc[0], rows["mean"].iloc[0], rows["target"].iloc[0]
    rate = np.full(len(size), float(most)) if np.isinf(lam) else np.minimum(most, np.exp(np.minimum(lam * size / max(mean, 1e-300), 50)))
    copies = np.clip(np.diff(np.rint(np.cumsum(rate * n)), prepend=0), 0, most * n).astype(np.int64)
    left = float(target) - float((copies * size).sum())
    for i in np.flatnonzero(size > 0):
        k = math.floor(abs(left) / size[i]) if i < len(size) - 1 else round(abs(left) / size[i])
        if k:
            k = min(k, int(most * n[i] - copies[i])) if left > 0 else -min(k, int(copies[i]))
            copies[i] += k
            left -= float(k * size[i])
    rows["copies"] = copies
    return rows[["key", "size", "n", "copies"]]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """id, size, source_size, target, taken, copies, source_key for every row.

    Null text has size 0; null sources are one source, the last. A text without words is never taken; a repeated id
    counts as often as it occurs. Ties of id within a size break by nothing that a row can be told by, so reruns
    agree. An empty table gives no rows; other columns are ignored.
    """
    rows_of = cut(docs.select(F.col(f"`{id_col}`").alias("id"), source_key(F.col(f"`{source_col}`")).alias("key"), words(F.col(f"`{text_col}`")).alias("size")), "sizes")
    cells = cut(rows_of.groupBy("key", "size").agg(F.count("*").alias("n")), "cells")
    goals = cut(targets(cells.groupBy("key").agg(F.sum(F.col("size") * F.col("n")).alias("total"), F.sum("n").alias("n_docs")), weights, share, most), "goals")
    lams = duals(cells, goals, most)
    per_source = cells.join(lams, "key").join(goals.select("key", "target"), "key")
    ready(docs.sparkSession)
    given = cut(per_source.groupBy("key").applyInPandas(lambda rows: round_cells(rows, most), "key string, size long, n long, copies long"), "copies")

    # Of a cell's n documents, copies % n get one more: the first in hash order, ranked in parts that are counted first.
    part = F.pmod(F.xxhash64("id"), F.greatest(F.lit(1), F.ceil(F.col("n") / RANKED)))
    rows = rows_of.join(given, ["key", "size"]).withColumns({"part": part, "extra": F.col("copies") % F.col("n"), "each": F.floor(F.col("copies") / F.col("n"))})
    open_rows = rows.filter("extra > 0")
    counts = open_rows.groupBy("key", "size", "part").agg(F.count("*").alias("in_part"))
    before = F.sum("in_part").over(Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("key", "size", "part", F.coalesce(before, F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("key", "size", "part").orderBy(F.xxhash64("id", F.lit(7)), "id"))
    ranked = open_rows.withColumn("place", place).join(counts, ["key", "size", "part"])
    chosen = ranked.withColumn("made", F.col("each") + (F.col("place") + F.col("ahead") <= F.col("extra")).cast("long"))
    settled = rows.filter("extra = 0").withColumn("made", F.col("each"))
    cols = ["key", "id", "size", "made"]
    out = chosen.select(cols).unionByName(settled.select(cols)).join(sized(goals.select("key", "total", "target")), "key")
    return out.select(F.col("id").alias(id_col), "size", F.col("total").alias("source_size"), "target", (F.col("made") * F.col("size")).alias("taken"), F.col("made").alias("copies"), F.col("key").alias("source_key"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with every row repeated as often as the mix takes it; all columns kept.

    Rows that repeat an id, or have none, are told apart by source, size and text; where these agree too, the rows are equal
    to the mix, and which of them gets which number of copies shows in nothing but the other columns.
    """
    id_, many, copy = (fresh(docs.columns, name) for name in ("_id", "_copies", "_copy"))
    made = cut(mix(docs, id_col, text_col, source_col).select(F.col(f"`{id_col}`").alias(id_), "source_key", "size", "copies"), "made")
    per_id = cut(made.groupBy(id_).agg(F.count("*").alias("rows"), F.first("copies").alias(many)), "per_id")
    repeated = per_id.filter("rows > 1").select(id_)
    same = F.col(f"`{id_col}`").eqNullSafe(F.col(id_))
    times = lambda rows: rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(many).cast("int")))).select([f"`{c}`" for c in docs.columns])
    out = times(docs.join(sized(per_id.filter(F.col("rows") == 1).filter(F.col(many) > 0).select(id_, many)), same))
    if repeated.isEmpty():
        return out
    key, size, place = (fresh([*docs.columns, id_, many, copy], name) for name in ("_key", "_size", "_place"))
    text = F.col(f"`{text_col}`")
    rows = docs.join(sized(repeated), same, "left_semi").withColumns({key: source_key(F.col(f"`{source_col}`")), size: words(text)})
    rows = rows.withColumn(place, F.row_number().over(Window.partitionBy(id_col, key, size).orderBy(F.xxhash64(text), text)))
    given = made.join(sized(repeated.withColumnRenamed(id_, "rid")), F.col(id_).eqNullSafe(F.col("rid")), "left_semi")
    given = given.select(id_, F.col("source_key").alias("k"), F.col("size").alias("n"), F.col("copies").alias(many), F.row_number().over(Window.partitionBy(id_, "source_key", "size").orderBy(F.desc("copies"))).alias("p"))
    more = rows.join(given.filter(F.col(many) > 0), same & (F.col(key) == F.col("k")) & (F.col(size) == F.col("n")) & (F.col(place) == F.col("p")))
    return out.unionByName(times(more))
