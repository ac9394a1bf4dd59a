"""Operators on shards as prefixes: containment below an edge of top blocks, predecessors across splits and merges, holes
that a split or merge explains, and verification that an archive goes on where an edge ends.

A shard is the string of the bits that its accounts share ('' for all of them); workchain -1 is the masterchain. Prefixes
are at most 60 bits, so a shard meets its ancestors by equality on its own prefixes and never by comparing all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import codecs

MASTERCHAIN = -1
#: Errors of edge verification (fixed names).
AMBIGUOUS, NOT_FOUND, MC_NOT_FOUND, MC_TWICE = "AmbiguousEdgeBlock", "NextBlockNotFound", "NextMasterchainBlockNotFound", "DuplicateMasterchainBlock"


def is_masterchain(workchain: Column) -> Column:
    return workchain == MASTERCHAIN


def ancestors(shard: Column) -> Column:
    """Proper prefixes of a shard, longest first."""
    return F.when(F.length(shard) == 0, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.length(shard) - 1, F.lit(0), F.lit(-1)), lambda n: F.left(shard, n)))


def top_of(rows: DataFrame, tops: DataFrame, key: list[str] | None = None) -> DataFrame:
    """rows with workchain, shard; tops with workchain, shard, top -> rows with top: that of the same shard, else the least
    of the shards that intersect it, else null. key: columns of both sides that keep edges apart."""
    on = [*(key or []), "workchain"]
    asked = rows.select(*on, "shard").distinct()
    exact = tops.select(*on, "shard", F.col("top").alias("_exact"))
    below = asked.select(*on, "shard", F.explode(ancestors(F.col("shard"))).alias("_at")).join(tops.select(*on, F.col("shard").alias("_at"), F.col("top").alias("_top")), [*on, "_at"]).select(*on, "shard", "_top")
    above = tops.select(*on, F.explode(ancestors(F.col("shard"))).alias("shard"), F.col("top").alias("_top")).join(asked, [*on, "shard"]).select(*on, "shard", "_top")
    other = below.unionByName(above).groupBy(*on, "shard").agg(F.min("_top").alias("_other"))
    found = asked.join(exact, [*on, "shard"], "left").join(other, [*on, "shard"], "left").select(*on, "shard", F.coalesce("_exact", "_other").alias("top"))
    return rows.join(found, [*on, "shard"])


def contained(rows: DataFrame, tops: DataFrame, seq: str = "seq_no", key: list[str] | None = None) -> DataFrame:
    """rows with top_seq (0 for an unknown shard), contains (at or past the top; false for an unknown shard) and is_after
    (strictly past it)."""
    found = top_of(rows, tops, key)
    return found.select(*rows.columns, F.coalesce("top", F.lit(0)).cast("long").alias("top_seq"), F.coalesce(F.col(seq) >= F.col("top"), F.lit(False)).alias("contains"), F.coalesce(F.col("top") < F.col(seq), F.lit(False)).alias("is_after"))


def to_process(rows: DataFrame, tops: DataFrame | None, seq: str = "seq_no") -> DataFrame:
    """Rows of an archive that lie after the edge; all of them where there is no edge."""
    return rows if tops is None else contained(rows, tops, seq).filter("is_after").select(*rows.columns)


def predecessors(blocks: DataFrame) -> DataFrame:
    """blocks with shard, after_split, after_merge, prev1_seq, prev2_seq -> the same with prev: one or two (shard, seq_no).

    After a split the predecessor stood in the parent shard, after a merge the two stood in the child shards.
    """
    shard = F.col("shard")
    one = F.struct(F.when(F.col("after_split"), codecs.parent(shard)).otherwise(shard).alias("shard"), F.col("prev1_seq").alias("seq_no"))
    kids = codecs.children(shard)
    two = F.array(F.struct(kids[0].alias("shard"), F.col("prev1_seq").alias("seq_no")), F.struct(kids[1].alias("shard"), F.col("prev2_seq").alias("seq_no")))
    return blocks.withColumn("prev", F.when(F.col("after_merge"), two).otherwise(F.array(one)))


def connections(blocks: DataFrame) -> DataFrame:
    """Edges of blocks (workchain, shard, seq_no and as for predecessors): direction, shard, seq_no -> to_shard, to_seq_no.

    A parent's next2 is its right child after a split; everything else that follows a block is its next1.
    """
    p = predecessors(blocks).select("workchain", "shard", "seq_no", F.posexplode("prev").alias("place", "prev"))
    back = p.select("workchain", F.concat(F.lit("prev"), F.col("place") + 1).alias("direction"), "shard", "seq_no", F.col("prev.shard").alias("to_shard"), F.col("prev.seq_no").alias("to_seq_no"))
    right = F.col("shard") == F.concat(F.col("prev.shard"), F.lit("1"))
    on = p.select("workchain", F.when(right, "next2").otherwise("next1").alias("direction"), F.col("prev.shard").alias("shard"), F.col("prev.seq_no").alias("seq_no"), F.col("shard").alias("to_shard"), F.col("seq_no").alias("to_seq_no"))
    return back.unionByName(on).distinct()


def has_predecessor(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows (workchain, shard, seq_no) with predecessor: whether seq_no - 1 is among blocks in the same, a child or the parent shard."""
    shard, kids = F.col("shard"), codecs.children(F.col("shard"))
    family = F.array(shard, kids[0], kids[1], F.when(F.length(shard) > 0, codecs.parent(shard)))
    asked = rows.select("workchain", "shard", "seq_no", F.explode(family).alias("_at")).filter("_at is not null").withColumn("_before", F.col("seq_no") - 1)
    known = blocks.select("workchain", F.col("shard").alias("_at"), F.col("seq_no").alias("_before"))
    hit = asked.join(known, ["workchain", "_at", "_before"], "left_semi").select("workchain", "shard", "seq_no").distinct().withColumn("predecessor", F.lit(True))
    return rows.join(hit, ["workchain", "shard", "seq_no"], "left").withColumn("predecessor", F.coalesce("predecessor", F.lit(False)))


def map_faults(blocks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """What keeps an archive's blocks (workchain, shard, seq_no) from being whole: rows (workchain, shard, seq_no, fault).

    The masterchain must be without holes. A shard's block must follow the one before it, unless its predecessor stands in a
    child or the parent shard; a shard's first block needs none.
    """
    w = Window.partitionBy("workchain", "shard").orderBy("seq_no")
    rows = blocks.select("workchain", "shard", "seq_no").distinct().withColumn("_p", F.lag("seq_no").over(w))
    odd = rows.filter(F.col("_p").isNotNull() & (F.col("_p") + 1 != F.col("seq_no"))).select("workchain", "shard", "seq_no")
    judged = has_predecessor(odd, blocks)
    holes = judged.filter(is_masterchain(F.col("workchain")) | ~F.col("predecessor"))
    return holes.select("workchain", "shard", "seq_no", F.when(is_masterchain(F.col("workchain")), "MasterchainHole").otherwise("ShardHole").alias("fault"))


def targets(shards: DataFrame, tops: DataFrame, key: list[str]) -> DataFrame:
    """Each archive shard (key, shard) with the rule that tells which block has to come next, the first that fits:

    next: the shard is in the edge; split: its parent is; merge: both of its children are; ancestor: some ancestor is.
    target is the number to be found (for ancestor the one that none may reach), edges the edge shards it stands for.
    """
    shard = F.col("shard")
    at = lambda name, value: tops.select(*key, F.col("shard").alias(name), F.col("top").alias(value))
    rows = shards.withColumns({"_up": F.when(F.length(shard) > 0, codecs.parent(shard)), "_l": codecs.children(shard)[0], "_r": codecs.children(shard)[1]})
    rows = rows.join(at("shard", "_own"), [*key, "shard"], "left").join(at("_up", "_parent"), [*key, "_up"], "left").join(at("_l", "_left"), [*key, "_l"], "left").join(at("_r", "_right"), [*key, "_r"], "left")
    far = shards.select(*key, "shard", F.explode(ancestors(shard)).alias("_at")).join(at("_at", "_top"), [*key, "_at"])
    far = far.groupBy(*key, "shard").agg(F.max_by(F.struct("_at", "_top"), F.length("_at")).alias("_far"))
    rows = rows.join(far, [*key, "shard"], "left")
    both = F.col("_left").isNotNull() & F.col("_right").isNotNull()
    rule = F.when(F.col("_own").isNotNull(), "next").when(F.col("_parent").isNotNull(), "split").when(both, "merge").when(F.col("_far").isNotNull(), "ancestor")
    target = F.when(rule == "next", F.col("_own") + 1).when(rule == "split", F.col("_parent") + 1).when(rule == "merge", F.greatest("_left", "_right") + 1).when(rule == "ancestor", F.col("_far._top"))
    edges = F.when(rule == "next", F.array("shard")).when(rule == "split", F.array("_up")).when(rule == "merge", F.array("_l", "_r")).when(rule == "ancestor", F.array("_far._at"))
    return rows.select(*key, "shard", rule.alias("rule"), target.alias("target"), edges.alias("edges"))


def verify_edge(blocks: DataFrame, tops: DataFrame, masters: DataFrame, key: list[str]) -> DataFrame:
    """key, ok, error for each edge. blocks: key, workchain, shard, seq_no of an archive; tops: key, shard, top, and masters:
    key, mc_seq_no, of the edge that the archive has to go on from.

    An edge shard is settled by the block after its top, by that of both children (either side alone leaves the other one
    open), or by that of the merged parent. It is missing where its own shard or a side of its split goes past the block
    without having it, or where some later descendant shows up, and nothing has settled it. A found side outweighs what is
    missing on the same side. Two kinds of blocks that settle one shard are ambiguous. The masterchain's next block must be
    there, once.
    """
    side = blocks.filter(~is_masterchain(F.col("workchain")))
    known = targets(side.select(*key, "shard").distinct(), tops, key)
    seen = side.join(known, [*key, "shard"]).groupBy(*key, "shard", "rule", "target", "edges").agg(F.max("seq_no").alias("last"), F.bool_or(F.col("seq_no") == F.col("target")).alias("found"))
    right = F.when(F.col("rule") == "split", F.right("shard", F.lit(1)) == "1")
    says = seen.filter("rule is not null").select(*key, F.explode("edges").alias("edge"), "rule", right.alias("right"), (F.col("found") & (F.col("rule") != "ancestor")).alias("found"), (F.col("last") >= F.col("target")).alias("past"))
    hit = lambda rule: F.bool_or((F.col("rule") == rule) & F.col("found"))
    lacks = F.col("past") & ~F.col("found")
    of_side = lambda r, c: F.coalesce(F.bool_or((F.col("rule") == "split") & (F.col("right") == r) & c), F.lit(False))
    per_edge = says.groupBy(*key, "edge").agg(
        hit("next").alias("next"), hit("merge").alias("merge"), hit("split").alias("split"), F.bool_or(lacks & F.col("rule").isin("next", "ancestor", "split")).alias("lacks"),
        *[of_side(r, F.col("found")).alias(f"found_{n}") for n, r in (("left", False), ("right", True))], *[of_side(r, lacks).alias(f"lacks_{n}") for n, r in (("left", False), ("right", True))],
    )
    settled = F.col("next") | F.col("merge") | F.col("split")
    missing = F.when(F.col("split"), (F.col("lacks_left") & ~F.col("found_left")) | (F.col("lacks_right") & ~F.col("found_right"))).otherwise(~settled & F.col("lacks"))
    kinds = F.col("next").cast("int") + F.col("merge").cast("int") + F.col("split").cast("int")
    verdicts = per_edge.groupBy(*key).agg(F.bool_or(kinds > 1).alias("twice"), F.bool_or(missing).alias("missing"))
    mc = blocks.filter(is_masterchain(F.col("workchain"))).join(masters, key).groupBy(*key).agg(F.count_if(F.col("seq_no") == F.col("mc_seq_no") + 1).alias("mc"))
    rows = masters.join(mc, key, "left").join(verdicts, key, "left")
    error = (
        F.when(F.coalesce("mc", F.lit(0)) > 1, MC_TWICE).when(F.coalesce("twice", F.lit(False)), AMBIGUOUS)
        .when(F.coalesce("mc", F.lit(0)) == 0, MC_NOT_FOUND).when(F.coalesce("missing", F.lit(False)), NOT_FOUND)
    )
    return rows.select(*key, error.isNull().alias("ok"), error.alias("error"))
