"""Connected components by repeated contraction to the smallest neighbour."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long) -> node, root: the smallest node of its component, for every node with an edge.

    Each round hooks every node to its smallest neighbour and contracts, which at least halves every component; the
    rounds' tables are written to the shared folder, so a lost executor costs one round's tasks.
    """
    edges = cut(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    found = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = cut(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("root")), "hook")
        up = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
        hook = hook.join(up, "root").select("node", F.col("up").alias("root"))
        hook = cut(hook.join(up, "root").select("node", F.col("up").alias("root")), "hook")
        if found is None:
            found = hook
        else:
            next_root = hook.select(F.col("node").alias("root"), F.col("root").alias("up"))
            found = cut(found.join(next_root, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "roots")
        to = hook.select(F.col("node").alias("a"), F.col("root").alias("ra"))
        moved = edges.join(to, "a").join(to.select(F.col("a").alias("b"), F.col("ra").alias("rb")), "b")
        edges = cut(moved.filter("ra <> rb").select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")) if found is None else found
