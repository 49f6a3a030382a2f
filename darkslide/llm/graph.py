"""Connected components of a graph too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, sized, written

#: Edges of a round for each of its tasks.
ROWS = 10_000


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))


def _jumped(parents: DataFrame, rows: int) -> DataFrame:
    """Each node's root: the parents' parents, until nothing changes."""
    while True:
        up = parents.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
        nxt = written(sized(parents.join(up, "parent", "left").select("node", F.coalesce("grand", "parent").alias("parent"), (F.col("grand") < F.col("parent")).alias("moved")), rows, ROWS))
        moved = nxt.where("moved").limit(1).count()
        forget(parents)
        parents = nxt.select("node", "parent")
        parents._darkslide_path = nxt._darkslide_path
        if not moved:
            return parents


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for each node of ``edges`` (a, b): the least node that it reaches.

    Each round hangs every node under its least neighbour, follows the parents to their roots, and puts the roots in
    the place of the nodes. The edges within a tree are gone then, so at most half the nodes go into the next round.
    Every join reads two written tables, so that hot nodes can be split. Nulls are no nodes; an empty table gives none.
    """
    left = written(edges.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct())
    found: DataFrame | None = None
    while n := left.count():
        near = _both_ways(left).groupBy(F.col("a").alias("node")).agg(F.min("b").alias("parent"))
        roots = _jumped(written(sized(near.select("node", F.least("node", "parent").alias("parent")), n, ROWS)), n)
        up = lambda c: roots.select(F.col("node").alias(c), F.col("parent").alias(f"{c}_root"))
        nxt = written(sized(left.join(up("a"), "a").join(up("b"), "b").where("a_root <> b_root").select(F.col("a_root").alias("a"), F.col("b_root").alias("b")).distinct(), n, ROWS))
        if found is None:
            found = roots
        else:
            above = roots.select(F.col("node").alias("parent"), F.col("parent").alias("root"))
            later = written(found.join(above, "parent", "left").select("node", F.coalesce("root", "parent").alias("parent")))
            forget(found, roots)
            found = later
        forget(left)
        left = nxt
    forget(left)
    if found is None:
        return edges.sparkSession.createDataFrame([], "node long, component long")
    out = found.select("node", F.col("parent").alias("component"))
    return out
