"""Parent-child links to full hierarchies: path, depth, root, descendants and cycles.

Roots open a frontier; each level joins the frontier to the links once and extends path
and depth.  Nodes that no frontier reaches hang on a cycle.  Which of them lie on it comes
from squaring the upward function: after log2(n) squarings every image lies on a cycle.
The nodes below a cycle are then reached by a second frontier that starts at its members.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from orgweave.session import cut


def _levels(start: DataFrame, links: DataFrame, cut_every: int) -> DataFrame:
    """Frontier joins from ``start`` (node, root, depth, path) down ``links`` (child, up)."""
    reached, frontier = start, start
    level = 0
    while True:
        frontier = links.join(frontier.withColumnRenamed("node", "up"), "up").select(
            F.col("child").alias("node"), "root", (F.col("depth") + 1).alias("depth"), F.concat_ws("/", "path", "child").alias("path")
        )
        frontier = cut(frontier)
        if frontier.isEmpty():
            return reached
        reached = reached.unionByName(frontier)
        level += 1
        if level % cut_every == 0:
            reached = cut(reached)


def trees_and_rings(links: DataFrame, cut_every: int = 16) -> DataFrame:
    """Position of every node of a forest that may hold cycles.

    ``links`` (child, up): at most one distinct upward neighbour per child; rows with a NULL
    end drop out, repeated rows count once, extra columns are ignored.  Should a child have
    several upward neighbours, the smallest one counts and :func:`further_links` reports the others.  An
    empty table gives no rows.

    Returns one row per node: (node, outcome, root, depth, path) with outcome ``tree``,
    ``ring`` (also a link to itself) or ``below_ring``, as the module text says.  Ids stay
    text; every step is an equi-join on a node id, whose skew AQE splits, and a parent with
    very many children is a row on the frontier's side, never a gathered list.
    """
    known = cut(links.where("child IS NOT NULL AND up IS NOT NULL").select("child", "up").distinct())
    one = cut(known.groupBy("child").agg(F.min("up").alias("up")))
    nodes = known.select(F.col("child").alias("node")).union(known.select("up")).distinct()
    roots = nodes.join(one.select(F.col("child").alias("node")), "node", "left_anti")
    start = roots.select("node", F.col("node").alias("root"), F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("path"))
    trees = cut(_levels(start, one, cut_every))
    unreached = cut(one.join(trees.select(F.col("node").alias("child")), "child", "left_anti"))
    n = unreached.count()
    tree_rows = trees.select("node", F.lit("tree").alias("outcome"), "root", "depth", "path")
    if n == 0:
        return tree_rows
    jump = unreached.select("child", F.col("up").alias("to"), F.least("child", "up").alias("low"))
    for _ in range(max(1, math.ceil(math.log2(n))) + 1):
        ahead = jump.select(F.col("child").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        jump = cut(jump.join(ahead, "to").select("child", F.col("to2").alias("to"), F.least("low", "low2").alias("low")))
    on_ring = jump.select(F.col("to").alias("child")).distinct()
    rings = cut(jump.join(on_ring, "child", "left_semi").select(F.col("child").alias("node"), F.col("low").alias("root")))
    ring_start = rings.select("node", "root", F.lit(0).cast("bigint").alias("depth"), F.col("node").alias("path"))
    hanging = cut(unreached.join(rings.select(F.col("node").alias("child")), "child", "left_anti"))
    below = _levels(ring_start, hanging, cut_every).where("depth > 0")
    ring_rows = ring_start.select("node", F.lit("ring").alias("outcome"), "root", "depth", "path")
    below_rows = below.select("node", F.lit("below_ring").alias("outcome"), "root", "depth", "path")
    return tree_rows.unionByName(ring_rows).unionByName(below_rows)


def further_links(links: DataFrame) -> DataFrame:
    """(child, up) of the links that a forest has no room for: all upward neighbours of a child but its smallest."""
    known = links.where("child IS NOT NULL AND up IS NOT NULL").select("child", "up").distinct()
    return known.join(known.groupBy("child").agg(F.min("up").alias("first")), "child").where("up <> first").select("child", "up")


def ancestor_pairs(positions: DataFrame) -> DataFrame:
    """(ancestor, node, steps) for every tree or below-ring node, read off its path.

    The output is what is asked for (all descendants of every node), one generator and no
    shuffle.  A ring's members have no ancestor here.
    """
    parts = positions.select("node", F.split("path", "/").alias("way"))
    pairs = parts.select("node", F.size("way").alias("n"), F.posexplode("way").alias("at", "ancestor"))
    return pairs.where(F.col("at") < F.col("n") - 1).select("ancestor", "node", (F.col("n") - 1 - F.col("at")).cast("bigint").alias("steps"))


def descendant_counts(positions: DataFrame) -> DataFrame:
    """(node, descendants, deepest): how many nodes hang below each node; partial sums map-side."""
    counted = ancestor_pairs(positions).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("descendants"), F.max("steps").alias("deepest"))
    return positions.select("node", "root", "outcome").join(counted, "node", "left").select(
        "node", "outcome", "root", F.coalesce("descendants", F.lit(0)).cast("bigint").alias("descendants"), F.coalesce("deepest", F.lit(0)).cast("bigint").alias("deepest")
    )


def cycle_report(positions: DataFrame) -> DataFrame:
    """(root, members, below): size of each cycle and of what hangs on it."""
    return (
        positions.where("outcome <> 'tree'")
        .groupBy("root")
        .agg(F.count(F.when(F.col("outcome") == "ring", 1)).alias("members"), F.count(F.when(F.col("outcome") == "below_ring", 1)).alias("below"))
    )


def latest_by(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key; ties keep one row."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return df.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")
