"""Trees in a table of parents: places for drawing them, computed level by level."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.operators.ranks import placed
from routelens.operators.shared import written


def tree_layout(parents: DataFrame) -> DataFrame:
    """Per node: node, depth (0 for roots) and x: its place among all leaves by name, or the mean x of its children.

    ``parents`` has node and parent; a parent that is null or isn't a node itself makes a root. Of several parents the least
    counts; rows with a null node are left out. Nodes on a cycle, and what hangs on one, have no place and are left out. The work is one
    join a level, whatever the number of nodes.
    """
    p = parents.where("node is not null").groupBy("node").agg(F.min("parent").alias("parent"))
    known = p.select(F.col("node").alias("parent"), F.lit(1).alias("known")).distinct()
    p = written(p.join(known, "parent", "left").select("node", F.when(F.col("known") == 1, F.col("parent")).alias("parent")), "parents")
    level = written(p.where("parent is null").select("node").distinct(), "level")
    levels = [level]
    while True:
        below = written(p.join(levels[-1].select(F.col("node").alias("parent")), "parent").select("node", "parent").distinct(), "level")
        if not below.limit(1).count():
            break
        levels.append(below)
    inner = p.where("parent is not null").select(F.col("parent").alias("node")).distinct()
    nodes = levels[0].select("node", F.lit(None).cast(p.schema["parent"].dataType).alias("parent"), F.lit(0).alias("depth"))
    for depth, rows in enumerate(levels[1:], 1):
        nodes = nodes.unionByName(rows.select("node", "parent", F.lit(depth).alias("depth")))
    nodes = written(nodes, "nodes")
    leaves = placed(nodes.join(inner, "node", "left_anti").select("node", F.lit(0).alias("all")).distinct(), ["all"], ["node"]).select("node", (F.col("place") - 1).cast("double").alias("x"))
    leaves = written(leaves, "leaves")
    done, above = leaves, None
    for depth in range(len(levels) - 1, -1, -1):
        rows = nodes.where(F.col("depth") == depth)
        at = rows.join(leaves, "node", "left").select("node", "parent", "x")
        if above is not None:
            at = at.join(above, "node", "left").select("node", "parent", F.coalesce("x", "mean").alias("x"))
        at = written(at, "placed")
        above = at.groupBy(F.col("parent").alias("node")).agg(F.avg("x").alias("mean"))
        done = at.select("node", "x") if depth == len(levels) - 1 else done.unionByName(at.select("node", "x"))
    return nodes.select("node", "depth").join(done, "node").distinct()
