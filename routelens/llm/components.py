"""Connected components over an edge table, by alternating large-star and small-star steps.

Every step is a grouped minimum and an equi-join (both sides plain exchanges, so a hot centre is split by AQE);
no node's neighbours are gathered in one task. Steps cut their lineage in the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import materialize, release


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.select(F.inline(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("a").alias("v")))))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """Each of a node's partners moves to the least of them, and the least one's edge stands for the node's own."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    return edges.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b")).distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every larger end has one edge and is nobody's smaller end: a forest of stars round their smallest nodes."""
    ends = edges.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))))
    return not ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up + down > 1 and up > 0").agg(F.count("*")).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of ``edges`` (a, b: long); component is its smallest node.

    Self edges, repeated edges and either direction are allowed; rows with a null end are ignored; an empty table
    gives an empty result.
    """
    e = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e = materialize(e, "edges")
    while not _settled(e):  # each round lowers the larger ends' partners until stars are left
        before, e = e, materialize(_small_star(_large_star(e)), "edges")
        release(before)
    return e.select(F.inline(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("component")), F.struct(F.col("b").alias("node"), F.col("b").alias("component"))))).distinct()
