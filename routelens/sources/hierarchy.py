"""Results of hierarchical clustering as JSON: levels, their clusters, members and the tree between them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLUSTER = "struct<parent:string,cluster_id:int,size:long,center:array<double>,project_distribution:map<string,long>,vectors:array<struct<id:string,folder:string,file:string,tokens:long>>>"


def read_hierarchy(spark: SparkSession, path: str) -> DataFrame:
    """``clusters_of`` the file (or files) at ``path``, read whole."""
    return clusters_of(spark.read.text(path, wholetext=True))


def clusters_of(texts: DataFrame, column: str = "value") -> DataFrame:
    """level, cluster, parent, cluster_id, size, center, projects, vectors of each cluster in JSON texts.

    Levels are the keys level_n with a number; other keys, broken texts and null clusters are left out.
    """
    held = texts.select(F.from_json(column, f"struct<hierarchy:map<string,map<string,{_CLUSTER}>>>").alias("j"))
    levels = held.select(F.explode("j.hierarchy").alias("name", "clusters")).where(F.col("name").rlike("^level_[0-9]{1,9}$"))
    each = levels.select(F.substring("name", 7, 9).cast("int").alias("level"), F.explode("clusters").alias("cluster", "c")).where("c is not null")
    return each.select("level", "cluster", "c.parent", "c.cluster_id", "c.size", "c.center", F.col("c.project_distribution").alias("projects"), "c.vectors")


def available_levels(clusters: DataFrame) -> list[int]:
    return [r[0] for r in clusters.select("level").distinct().orderBy("level").collect()]


def resolve_level(clusters: DataFrame, requested: int | None = None) -> int:
    """The level asked for, or the last one; an unknown level, or none at all, is an error that names those there are."""
    levels = available_levels(clusters)
    if not levels or requested is not None and requested not in levels:
        raise ValueError(f"level {requested} is not among {levels}" if levels else "there is no level in these results")
    return levels[-1] if requested is None else requested


def level_clusters(clusters: DataFrame, level: int) -> DataFrame:
    """cluster, center and size of a level's clusters in order of their names; a missing centre is null."""
    return clusters.where(F.col("level") == level).select("cluster", "center", "size").orderBy("cluster")


def members(clusters: DataFrame, level: int) -> DataFrame:
    """id, folder and cluster of every vector of a level."""
    return clusters.where(F.col("level") == level).select("cluster", F.explode("vectors").alias("v")).select("v.id", "v.folder", "cluster")


def project_counts(clusters: DataFrame) -> DataFrame:
    """level, cluster, project, n: vectors by the part of their folder before the first underscore ("unknown" without a folder)."""
    each = clusters.select("level", "cluster", F.explode("vectors").alias("v"))
    return each.groupBy("level", "cluster", F.coalesce(F.substring_index("v.folder", "_", 1), F.lit("unknown")).alias("project")).agg(F.count("*").alias("n"))


def tree_lines(clusters: DataFrame) -> DataFrame:
    """level, cluster, line: each cluster under its name, indented by its level, with its size and share of its parent."""
    sizes = clusters.select(F.col("cluster").alias("parent"), (F.col("level") + 1).alias("level"), F.col("size").alias("whole"))
    share = F.when(F.col("whole") > 0, F.concat(F.lit(", "), F.round(100 * F.col("size") / F.col("whole"), 1).cast("string"), F.lit(" % of "), F.col("parent"))).otherwise("")
    line = F.concat(F.repeat(F.lit("  "), F.col("level")), F.col("cluster"), F.lit(": "), F.coalesce(F.col("size"), F.lit(0)).cast("string"), F.coalesce(share, F.lit("")))
    return clusters.join(sizes, ["level", "parent"], "left").select("level", "cluster", line.alias("line"))
