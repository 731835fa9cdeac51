"""Sinks; all are distributed writes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_jsonl(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def write_members(assignments: DataFrame, path: str) -> None:
    assignments.groupBy("cluster_id").agg(F.sort_array(F.collect_list("slug")).alias("members")).write.json(path)


def write_report(frames: list[DataFrame], path: str) -> None:
    """One CSV over the union of all columns, blanks where a frame lacks one."""
    reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames).write.csv(path, header=True, escape='"')


def write_split_failures(df: DataFrame, path: str, errors_path: str, error_column: str = "error") -> None:
    df.where(F.col(error_column).isNull()).write.json(path)
    df.where(F.col(error_column).isNotNull()).write.json(errors_path)


def write_levels(df: DataFrame, path: str) -> None:
    df.write.partitionBy("level", "cluster_key").parquet(path)


def write_representatives(df: DataFrame, path: str) -> None:
    """JSON lines ordered by cluster, then rank; ordered by ranges, not in one task."""
    df.orderBy("cluster_id", "rank").write.json(path)


def write_assignments(df: DataFrame, path: str) -> None:
    """item_id, slug and cluster_id; a missing slug is what stands before the item's last double underscore."""
    slug = F.coalesce("slug", F.regexp_extract("item_id", r"^(.*)__", 1)) if "slug" in df.columns else F.regexp_extract("item_id", r"^(.*)__", 1)
    df.select("item_id", slug.alias("slug"), "cluster_id").write.json(path)


def append_records(df: DataFrame, path: str) -> None:
    """Adds to what is there; each run's files appear together, so no lock is needed."""
    df.write.mode("append").json(path)


def write_metadata(assignments: DataFrame, path: str, algorithm: str, **settings: object) -> None:
    """One JSON row: algorithm, n_clusters, n_samples and the settings given, counted from cluster_id of the assignments."""
    counted = assignments.agg(F.count_distinct("cluster_id").alias("n_clusters"), F.count("*").alias("n_samples"))
    counted.select(F.lit(algorithm).alias("algorithm"), "n_clusters", "n_samples", *(F.lit(x).alias(name) for name, x in settings.items())).write.json(path)


def representative_summary(representatives: DataFrame) -> DataFrame:
    """cluster_id, size and representatives (ids by rank) of each cluster; as many ids a row as were asked for a cluster."""
    held = representatives.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id"))).alias("r"))
    return held.select("cluster_id", F.size("r").alias("size"), F.transform("r", lambda x: x["id"]).alias("representatives"))


def write_markdown(table: DataFrame, path: str, title: str, most: int = 1000) -> None:
    """A report's table as Markdown text, in the order of its rows; for reports of at most ``most`` rows, more is an error."""
    rows = table.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [f"# {title}", "", "| " + " | ".join(map(cell, table.columns)) + " |", "|" + " - |" * len(table.columns), *("| " + " | ".join(map(cell, r)) + " |" for r in rows)]
    table.sparkSession.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(path)
