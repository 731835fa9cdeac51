"""Patches of projects as items with metadata, their statistics, and those worth a look."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.functions import patches as P
from routelens.functions import text as T


def patch_items(patches: DataFrame, reverse: bool = False) -> DataFrame:
    """item_id, slug, view, source_file, text, project, bug_id, file_path, additions, deletions, total_changes, reversed.

    ``patches`` needs project, bug_id and text (a unified diff); blank and null ones are left out. With ``reverse`` the text is
    the patch that undoes it, and counts are its own.
    """
    rows = patches.where(F.col("text").rlike(r"\S")).select(F.col("project").cast("string").alias("project"), F.col("bug_id").cast("string").alias("bug_id"), (T.reverse_patch("text") if reverse else F.col("text")).alias("text"))
    slug, info = F.concat_ws("_", "project", "bug_id"), P.patch_info(F.col("text"))
    rows = rows.select(F.concat(slug, F.lit("__patch")).alias("item_id"), slug.alias("slug"), F.lit("patch").alias("view"), F.concat("bug_id", F.lit(".src.patch")).alias("source_file"), "text", "project", "bug_id", info.alias("i"))
    return rows.select(*rows.columns[:-1], F.col("i.path").alias("file_path"), "i.additions", "i.deletions", (F.col("i.additions") + F.col("i.deletions")).alias("total_changes"), F.lit(reverse).alias("reversed"))


def patch_statistics(items: DataFrame) -> DataFrame:
    """kind, name, n, least, most, mean, median, deviation of total_changes: of all ("all"), by project and by extension of the path.

    The deviation is that of a sample, 0 for one patch. Paths without an extension count as the empty one, patches without a
    path under none. The median is exact, by percentiles over counts of equal sizes.
    """
    name = F.regexp_extract("file_path", r"[^/](\.[^./]*)$", 1)
    kinds = F.array(F.struct(F.lit("all").alias("kind"), F.lit("").alias("name")), F.struct(F.lit("project").alias("kind"), F.col("project").alias("name")), F.when(F.col("file_path") != "", F.struct(F.lit("extension").alias("kind"), name.alias("name"))))
    each = items.select(F.explode(F.filter(kinds, lambda x: x.isNotNull())).alias("k"), "total_changes").select("k.kind", "k.name", "total_changes")
    size = F.col("total_changes")
    return each.groupBy("kind", "name").agg(F.count("*").alias("n"), F.min(size).alias("least"), F.max(size).alias("most"), F.avg(size).alias("mean"), F.percentile(size, 0.5).alias("median"), F.coalesce(F.stddev_samp(size), F.lit(0.0)).alias("deviation"))


def interesting_patches(items: DataFrame) -> DataFrame:
    """One row: smallest and largest (item ids; ties by id), only_additions, only_deletions and balanced (both sides within two
    lines, over four changes). An empty table gives nulls and zeros."""
    a, d, n = F.col("additions"), F.col("deletions"), F.col("total_changes")
    count = lambda test: F.count(F.when(test, 1))
    return items.agg(
        F.min(F.struct(n, "item_id"))["item_id"].alias("smallest"), F.min(F.struct(-n, F.col("item_id")))["item_id"].alias("largest"),
        count((a > 0) & (d == 0)).alias("only_additions"), count((d > 0) & (a == 0)).alias("only_deletions"), count((F.abs(a - d) <= 2) & (n > 4)).alias("balanced"),
    )
