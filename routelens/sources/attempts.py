"""Attempt folders: ``<root>/<slug>/<n>/`` with a model's output, its query and a result, read as one file scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The files that a complete attempt has.
REQUIRED = ("model_output.txt", "query.txt", "result.json")


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """slug, attempt, name and path of every file two folders below ``root``; no file is opened.

    The listing is Spark's own, so any file system does. Names of attempts that aren't numbers are left out, as are slugs
    without an underscore and a number behind it.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, i)
    files = files.where(F.size(parts) > 3).select(at(-3).alias("slug"), at(-2).alias("attempt"), at(-1).alias("name"), "path")
    return files.where(F.col("attempt").rlike("^[0-9]{1,9}$") & F.col("slug").rlike("^.*_[0-9]+$")).withColumn("attempt", F.col("attempt").cast("int"))


def list_attempts(files: DataFrame) -> DataFrame:
    """slug, attempt, complete (all required files are there) and missing (those that aren't), in order of names."""
    there = F.collect_set(F.when(F.col("name").isin(*REQUIRED), F.col("name")))
    missing = F.array_except(F.array(*map(F.lit, REQUIRED)), F.col("there"))
    return files.groupBy("slug", "attempt").agg(there.alias("there")).select("slug", "attempt", (F.size(missing) == 0).alias("complete"), missing.alias("missing"))


def list_bugs(files: DataFrame) -> DataFrame:
    """slug and number of its complete attempts, for slugs that have any."""
    return list_attempts(files).where("complete").groupBy("slug").agg(F.count("*").alias("attempts"))


def is_valid(files: DataFrame) -> bool:
    """Whether there is a slug with a complete attempt at all."""
    return bool(list_attempts(files).where("complete").limit(1).count())


def read_attempts(spark: SparkSession, root: str) -> DataFrame:
    """slug, attempt, output, query, result (JSON text) and reward of the complete attempts.

    The reward is whether the result says true or 1; a result that isn't a JSON object gives null. Only files of the required
    names are opened, whole, one row each, and they meet by a grouped maximum: one exchange. Names come from the same listing
    as in ``list_files``, so any character in a slug does. Bytes that aren't UTF-8 become replacement characters.
    """
    complete = list_attempts(list_files(spark, root)).where("complete").select("slug", "attempt")
    held = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "{" + ",".join(REQUIRED) + "}").load(root)
    parts = F.split("path", "/")
    at = lambda i: F.element_at(parts, i)
    text = held.where(F.size(parts) > 3).select(at(-3).alias("slug"), at(-2).alias("attempt"), at(-1).alias("name"), F.decode("content", "UTF-8").alias("value"))
    text = text.where(F.col("attempt").rlike("^[0-9]{1,9}$")).withColumn("attempt", F.col("attempt").cast("int"))
    of = lambda name: F.max(F.when(F.col("name") == name, F.col("value")))
    read = text.groupBy("slug", "attempt").agg(of(REQUIRED[0]).alias("output"), of(REQUIRED[1]).alias("query"), of(REQUIRED[2]).alias("result"))
    said = F.get_json_object("result", "$.reward")
    reward = F.coalesce((said == "true") | (said.try_cast("double") == 1), said == "true", F.lit(False))
    return read.join(complete, ["slug", "attempt"]).withColumn("reward", F.when(F.from_json("result", "map<string,string>").isNotNull(), reward))
