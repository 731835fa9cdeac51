"""Sources with explicit schemas; bad values become null and duplicate keys are the caller's rule."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCORES = "slug string, value string"
ASSIGNMENTS = "slug string, item_id string, cluster_id string, view string"
REPRESENTATIVES = "cluster_id int, rank int, item_id string, slug string, view string"
RESULTS = "slug string, task string, model string, base_url string, sample_idx int, ppl string, avg_nll string, n_tokens int, ppl_io string, avg_nll_io string, n_tokens_io int"
EMBEDDINGS = "item_id string, slug string, view string, embedding array<float>, embedding_dim int, embedding_model string, tokens string, source_file string, error string"


def read_scores(spark: SparkSession, path: str, strategy: str) -> DataFrame:
    """JSON lines of slug and value; non-numeric and missing values are dropped."""
    df = spark.read.schema(SCORES).json(path)
    return df.select("slug", F.lit(strategy).alias("strategy"), F.expr("try_cast(value as double)").alias("value")).where("slug is not null and value is not null and not isnan(value)")


def read_assignments(spark: SparkSession, path: str) -> DataFrame:
    """Both dialects: by slug, or by item_id whose slug stands before its last double underscore."""
    df = spark.read.schema(ASSIGNMENTS).json(path)
    slug = F.coalesce("slug", F.regexp_extract("item_id", r"^(.*)__", 1))
    return df.select(slug.alias("slug"), F.expr("try_cast(cluster_id as int)").alias("cluster_id"), "view").where("cluster_id is not null")


def read_representatives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REPRESENTATIVES).json(path)


def read_embeddings(spark: SparkSession, path: str, view: str | None = None, dims: int | None = None, strict: bool = True) -> DataFrame:
    df = spark.read.schema(EMBEDDINGS).json(path).where("embedding is not null and error is null")
    if view is not None:
        df = df.where(F.col("view") == view)
    if dims is not None:
        fits = F.size("embedding") == dims
        df = df.withColumn("embedding", F.when(fits, F.col("embedding")).otherwise(F.raise_error(F.lit("wrong dimension")).cast("array<float>"))) if strict else df.where(fits)
    return df


def read_result_tree(spark: SparkSession, root: str) -> DataFrame:
    """Every result.json below ``root``; the run and the sample index come from the path when the record lacks them."""
    df = spark.read.schema(RESULTS).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "result.json").json(root)
    path = F.col("_metadata.file_path")
    number = lambda c: F.expr(f"try_cast({c} as double)")
    return df.select(F.coalesce("slug", F.regexp_extract(path, r"/([^/]+_\d+)/", 1)).alias("slug"), "task", "model", F.coalesce("sample_idx", F.expr("try_cast(regexp_extract(_metadata.file_path, '/([0-9]+)/result.json$', 1) as int)")).alias("sample_idx"), F.coalesce(number("ppl_io"), number("ppl")).alias("metric"), path.alias("path"))


def read_texts(spark: SparkSession, pattern: str) -> DataFrame:
    """slug and whole text of each file, the slug being its folder's name."""
    return spark.read.text(pattern, wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)/[^/]+$", 1).alias("slug"), F.col("_metadata.file_name").alias("name"), F.col("value").alias("text"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, escape='"')


def read_npy(spark: SparkSession, path: str) -> DataFrame:
    """(path, row, embedding) of every .npy file of vectors; a file is read by one task, so write large stores in parts."""

    def rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for name, content in zip(part["path"], part["content"], strict=True):
                x = np.atleast_2d(np.load(io.BytesIO(content), allow_pickle=False)).astype(np.float32)
                for at in range(0, len(x), 4096):
                    yield pd.DataFrame({"path": name, "row": np.arange(at, min(at + 4096, len(x))), "embedding": list(x[at : at + 4096])})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    return files.mapInPandas(rows, "path string, row long, embedding array<float>")


def count_log_lines(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """(file, one column per pattern): how many lines of each log match."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_name"))
    return lines.groupBy("file").agg(*(F.count_if(F.col("value").rlike(p)).alias(name) for name, p in patterns.items()))


def unprocessed(work: DataFrame, done: DataFrame, key: str, success: str | None = None) -> DataFrame:
    """Rows of ``work`` whose key isn't in ``done``; with ``success`` only rows of ``done`` where that column is true count."""
    keys = (done.where(success) if success else done).select(key).distinct()
    return work.join(keys, key, "left_anti")


def latest_per_key(df: DataFrame, key: str, by: str) -> DataFrame:
    """The whole row of each key with the largest ``by``: a file written twice counts once."""
    return df.groupBy(key).agg(F.max_by(F.struct(*df.columns), by).alias("r")).select("r.*")
