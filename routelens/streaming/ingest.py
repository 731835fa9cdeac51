"""File stream of score records into mean scores: an extension, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def score_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema("slug string, strategy string, value double, ts timestamp").json(folder)


def daily_means(stream: DataFrame, late: str = "1 day") -> DataFrame:
    return stream.where("value is not null").withWatermark("ts", late).groupBy(F.window("ts", "1 day"), "slug", "strategy").agg(F.avg("value").alias("value"), F.count("*").alias("n"))


def run_available(df: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append everything that has arrived; a restart goes on where the last one ended."""
    q = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return q
