"""Spark session with the settings the queries are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build_session(name: str = "routelens", master: str | None = None, **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; partitions are sized at run time from what exchanges hold."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    if master:
        b = b.master(master)
    for key, value in conf.items():
        b = b.config(key.replace("__", "."), value)
    return b.getOrCreate()
