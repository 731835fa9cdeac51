"""Keyed tables as Parquet files by version under a commit log; a later version of a key replaces earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


class VersionedTable:
    """Rows under a key in the folder ``path``, which the driver and all executors must share.

    Each ``append`` takes a version number by creating a file of that name, which only one of several writers can do (on file
    systems whose create is exclusive), and writes to a folder of its own. Readers see folders whose write has ended, so a
    writer that dies leaves nothing visible and can be run again: what it wrote twice counts once.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: tuple[str, ...]):
        self.spark, self.path, self.schema, self.keys = spark, path.rstrip("/"), schema, keys

    def _files(self):
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm.org.apache.hadoop.fs.Path, path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, folder: str) -> list[str]:
        path, files = self._files()
        at = path(f"{self.path}/{folder}")
        return [x.getPath().getName() for x in files.listStatus(at)] if files.exists(at) else []

    def _next(self) -> int:
        """Takes the next number of the log: the first that no other writer has created."""
        path, files = self._files()
        n = max((int(x) for x in self.names("log")), default=0) + 1
        while not files.createNewFile(path(f"{self.path}/log/{n}")):
            n += 1
        return n

    def versions(self) -> list[int]:
        """Versions whose write has ended."""
        path, files = self._files()
        found = [int(x.split("=")[1]) for x in self.names("rows") if x.startswith("version=")]
        return sorted(n for n in found if files.exists(path(f"{self.path}/rows/version={n}/_SUCCESS")))

    def rows(self, versions: list[int] | None = None) -> DataFrame:
        """Every row of these versions (all) with its version."""
        versions, schema = self.versions() if versions is None else versions, f"{self.schema}, version int"
        if not versions:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/rows").parquet(*(f"{self.path}/rows/version={n}" for n in versions))

    def append(self, rows: DataFrame) -> int:
        """Write rows, whose keys must not repeat, as a new version and return its number."""
        version = self._next()
        rows.write.parquet(f"{self.path}/rows/version={version}")
        return version

    def latest(self) -> DataFrame:
        """The last version of each key.

        Keys alone are grouped, and only if there are several versions; rows that a later version replaces are left out by
        key, so what the rows hold is neither sorted nor grouped.
        """
        versions, keys = self.versions(), list(self.keys)
        rows = self.rows(versions)
        if len(versions) > 1:
            stale = self.rows(versions).select(*keys, "version").withColumn("last", F.max("version").over(Window.partitionBy(*keys))).where("version < last").drop("last")
            rows = rows.join(stale, [*keys, "version"], "left_anti")
        return rows.drop("version")

    def clear(self) -> None:
        """Delete all rows and the log."""
        path, files = self._files()
        for folder in ("rows", "log"):
            files.delete(path(f"{self.path}/{folder}"), True)
