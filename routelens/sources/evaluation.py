"""Stored evaluation: patches by bug and attempt, results by bug, and the batch result over them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.operators.versioned import VersionedTable

PATCHES = "bug string, attempt int, diff string, strategy string"
RESULTS = "bug string, total_attempts int, successful_attempt int, modeling_type string, failure_reasons array<string>, strategy string, seconds double, total_tests int, passed_tests int, failed_tests int, timeout boolean"


def _once(rows: DataFrame, schema: str, keys: tuple[str, ...]) -> DataFrame:
    """The schema's columns (null where not given), one row a key; rows without a whole key are left out."""
    fields = [f.strip().split(" ", 1) for f in schema.split(",")]
    rows = rows.select(*((F.col(name) if name in rows.columns else F.lit(None)).cast(kind).alias(name) for name, kind in fields)).dropna(subset=list(keys))
    rest = [name for name, _ in fields if name not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("x")).select(*keys, "x.*")


class EvaluationStore:
    """Results of an evaluation in the folder ``path``, which the driver and all executors must share.

    Saving again replaces what was saved under the same bug (and attempt), so a run that is repeated after a loss leaves one
    result of each. Rows with a null bug or attempt are left out; of rows that repeat a key in one call one stays.
    """

    def __init__(self, spark: SparkSession, path: str):
        self._patches = VersionedTable(spark, f"{path.rstrip('/')}/patches", PATCHES, ("bug", "attempt"))
        self._results = VersionedTable(spark, f"{path.rstrip('/')}/results", RESULTS, ("bug",))

    def save_patches(self, rows: DataFrame) -> int:
        return self._patches.append(_once(rows, PATCHES, ("bug", "attempt")))

    def save_results(self, rows: DataFrame) -> int:
        return self._results.append(_once(rows, RESULTS, ("bug",)))

    def patches(self) -> DataFrame:
        return self._patches.latest()

    def results(self) -> DataFrame:
        return self._results.latest()

    def patch(self, bug: str, attempt: int) -> DataFrame:
        return self.patches().where((F.col("bug") == bug) & (F.col("attempt") == attempt))

    def result(self, bug: str) -> DataFrame:
        return self.results().where(F.col("bug") == bug)

    def summary(self) -> DataFrame:
        """One row: patches and results that are stored."""
        count = lambda rows, name: rows.agg(F.count("*").alias(name))
        return count(self.patches(), "patches").join(count(self.results(), "results"))

    def batch_result(self) -> DataFrame:
        return batch_result(self.results())

    def clear(self) -> None:
        self._patches.clear()
        self._results.clear()


def batch_result(results: DataFrame) -> DataFrame:
    """One row: bugs, fixed, failed, those fixed by each kind, shares of each, attempts, seconds and tests.

    ``results`` has a row per bug (see RESULTS). Shares and means of nothing are 0, as are null numbers.
    """
    fixed, kind = F.col("successful_attempt").isNotNull(), F.col("modeling_type")
    n = lambda test: F.count(F.when(test, 1))
    total = lambda name: F.coalesce(F.sum(name), F.lit(0))
    share = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    one = F.lit(True)
    of = {k: kind == k for k in ("rewrite", "edit")}
    return results.agg(
        n(one).alias("bugs"), n(fixed).alias("fixed"), n(~fixed).alias("failed"), *(n(fixed & t).alias(f"{k}_fixed") for k, t in of.items()), share(n(fixed), n(one)).alias("share"),
        *(share(n(fixed & t), n(t)).alias(f"{k}_share") for k, t in of.items()), total("total_attempts").alias("attempts"), share(total("total_attempts"), n(one)).alias("mean_attempts"),
        total("seconds").cast("double").alias("seconds"), share(total("seconds"), n(one)).cast("double").alias("mean_seconds"), total("total_tests").alias("tests"), total("passed_tests").alias("passed"), total("failed_tests").alias("not_passed"), n(F.col("timeout")).alias("timeouts"),
    )


def reason_counts(results: DataFrame, column: str = "failure_reasons") -> DataFrame:
    """reason and how often it comes, over all bugs; also for the strategies with ``column="strategy"``."""
    reason = F.explode(column) if dict(results.dtypes)[column].startswith("array") else F.col(column)
    return results.select(reason.alias("reason")).where("reason is not null and reason <> ''").groupBy("reason").agg(F.count("*").alias("n"))
