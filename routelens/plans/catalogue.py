"""Named queries of the engine, and their SQL for another engine where it exists."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import DataFrame, SparkSession

from routelens.adapters import run_sql, with_views
from routelens.plans import code, experiments, files, operators, reports

_SQL = reports.QUERIES | experiments.QUERIES


def _sql_query(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return run_sql(spark, sf_dir, sql)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: partial(_sql_query, sql=q if isinstance(q, str) else q[0]) for k, q in _SQL.items()}
    return found | operators.queries() | code.queries() | files.queries()


def oracle_sql() -> dict[str, str]:
    found = {k: with_views(q if isinstance(q, str) else q[1], duck=True) for k, q in _SQL.items()}
    return found | operators.oracle_sql() | code.oracle_sql() | files.oracle_sql()
