"""Places within groups of any size, numbered range by range, so that no group is sorted in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.operators.shared import written


def placed(rows: DataFrame, groups: list[str], order: list[str], name: str = "place") -> DataFrame:
    """``rows`` with their place (from 1) within their group in ascending order of ``order``; ties come in any order.

    Rows are dealt by ranges of group and order; a range counts the rows of each of its groups, and what lies in earlier ranges
    is added. A group of any size is spread over as many ranges as it needs. Null groups are one group, null keys come first.
    """
    dealt = written(rows.repartitionByRange(*groups, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    counts = dealt.groupBy(*groups, "_range").agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy(*groups).orderBy("_range")) - F.col("_n"))
    own = dealt.withColumn("_own", F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order)))
    same = [own[g].eqNullSafe(before[g]) for g in groups] + [own["_range"] == before["_range"]]
    return own.join(before, same).select(*(own[c] for c in rows.columns), (F.col("_own") + F.col("_before")).alias(name))
