"""Vector functions over array<float> and array<double> columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def l2_normalize(a: Column, least: float = 1e-12) -> Column:
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.greatest(n, F.lit(least)))


def cosine_distance(a: Column, b: Column, least: float = 1e-12) -> Column:
    return 1 - dot(a, b) / F.greatest(norm(a) * norm(b), F.lit(least))


def squared_l2(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, x: s + x)


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))
