"""Operator 9 beyond the size at which small tables visit all lists: recall against brute force on vectors without structure."""

from __future__ import annotations

import numpy as np

from routelens.llm import neighbours


def test_recall_without_structure(spark):
    n = neighbours.SMALL + 1904
    x = np.random.default_rng(5).normal(size=(n, 24))
    got = {}
    for r in neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")).collect():
        got.setdefault(r["query_id"], {})[r["vec_id"]] = r["score"]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    hits = 0
    for q in range(0, n, 50):
        score = u @ u[q]
        score[q] = -2
        best = np.argsort(-score, kind="stable")[:5]
        assert len(got[q]) == 5 and all(abs(s - score[i]) < 1e-9 for i, s in got[q].items())
        hits += len(set(best.tolist()) & set(got[q]))
    assert set(got) == set(range(0, n, 50)) and hits >= 0.9 * 5 * len(got)
