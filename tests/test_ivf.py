"""IVF indexes: recall against a scan, only probed lists read, metrics, edge cases; a store with several writers."""

from __future__ import annotations

import shutil
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.operators import ivf
from routelens.operators.store import VectorStore


def frame(spark, x, key="id"):
    return spark.createDataFrame([(f"v{i:05d}", row.tolist(), "x") for i, row in enumerate(x)], f"{key} string, embedding array<double>, list string")


def nearest(x, q, k, metric):
    if metric == "cosine":
        norms = np.sqrt((x * x).sum(1)) * np.sqrt((q * q).sum())
        dist = np.where(norms > 0, 1 - (x @ q) / np.maximum(norms, 1e-300), 1.0)
    else:
        dist = ((x - q) ** 2).sum(1) if metric == "l2" else -(x @ q)
    return [f"v{i:05d}" for i in np.lexsort((np.arange(len(x)), dist))[:k]], np.sort(dist)[:k]


@pytest.mark.parametrize("kind,metric", [("ivf_pq", "cosine"), ("ivf_pq", "l2"), ("ivf_pq", "ip"), ("ivf_flat", "cosine")])
def test_recall(spark, tmp_path, kind, metric):
    """Vectors without structure, the hardest case: the calibrated number of lists reaches the recall."""
    x = np.random.default_rng(1).normal(size=(3000, 32))
    index = ivf.IVFIndex.build(frame(spark, x), f"{tmp_path}/index", kind, metric)
    found = {}
    for r in index.search(frame(spark, x[::60], "query_id"), 10).collect():
        found.setdefault(int(r["query_id"][1:]) * 60, []).append((r["rank"], r["id"], r["dist"]))
    hits = 0
    for q, rows in found.items():
        want, dist = nearest(x, x[q], 10, metric)
        assert [r[0] for r in sorted(rows)] == list(range(1, 11))
        hits += len(set(want) & {r[1] for r in rows})
        for _, i, d in rows:
            assert abs(d - nearest(x[int(i[1:])][None], x[q], 1, metric)[1][0]) < 1e-9
    assert len(found) == 50 and hits / 500 >= 0.9
    assert index.facts["probes"] < index.facts["lists"]


def test_recall_on_given_vectors(spark, tmp_path):
    """Recall at 10 against the store's scan on sf0.1."""
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    store = VectorStore(spark, f"{tmp_path}/store")
    store.add(rows)
    index = store.build_index()
    asked = rows.where("cast(id as int) % 200 = 0").withColumnRenamed("id", "query_id")
    got = {}
    for r in store.search(asked, 10).collect():
        got.setdefault(r["query_id"], set()).add(r["id"])
    hits = sum(len(got[r["query_id"]] & {x["id"] for x in store.similar(list(map(float, r["embedding"])), 10).collect()}) for r in asked.collect())
    assert hits / (10 * len(got)) >= 0.9 and index.facts["rows"] == 2000
    assert VectorStore(spark, f"{tmp_path}/store").search(asked, 3).count() == 3 * len(got)


def test_only_probed_lists_are_read(spark, tmp_path):
    r = np.random.default_rng(2)
    x = np.concatenate([r.normal(size=(200, 8)) + 20 * np.eye(8)[i] for i in range(4)])
    index = ivf.IVFIndex.build(frame(spark, x), f"{tmp_path}/index", "ivf_pq", "l2", lists=4, probes=1)
    near = index.search(frame(spark, x[:1], "query_id"), 5).collect()
    assert [y["id"] for y in near] == nearest(x, x[0], 5, "l2")[0]
    read = int(np.argmin(((index.centres - x[0]) ** 2).sum(1)))
    for part in ("vectors", "blocks"):
        for folder in Path(f"{tmp_path}/index/{part}").glob("list=*"):
            if folder.name != f"list={read}":
                for file in folder.glob("*.parquet"):
                    file.write_bytes(b"broken")
                    (folder / f".{file.name}.crc").unlink(missing_ok=True)
    assert index.search(frame(spark, x[:1], "query_id"), 5).collect() == near


def test_edges(spark, tmp_path):
    x = np.array([[1.0, 0.0, 0, 0]] * 40 + [[0.0, 0, 0, 0]] + [[0, 1.0, 0, 0]])
    rows = frame(spark, x).unionByName(spark.createDataFrame([(None, [1.0] * 4, "x"), ("nan", [float("nan")] * 4, "x"), ("null", None, "x"), ("hole", [None, 1.0, 1.0, 1.0], "x"), ("none", [], "x")], "id string, embedding array<double>, list string"))
    index = ivf.IVFIndex.build(rows, f"{tmp_path}/i", "ivf_pq", "cosine", lists=8)
    asked = spark.createDataFrame([("a", [1.0, 0.0, 0.0, 0.0]), ("b", [0.0] * 4), ("short", [1.0]), (None, [1.0] * 4), ("bad", [float("inf")] * 4)], "query_id string, embedding array<double>")
    got = index.search(asked, 50, probes=8).groupBy("query_id").agg(F.count("*").alias("n"), F.min(F.struct("rank", "id", "dist")).alias("first")).collect()
    assert {(y["query_id"], y["n"], y["first"]["id"], round(y["first"]["dist"], 9)) for y in got} == {("a", 42, "v00000", 0.0), ("b", 42, "v00000", 1.0)}
    assert index.search(asked.limit(0)).count() == 0
    with pytest.raises(ValueError):
        ivf.IVFIndex.build(rows.limit(0), f"{tmp_path}/empty")
    with pytest.raises(ValueError):
        ivf.IVFIndex.build(rows, f"{tmp_path}/kind", "graph")


def test_writers_at_the_same_time(spark, tmp_path):
    store, other = (VectorStore(spark, f"{tmp_path}/s") for _ in range(2))
    of = lambda name, v: spark.createDataFrame([(name, [v])], "id string, embedding array<double>")
    first = store.table._next()  # a writer that has its number and hasn't written yet
    assert other.add(of("a", 2.0)) == first + 1 and store.vectors().count() == 1
    of("a", 1.0).selectExpr("id", "string(null) folder", "embedding", "map('x', 'y') metadata").write.parquet(f"{tmp_path}/s/rows/version={first}")
    assert [y["embedding"] for y in store.vectors().collect()] == [[2.0]]
    store.add(of("b", 3.0))
    shutil.copytree(f"{tmp_path}/s/rows/version={first}", f"{tmp_path}/s/rows/version=99")
    Path(f"{tmp_path}/s/rows/version=99/_SUCCESS").unlink()  # a writer that died
    assert {(y["id"], y["embedding"][0]) for y in store.vectors().collect()} == {("a", 2.0), ("b", 3.0)}
