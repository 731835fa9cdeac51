"""Diverse representatives of each cluster: farthest-first from the medoid, and greedy determinantal selection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.operators.cluster import matrix


def farthest_first_order(x: np.ndarray, most: int) -> list[int]:
    """Medoid first, then the point farthest from all chosen (cosine); ties go to the lower index."""
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = u.mean(0)
    out = [int(np.argmax(np.round(u @ centre, 9)))]
    far = 1 - u @ u[out[0]]
    while len(out) < min(most, len(u)):
        far[out] = -np.inf
        out.append(int(np.argmax(np.round(far, 9))))
        far = np.minimum(far, 1 - u @ u[out[-1]])
    return out


def greedy_dpp_order(x: np.ndarray, most: int, least: float = 1e-14) -> list[int]:
    """Greedy maximum determinant: largest residual norm, then deflation; stops when nothing is left."""
    residual = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    left, out = np.ones(len(x), bool), []
    while len(out) < min(most, len(x)):
        size = np.where(left, np.einsum("ij,ij->i", residual, residual), -1.0)
        i = int(np.argmax(np.round(size, 12)))
        if size[i] <= least:
            break
        out.append(i)
        left[i] = False
        q = residual[i] / np.sqrt(size[i])
        residual = residual - np.outer(residual @ q, q)
    return out


def representatives(df: DataFrame, per_cluster: int, method: str = "farthest_first", cluster: str = "label", id_column: str = "vec_id", column: str = "embedding", most: int = 20_000) -> DataFrame:
    """(cluster_id, rank, id); ties go to the smaller id, so results don't depend on partitioning.

    Clusters of up to ``most`` rows are solved in one task each; with a larger one all go by rounds, each a grouped maximum
    over all rows, which gives the same picks. Null vectors take no part.
    """
    order = {"farthest_first": farthest_first_order, "kdpp": greedy_dpp_order}[method]
    rows = df.where(F.col(column).isNotNull()).select(F.col(cluster).cast("long").alias("cluster_id"), F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))
    largest = rows.groupBy("cluster_id").count().agg(F.max("count")).first()[0] or 0
    if largest > most:
        return _by_rounds(rows, per_cluster, method)

    def pick(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        chosen = order(np.stack(g["v"].to_numpy()), per_cluster)
        return pd.DataFrame({"cluster_id": g["cluster_id"].iloc[0], "rank": range(1, len(chosen) + 1), "id": g["id"].to_numpy()[chosen]})

    return rows.groupBy("cluster_id").applyInPandas(pick, "cluster_id long, rank int, id long")


def _scored(batches: Iterator[pa.RecordBatch], method: str, state: dict[int | None, tuple]) -> Iterator[tuple]:
    """(cluster, ids, unit vectors, scores) of each batch's rows of the clusters in ``state`` that aren't taken yet."""
    for batch in batches:
        keys, ids, x = batch.column("cluster_id").to_pandas().to_numpy(object), batch.column("id").to_numpy(), matrix(batch.column("v"))
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        place: dict[int | None, list[int]] = {}
        for i, key in enumerate(keys.tolist()):
            place.setdefault(None if key is None or key != key else int(key), []).append(i)
        for key, at in place.items():
            if key not in state:
                continue
            mean, taken, held = state[key]
            at = np.array(at)[~np.isin(ids[at], taken)]
            v = x[at]
            if method == "farthest_first":
                score = np.round((1 - v @ np.array(held).T).min(1) if held else v @ mean, 9)
            else:
                score = np.einsum("ij,ij->i", v, v)
                score = np.round(score - ((v @ np.array(held).T) ** 2).sum(1) if held else score, 12)
            if len(at):
                yield key, ids[at], v, score


def _table(rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"cluster_id": pa.int64(), "id": pa.int64(), "score": pa.float64(), "v": pa.list_(pa.float64())}
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds.values())], list(kinds))


def _by_rounds(rows: DataFrame, per_cluster: int, method: str) -> DataFrame:
    """One pick of each cluster per round: each batch's best first, then the best of all by a grouped maximum. The driver holds
    the picks and means alone: clusters times ``per_cluster`` + 1 vectors."""
    spark, diverse = rows.sparkSession, method == "farthest_first"
    kind = "cluster_id long, id long, score double, v array<double>"
    keys = [r["cluster_id"] for r in rows.select("cluster_id").distinct().collect()]
    state: dict[int | None, tuple] = {c: (None, [], []) for c in keys}

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, v, _ in _scored(batches, "kdpp", state):
            yield _table([(key, len(ids), 0.0, v.sum(0).tolist())])

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, ids, v, score in _scored(batches, method, state):
            i = np.lexsort((ids, -score))[0]
            yield _table([(key, int(ids[i]), float(score[i]), v[i].tolist())])

    if diverse:
        parts = rows.mapInArrow(sums, kind).select("cluster_id", F.col("id").alias("n"), F.posexplode("v").alias("pos", "x"))
        means = parts.groupBy("cluster_id", "pos").agg((F.sum("x") / F.sum("n")).alias("x")).groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("m"))
        state = {r["cluster_id"]: (np.array(r["m"]), [], []) for r in means.collect()}
    out: list[tuple] = []
    for rank in range(1, per_cluster + 1):
        found = rows.mapInArrow(best, kind).groupBy("cluster_id").agg(F.max_by(F.struct("id", "v", "score"), F.struct("score", -F.col("id"))).alias("b")).collect()
        found = [(r["cluster_id"], r["b"]) for r in found if diverse or r["b"]["score"] > 1e-14]
        for c, b in found:
            _, taken, held = state[c]
            v = np.array(b["v"])
            if not diverse:  # what is left of the pick beside those before it
                for q in held:
                    v = v - (v @ q) * q
                v = v / np.linalg.norm(v)
            taken.append(b["id"])
            held.append(v)
            out.append((c, rank, b["id"]))
        done = {c for c, _ in found}
        state = {c: x for c, x in state.items() if c in done}
        if not state:
            break
    return spark.createDataFrame(out, "cluster_id long, rank int, id long")
