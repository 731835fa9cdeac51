"""Approximate nearest neighbours by an adaptive dimension scan (operator 9).

Vectors are scaled to unit length, rotated by a fixed random rotation and dealt to inverted lists (k-means on a bounded
sample; every row is indexed). Within each probed list the rotated vectors are scanned in column blocks: after d of D
dimensions the partial squared distance is an unbiased estimate d/D of the whole, so a candidate is abandoned as soon as
the hypothesis that it lies within the current fifth distance is rejected. Survivors get the exact cosine of the original
vectors in double precision. Lists are cut into blocks of bounded rows and query batches of bounded rows, so a list that
holds a third of all vectors is scanned by many tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize

#: Bounds: rows the lists are fitted on, lists, rows of a list and queries in one task.
SAMPLE, MOST_LISTS, BLOCK, QUERIES = 20_000, 1024, 16_384, 4_096
#: Rows up to which queries visit every list.
SMALL = 4_096


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    return np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))[0]


def fit_lists(x: np.ndarray, lists: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Spherical k-means centres of distinct unit vectors."""
    x = np.unique(x, axis=0)
    centres = x[np.random.default_rng(seed).permutation(len(x))[:lists]].copy()
    for _ in range(rounds):
        label = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, 1) for i in range(0, len(x), 4096)])
        sums = np.zeros_like(centres)
        np.add.at(sums, label, x)
        norm = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norm > 0, sums / np.maximum(norm, 1e-12), centres)
    return centres


def scan_block(q: np.ndarray, x: np.ndarray, k: int, width: int = 16, epsilon: float = 2.1) -> list[np.ndarray]:
    """For each rotated unit query the rows of ``x`` that survive the adaptive scan; all ties of the k-th distance do."""
    n, dims = x.shape
    out = []
    for v in q:
        if n <= k:
            out.append(np.arange(n))
            continue
        # the bound comes from a fixed slice of the block; it only tightens, so survivors hold the block's k nearest
        first = ((x[: min(n, 8 * k)] - v) ** 2).sum(1)
        bound = np.partition(first, k - 1)[k - 1] * (1 + 1e-6) + 1e-9
        alive, partial = np.arange(n), np.zeros(n, x.dtype)
        for d in range(0, dims, width):
            e = min(dims, d + width)
            part = x[alive, d:e] - v[d:e]
            partial = partial + np.einsum("ij,ij->i", part, part)
            if e < dims:
                keep = partial * (dims / e) <= bound * (1 + epsilon / np.sqrt(e)) ** 2
            else:
                keep = partial <= bound
            alive, partial = alive[keep], partial[keep]
            if e == dims and len(alive) > k:
                cut = np.partition(partial, k - 1)[k - 1] * (1 + 1e-6) + 1e-9
                alive = alive[partial <= cut]
        out.append(alive)
    return out


def nearest(vectors: DataFrame, every: int = 50, k: int = 5, probed: float = 0.65) -> DataFrame:
    """Per query (rows whose vec_id is divisible by ``every``) its k nearest: query_id, rank, vec_id, score.

    ``vectors`` needs vec_id and embedding; other columns are ignored. Null and zero vectors and those with null or
    non-finite components take no part, nor do vectors of another length than most have. Ties go to the smaller vec_id.
    ``probed`` is the share of the lists that a query visits, nearest centres first; 0.65 gives a recall of 0.9 even on
    vectors without structure. Further lists follow until they hold ``k`` candidates, and all of them on tables of up to
    SMALL rows. A query's own row (its vec_id) is no candidate. Repeated rows count once. An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("embedding", lambda x: x != 0)
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & fine)
    v = v.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    shape = v.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dims").first()
    result = "query_id long, rank int, vec_id long, score double"
    if shape is None:
        return spark.createDataFrame([], result)
    dims, n = shape
    v = v.where(F.size("v") == dims)
    sample = v.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").toArrow()
    turn = rotation(dims)
    x = np.array(sample["v"].combine_chunks().flatten().to_numpy(), float).reshape(-1, dims)
    x = x / np.linalg.norm(x, axis=1, keepdims=True) @ turn
    lists = max(1, min(MOST_LISTS, int(np.sqrt(n) / 2), len(x)))
    model = spark.sparkContext.broadcast((turn, fit_lists(x, lists)))
    lists = len(model.value[1])
    probes = lists if n <= SMALL else max(1, int(np.ceil(probed * lists)))

    def nearness(column: pa.Array) -> np.ndarray:
        turn, centres = model.value
        raw = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        return raw / np.linalg.norm(raw, axis=1, keepdims=True) @ turn @ centres.T

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                label = np.argmax(nearness(b.column(1)), 1)
                yield pa.RecordBatch.from_arrays([pa.array(label.astype(np.int32)), pa.array(np.zeros(len(label), bool)), *b.columns], ["list", "asks", "vec_id", "v"])

    schema = "list int, asks boolean, vec_id long, v array<double>"
    placed = materialize(v.mapInArrow(assign, schema), "lists")
    held = np.zeros(lists, np.int64)
    for r in placed.groupBy("list").agg(F.count_distinct("vec_id").alias("n")).collect():  # at most MOST_LISTS rows
        held[r["list"]] = r["n"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                order = np.argsort(-nearness(b.column(1)), 1, kind="stable")
                # one more than k, as the query's own row may be among them
                visits = np.maximum(probes, (np.cumsum(held[order], 1) < k + 1).sum(1) + 1)
                visited = np.arange(lists) < visits[:, None]
                rows = pa.array(np.nonzero(visited)[0])
                yield pa.RecordBatch.from_arrays([pa.array(order[visited].astype(np.int32)), pa.array(np.ones(len(rows), bool)), b.column(0).take(rows), b.column(1).take(rows)], ["list", "asks", "vec_id", "v"])

    asking = materialize(v.where(F.col("vec_id") % every == 0).mapInArrow(ask, schema), "asks")
    dealt = placed.unionByName(asking)
    sizes = dealt.groupBy("list").agg(F.count_if(~F.col("asks")).alias("rows"), F.count_if("asks").alias("asked"))
    sizes = sizes.select("list", F.ceil(F.greatest("rows", F.lit(1)) / BLOCK).cast("int").alias("cs"), F.ceil(F.greatest("asked", F.lit(1)) / QUERIES).cast("int").alias("qs"))
    dealt = dealt.join(F.broadcast(sizes), "list")  # at most MOST_LISTS rows
    c_own, q_own = F.pmod(F.xxhash64("vec_id"), F.col("cs").cast("long")).cast("int"), F.pmod(F.xxhash64("vec_id"), F.col("qs").cast("long")).cast("int")
    every_c, every_q = F.sequence(F.lit(0), F.col("cs") - 1), F.sequence(F.lit(0), F.col("qs") - 1)
    rows = dealt.where("not asks").select("list", c_own.alias("c"), F.explode(every_q).alias("q"), "vec_id", "v")
    asked = dealt.where("asks").select(F.col("list").alias("list"), F.explode(every_c).alias("c"), q_own.alias("q"), F.col("vec_id").alias("vec_id"), F.col("v").alias("v"))

    def scan(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": np.empty(0, np.int64), "vec_id": np.empty(0, np.int64), "score": np.empty(0)})
        if not len(left) or not len(right):
            return empty
        left = left.drop_duplicates("vec_id").sort_values("vec_id")
        right = right.drop_duplicates("vec_id").sort_values("vec_id")
        turn = model.value[0]
        ids, own = left["vec_id"].to_numpy(), right["vec_id"].to_numpy()
        x, q = np.stack(left["v"].to_numpy()), np.stack(right["v"].to_numpy())
        nx, nq = np.linalg.norm(x, axis=1), np.linalg.norm(q, axis=1)
        found: list[tuple] = []
        # one more than k, as the query's own row may be among them
        for i, alive in enumerate(scan_block(q / nq[:, None] @ turn, x / nx[:, None] @ turn, k + 1)):
            alive = alive[ids[alive] != own[i]]
            # each pair alone, so that equal vectors get equal scores whatever stands beside them
            score = np.array([np.dot(x[a], q[i]) / (nx[a] * nq[i]) for a in alive])
            best = np.lexsort((ids[alive], -score))[:k]
            found.append((np.full(len(best), own[i]), ids[alive][best], score[best]))
        return pd.DataFrame({c: np.concatenate([f[j] for f in found]) for j, c in enumerate(("query_id", "vec_id", "score"))})

    pairs = rows.groupBy("list", "c", "q").cogroup(asked.groupBy("list", "c", "q")).applyInPandas(scan, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
