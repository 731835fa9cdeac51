"""Inverted-file indexes over vectors, built and searched as Spark jobs.

Build: k-means centres of a bounded sample divide space in lists; every vector goes to its nearest. "ivf_pq" also splits
what a vector differs from its centre by into parts of a few dimensions, and writes each as the number of the nearest of 256
codewords (one codebook a part, each fitted in a task of its own). Lists are folders of Parquet files: codes packed in blocks
of a bounded size, and the vectors beside them. A list of any size is many blocks, so a hot one costs no more than others.

Search: queries go to their nearest lists, are packed by list as well, and meet its blocks; a pair of packs is one call of a
table lookup over all its queries and codes. Each query's best by codes are compared again by their vectors. Only folders of
lists that some query probes are read.

How many lists to probe is measured at build: on a bounded sample of rows, the true neighbours are found by a scan, and the
least number is kept with which the wanted share of them lies in probed lists.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from routelens.functions import vectors as V
from routelens.operators.shared import bounded_batches, written

#: Bounds: rows that centres and codebooks are fitted on, sampled queries of the calibration, lists, codewords of a part.
TRAIN_ROWS, TRIAL_ROWS, MOST_LISTS, CODES = 20_000, 256, 4096, 256
#: Codes of a block, queries of a pack, and copies of queries that are made at once.
BLOCK, QUERIES, PROBED = 16_384, 256, 8_192
KINDS, METRICS = ("ivf_flat", "ivf_pq"), ("cosine", "l2", "ip")


def _usable(rows: DataFrame, key: str) -> DataFrame:
    fine = F.col(key).isNotNull() & (F.size("embedding") > 0) & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.where(fine).select(F.col(key).cast("string").alias(key), F.col("embedding").cast("array<double>").alias("embedding"))


def _fitted(x: np.ndarray, k: int, seed: int, rounds: int = 15) -> np.ndarray:
    """Centres of Lloyd's rounds from k distinct rows (all of them, if fewer)."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centres = distinct[np.random.default_rng(seed).choice(len(distinct), k, replace=False)]
    for _ in range(rounds):
        near = np.argmin((centres * centres).sum(1) - 2 * x @ centres.T, 1)
        count = np.bincount(near, minlength=k)
        total = np.stack([np.bincount(near, x[:, i], k) for i in range(x.shape[1])], 1)
        centres = np.where(count[:, None] > 0, total / np.maximum(count, 1)[:, None], centres)
    return centres


def _matrix(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), float).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-300)


def _measured(x: np.ndarray, metric: str) -> np.ndarray:
    """Vectors as the index holds them: by cosine at unit length, where the nearest by angle are the nearest by distance."""
    return _unit(x) if metric == "cosine" else x


def _to_centres(x: np.ndarray, centres: np.ndarray, metric: str) -> np.ndarray:
    return -x @ centres.T if metric == "ip" else (centres * centres).sum(1) - 2 * x @ centres.T


def lookup_tables(q: np.ndarray, centre: np.ndarray, books: np.ndarray, metric: str) -> np.ndarray:
    """(queries, parts, codewords): what a codeword adds to a query's distance from a vector of that list."""
    parts, codes, width = books.shape
    if metric == "ip":
        own = (-q @ centre)[:, None, None] / parts
        return own - np.einsum("qpw,pcw->qpc", q.reshape(len(q), parts, width), books)
    rest = (q - centre).reshape(len(q), parts, 1, width)
    return ((rest - books[None]) ** 2).sum(3)


class IVFIndex:
    """An index in the folder ``path``, which the driver and all executors must share. See ``build`` and ``search``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        held = spark.read.schema("facts string, centres array<array<double>>, books array<array<array<double>>>").json(f"{self.path}/model").first()
        self.facts = json.loads(held["facts"])
        self.centres = np.array(held["centres"], float)
        self.books = np.array(held["books"], float) if held["books"] else None

    # build

    @classmethod
    def build(cls, rows: DataFrame, path: str, kind: str = "ivf_pq", metric: str = "cosine", lists: int | None = None, parts: int | None = None, probes: int | None = None, wanted: float = 0.97, neighbours: int = 10, seed: int = 0) -> "IVFIndex":
        """Write an index of ``rows`` (id, embedding; other columns are ignored) to ``path``, which must not exist.

        Every usable row is indexed: ids and vectors that are null, empty or hold null or non-finite components take no part.
        All vectors must have one length. Repeated ids are kept as often as they come. ``lists`` defaults to the square root
        of the rows, ``parts`` to a quarter of the dimensions, ``probes`` to the least number of lists that hold the
        ``wanted`` share of true neighbours. An empty table can't be indexed.
        """
        if kind not in KINDS or metric not in METRICS:
            raise ValueError(f"kind is one of {KINDS}, metric one of {METRICS}")
        bounded_batches(rows.sparkSession)
        spark, path, v = rows.sparkSession, path.rstrip("/"), _usable(rows, "id")
        n, least, dims = v.agg(F.count("*"), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
        if not n or least != dims:
            raise ValueError("an index needs vectors, all of one length")
        sample = v.orderBy(F.xxhash64(F.lit(seed), "id"), "id").limit(TRAIN_ROWS)
        if metric == "cosine":
            sample = sample.withColumn("embedding", V.l2_normalize(F.col("embedding"), 1e-300))
        sample = written(sample, "sample")
        lists = max(1, min(lists or math.isqrt(n), MOST_LISTS, n))
        model = KMeans(k=lists, seed=seed, maxIter=15, featuresCol="x").fit(sample.select(array_to_vector("embedding").alias("x")))
        centres = np.array(model.clusterCenters())
        parts = next(p for p in range(max(1, min(parts or max(1, dims // 4), dims)), 0, -1) if dims % p == 0)
        books = cls._books(sample, centres, parts, metric, seed) if kind == "ivf_pq" else None
        cls._encode(v, path, centres, books, metric)
        probes = probes or cls._calibrated(v, path, centres, metric, wanted, neighbours, seed)
        facts = {"kind": kind, "metric": metric, "dims": dims, "rows": n, "lists": len(centres), "parts": parts, "probes": min(probes, len(centres))}
        held = [(json.dumps(facts), centres.tolist(), books.tolist() if books is not None else None)]
        spark.createDataFrame(held, "facts string, centres array<array<double>>, books array<array<array<double>>>").write.json(f"{path}/model")
        return cls(spark, path)

    @staticmethod
    def _books(sample: DataFrame, centres: np.ndarray, parts: int, metric: str, seed: int) -> np.ndarray:
        """(parts, 256, width): codebooks of the sample's differences from their centres, each fitted by a task."""

        def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                x = _matrix(b.column(0))
                x = (x - centres[np.argmin(_to_centres(x, centres, metric), 1)]).reshape(len(x) * parts, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.tile(np.arange(parts, dtype=np.int32), len(b))), pa.array(x.tolist(), pa.list_(pa.float64()))], ["part", "x"])

        def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            found = _fitted(np.stack(rows["x"].to_numpy()), CODES, seed)
            return pd.DataFrame({"part": key[0], "codewords": [np.concatenate([found, np.repeat(found[:1], CODES - len(found), 0)]).tolist()]})

        found = sample.select("embedding").mapInArrow(rest, "part int, x array<double>").groupBy("part").applyInPandas(fit, "part int, codewords array<array<double>>")
        return np.array([r["codewords"] for r in found.orderBy("part").collect()], float)

    @staticmethod
    def _encode(v: DataFrame, path: str, centres: np.ndarray, books: np.ndarray | None, metric: str) -> None:
        """Write vectors/list=n and blocks/list=n."""
        spark = v.sparkSession
        held = spark.sparkContext.broadcast((centres, books))

        def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centres = held.value[0]
            for b in batches:
                if len(b):
                    near = np.argmin(_to_centres(_measured(_matrix(b.column(1)), metric), centres, metric), 1)
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(near.astype(np.int32))], ["id", "embedding", "list"])

        named = v.mapInArrow(listed, "id string, embedding array<double>, list int")
        # dealt by list and by a part of its ids, so that a hot list is written by several tasks
        named.repartition("list", F.pmod(F.xxhash64("id"), F.lit(16))).write.partitionBy("list").parquet(f"{path}/vectors")
        vectors = spark.read.schema("id string, embedding array<double>, list int").parquet(f"{path}/vectors")
        blocks = vectors.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
        dealt = vectors.join(F.broadcast(blocks), "list").withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            centres, books = held.value
            x = _measured(_matrix(rows.column("embedding").combine_chunks()), metric)
            if books is None:
                codes = x.tobytes()
            else:
                rest = (x - centres[key[0].as_py()]).reshape(len(x), books.shape[0], -1)
                codes = np.stack([np.argmin((b * b).sum(1) - 2 * rest[:, p] @ b.T, 1) for p, b in enumerate(books)], 1).astype(np.uint8).tobytes()
            return pa.table({"list": [key[0].as_py()], "block": [key[1].as_py()], "ids": [rows.column("id").to_pylist()], "codes": [codes]}, schema=pa.schema([("list", pa.int32()), ("block", pa.int32()), ("ids", pa.list_(pa.string())), ("codes", pa.binary())]))

        packed = dealt.select("list", "block", "id", "embedding").groupBy("list", "block").applyInArrow(pack, "list int, block int, ids array<string>, codes binary")
        packed.write.partitionBy("list").parquet(f"{path}/blocks")

    @staticmethod
    def _calibrated(v: DataFrame, path: str, centres: np.ndarray, metric: str, wanted: float, k: int, seed: int) -> int:
        """Least number of probed lists that hold the wanted share of the k nearest of sampled rows."""
        spark = v.sparkSession
        asked = np.array([r[0] for r in v.orderBy(F.xxhash64(F.lit(seed + 1), "id"), "id").limit(TRIAL_ROWS).select("embedding").collect()], float)
        held = spark.sparkContext.broadcast(_measured(asked, metric))

        def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = held.value
            best, lists = np.full((len(q), k), np.inf), np.full((len(q), k), -1, np.int64)
            for b in batches:
                x = _measured(_matrix(b.column(0)), metric)
                dist = np.concatenate([best, -q @ x.T if metric == "ip" else (x * x).sum(1) - 2 * q @ x.T], 1)
                where = np.concatenate([lists, np.broadcast_to(b.column(1).to_numpy(), (len(q), len(b)))], 1)
                order = np.argsort(dist, 1)[:, :k]
                best, lists = np.take_along_axis(dist, order, 1), np.take_along_axis(where, order, 1)
            there = lists.ravel() >= 0
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k)[there]), pa.array(best.ravel()[there]), pa.array(lists.ravel()[there])], ["q", "dist", "list"])

        found = spark.read.schema("id string, embedding array<double>, list int").parquet(f"{path}/vectors").select("embedding", "list").mapInArrow(nearest, "q long, dist double, list long")
        found = found.withColumn("place", F.row_number().over(Window.partitionBy("q").orderBy("dist"))).where(F.col("place") <= k).collect()
        rank = np.argsort(np.argsort(_to_centres(held.value, centres, metric), 1), 1)
        needed = np.sort([rank[r["q"], r["list"]] + 1 for r in found])
        return int(needed[min(len(needed) - 1, math.ceil(wanted * len(needed)))]) if len(needed) else 1

    # search

    def _packed(self, queries: DataFrame, probes: int) -> DataFrame:
        """Queries by list: list, pack, query_ids, qs (as the index measures them)."""
        centres, metric = self.centres, self.facts["metric"]

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            many = max(1, PROBED // probes)  # a query's vector goes out once a list
            for b in batches:
                for part in (b.slice(i, many) for i in range(0, len(b), many)):
                    x = _measured(_matrix(part.column(1)), metric)
                    near = np.argsort(_to_centres(x, centres, metric), 1, kind="stable")[:, :probes].astype(np.int32)
                    rows = np.repeat(np.arange(len(part)), near.shape[1])
                    offsets = np.arange(len(rows) + 1, dtype=np.int32) * (8 * x.shape[1])
                    q = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x[rows], float))])
                    yield pa.RecordBatch.from_arrays([pa.array(near.ravel()), part.column(0).take(pa.array(rows)), q], ["list", "query_id", "q"])

        asked = queries.mapInArrow(probe, "list int, query_id string, q binary")
        packs = asked.groupBy("list").agg(F.ceil(F.count("*") / QUERIES).cast("int").alias("packs"))

        def pack(key: tuple, rows: pa.Table) -> pa.Table:
            return pa.table({"list": [key[0].as_py()], "query_ids": [rows.column("query_id").to_pylist()], "qs": [b"".join(rows.column("q").to_pylist())]}, schema=pa.schema([("list", pa.int32()), ("query_ids", pa.list_(pa.string())), ("qs", pa.binary())]))

        dealt = asked.join(F.broadcast(packs), "list").withColumn("pack", F.pmod(F.xxhash64("query_id"), F.col("packs")).cast("int"))
        return dealt.select("list", "pack", "query_id", "q").groupBy("list", "pack").applyInArrow(pack, "list int, query_ids array<string>, qs binary")

    def search(self, queries: DataFrame, k: int = 10, probes: int | None = None, depth: int | None = None) -> DataFrame:
        """Per query its k nearest found: query_id, rank (from 1), id, dist.

        ``queries`` needs query_id and embedding (of the index's length; others, and unusable ones as in ``build``, find
        nothing). Distances are exact, by the index's metric: cosine distance (1 for zero vectors), squared Euclidean distance
        or negative inner product; ties go to the smaller id. ``depth`` codes a query are compared by their vectors (10 k).
        Of rows that repeat a query_id one vector is searched.
        """
        bounded_batches(self.spark)  # rows of blocks are long
        facts, centres, books, dims = self.facts, self.centres, self.books, self.facts["dims"]
        metric, depth, probes = facts["metric"], max(k, depth or 10 * k), min(probes or facts["probes"], facts["lists"])
        asked = _usable(queries, "query_id").where(F.size("embedding") == dims).groupBy("query_id").agg(F.min("embedding").alias("embedding"))
        packed = written(self._packed(asked, probes), "packs")
        wanted = [r[0] for r in packed.select("list").distinct().collect()]  # at most MOST_LISTS numbers
        only = F.col("list").isin(*wanted) if wanted else F.lit(False)
        blocks = self.spark.read.schema("block int, ids array<string>, codes binary, list int").parquet(f"{self.path}/blocks").where(only)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in range(len(b)):
                    n, names, ids = b.column(0)[i].as_py(), b.column(1)[i].as_py(), b.column(3)[i].as_py()
                    q = np.frombuffer(b.column(2)[i].as_py(), float).reshape(-1, dims)
                    if books is None:
                        x = np.frombuffer(b.column(4)[i].as_py(), float).reshape(-1, dims)
                        dist = -q @ x.T if metric == "ip" else (q * q).sum(1)[:, None] + (x * x).sum(1) - 2 * q @ x.T
                    else:
                        codes, dist = np.frombuffer(b.column(4)[i].as_py(), np.uint8).reshape(-1, len(books)), 0.0
                        tables = lookup_tables(q, centres[n], books, metric)
                        for p in range(len(books)):
                            dist = dist + tables[:, p][:, codes[:, p]]
                    m = min(depth, dist.shape[1])
                    best = np.argpartition(dist, m - 1, 1)[:, :m]
                    rows, at = np.repeat(np.arange(len(q)), m), best.ravel()
                    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()).take(pa.array(rows)), pa.array(np.full(len(rows), n, np.int32)), pa.array(ids, pa.string()).take(pa.array(at)), pa.array(dist[rows, at])], ["query_id", "list", "id", "rough"])

        near = packed.join(blocks, "list").select("list", "query_ids", "qs", "ids", "codes").mapInArrow(scan, "query_id string, list int, id string, rough double")
        near = near.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy("rough", "id"))).where(F.col("place") <= depth)
        vectors = self.spark.read.schema("id string, embedding array<double>, list int").parquet(f"{self.path}/vectors").where(only)
        pairs = near.select("query_id", "list", "id").distinct().join(vectors, ["list", "id"]).join(asked.withColumnRenamed("embedding", "q"), "query_id")
        dot, norms = V.dot(F.col("q"), F.col("embedding")), V.norm(F.col("q")) * V.norm(F.col("embedding"))
        dist = {"cosine": F.when(norms > 0, 1 - dot / norms).otherwise(1.0), "l2": V.squared_l2(F.col("q"), F.col("embedding")), "ip": -dot}[metric]
        ranked = pairs.select("query_id", "id", dist.alias("dist")).withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "id")))
        return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "dist")
