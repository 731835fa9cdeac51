"""Exact batch search: the nearest rows of every row, block against block."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.operators.shared import written

#: Bounds: distinct vectors of a block, queries compared at once, bytes of a block's vectors.
BLOCK, AT_ONCE, BLOCK_BYTES = 8_192, 256, 4 << 20


def _nearest(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query's place, ids, squared distances) of the k nearest; ``ids`` has a row per vector, the smallest first, -1 for none."""
    norms = (x * x).sum(1)
    for i in range(0, len(q), AT_ONCE):
        part = q[i : i + AT_ONCE]
        own = (part * part).sum(1)[:, None]
        rough = norms + own - 2 * part @ x.T
        last = np.partition(rough, min(k, len(x)) - 1, 1)[:, min(k, len(x)) - 1 : min(k, len(x))]
        near = rough <= last + 2e-9 + 1e-12 * (norms.max() + own)  # all that the rounding of ``rough`` may hide
        for j in range(len(part)):
            at = np.flatnonzero(near[j])
            dist = ((x[at] - part[j]) ** 2).sum(1)
            found, dist = ids[at].ravel(), np.repeat(dist, ids.shape[1])
            found, dist = found[found >= 0], dist[found >= 0]
            best = np.lexsort((found, dist.round(9)))[:k]
            yield i + j, found[best], dist[best]


def batch_search(vectors: DataFrame, k: int = 5) -> DataFrame:
    """Per row its k nearest rows by squared distance, itself among them: query_id, vec_id, place, dist.

    ``vectors`` needs vec_id (0 or more) and embedding. Null vectors and those with null or non-finite components take no
    part; vectors are compared with those of their length. Ties at nine decimals go to the smaller vec_id. Repeated rows
    count once. Equal vectors are searched once, so a hot one costs no more than another. The work is the square of the
    distinct vectors; each block of them is one row, so pairs of blocks meet without exchanging copies.
    """
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    v = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine).distinct()
    first = v.withColumn("n", F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))).where(F.col("n") <= k)
    held = written(first.groupBy("v").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumns({"h": F.xxhash64("v"), "dims": F.size("v")}), "vectors")
    sizes = held.groupBy("dims").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))).alias("blocks"))
    dealt = held.join(F.broadcast(sizes), "dims").select("dims", F.pmod(F.xxhash64(F.lit("block"), "v"), F.col("blocks")).alias("block"), "v", "ids", "h")

    def to_row(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        x, ids = np.stack(rows["v"].to_numpy()).astype(float), np.full((len(rows), k), -1, np.int64)
        for i, own in enumerate(rows["ids"]):
            ids[i, : len(own)] = own
        return pd.DataFrame({"dims": [key[0]], "block": [key[1]], "x": [x.tobytes()], "ids": [ids.tobytes()], "h": [rows["h"].to_numpy(np.int64).tobytes()]})

    packed = written(dealt.groupBy("dims", "block").applyInPandas(to_row, "dims int, block long, x binary, ids binary, h binary"), "blocks")
    packed = packed.coalesce(max(1, packed.count()))  # no more partitions than blocks, as pairs of partitions are tasks
    asked = packed.select(F.col("dims").alias("asked_dims"), F.col("x").alias("q"), F.col("ids").alias("asked"), "h")
    pairs = packed.select("dims", "x", "ids").hint("shuffle_replicate_nl").join(asked, F.col("dims") == F.col("asked_dims")).select("dims", "x", "ids", "q", "asked", "h")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, *held in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x, q = (np.frombuffer(held[i], float).reshape(-1, dims) for i in (0, 2))
                ids, asked = (np.frombuffer(held[i], np.int64).reshape(-1, k) for i in (1, 3))
                h = np.frombuffer(held[4], np.int64)
                out: list[list] = [[], [], [], []]
                for i, found, dist in _nearest(q, x, ids, k):
                    for column, y in zip(out, (np.full(len(found), asked[i, 0]), np.full(len(found), h[i]), found, dist), strict=True):
                        column.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in out], ["rep", "h", "vec_id", "dist"])

    near = pairs.mapInArrow(scan, "rep long, h long, vec_id long, dist double")
    # a vector's answer goes by its smallest id and its hash, as an id may have several vectors
    order = Window.partitionBy("rep", "h").orderBy(F.round("dist", 9), "vec_id")
    near = near.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    named = v.join(held.select("v", F.col("ids")[0].alias("rep"), "h"), "v").select(F.col("vec_id").alias("query_id"), "rep", "h")
    return named.join(near, ["rep", "h"]).select("query_id", "vec_id", "place", "dist")


def nearest_of(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """Per query its k nearest rows by squared distance, by a scan: query_id, place, vec_id, dist.

    ``queries`` needs query_id and embedding, ``vectors`` vec_id and embedding; both leave out what ``batch_search`` does, and
    repeated rows count once. Ties at nine decimals go to the smaller vec_id. Queries are packed, and each pack meets each
    block of vectors in one task that gives its k best; packs are copied once a block, vectors once a pack.
    """
    fine = ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & (F.size("embedding") > 0)
    v = vectors.where(F.col("vec_id").isNotNull() & fine).select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).distinct()
    q = queries.where(F.col("query_id").isNotNull() & fine).select(F.col("query_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).distinct()

    def packed(rows: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
        """(rows of packs, number of parts by dims)."""

        def to_row(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({"dims": [key[0]], "part": [key[1]], "x": [np.stack(part["v"].to_numpy()).astype(float).tobytes()], "ids": [part["id"].to_numpy(np.int64).tobytes()]})

        rows = rows.withColumn("dims", F.size("v"))
        parts = rows.groupBy("dims").agg(F.ceil(F.count("*") / F.greatest(F.lit(1), F.least(F.lit(size), F.floor(F.lit(BLOCK_BYTES) / (8 * F.col("dims")))))).alias("parts"))
        dealt = rows.join(F.broadcast(parts), "dims").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.col("parts")))
        return dealt.select("dims", "part", "id", "v").groupBy("dims", "part").applyInPandas(to_row, "dims int, part long, x binary, ids binary"), parts

    (blocks, parts), (packs, _) = packed(v, BLOCK), packed(q, AT_ONCE)
    copies = packs.drop("part").join(F.broadcast(parts), "dims").select("dims", F.col("x").alias("q"), F.col("ids").alias("asked"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for dims, x, ids, q, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                names, out = np.frombuffer(asked, np.int64), [[], [], []]
                for i, found, dist in _nearest(np.frombuffer(q, float).reshape(-1, dims), np.frombuffer(x, float).reshape(-1, dims), np.frombuffer(ids, np.int64)[:, None], k):
                    for column, y in zip(out, (np.full(len(found), names[i]), found, dist), strict=True):
                        column.append(y)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(y)) for y in out], ["query_id", "vec_id", "dist"])

    near = copies.join(blocks, ["dims", "part"]).select("dims", "x", "ids", "q", "asked").mapInArrow(scan, "query_id long, vec_id long, dist double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.round("dist", 9), "vec_id"))
    return near.withColumn("place", place).where(F.col("place") <= k).select("query_id", "place", "vec_id", "dist")
