"""Clustering of vector tables: k-means and bisecting k-means of pyspark.ml, PCA, and agglomerative trees per group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import BisectingKMeans, KMeans
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Distances that a part of a tree's round holds at once.
CELLS = 2 << 20


def _vectors(df: DataFrame, column: str, cosine: bool) -> DataFrame:
    df = df.withColumn("_raw", array_to_vector(F.col(column).cast("array<double>")))
    return Normalizer(p=2.0, inputCol="_raw", outputCol="_v").transform(df) if cosine else df.withColumn("_v", F.col("_raw"))


def kmeans(df: DataFrame, k: int, column: str = "embedding", cosine: bool = True, seed: int = 42, rounds: int = 100) -> DataFrame:
    v = _vectors(df, column, cosine)
    return KMeans(k=k, seed=seed, maxIter=rounds, featuresCol="_v", predictionCol="cluster_id").fit(v).transform(v).drop("_raw", "_v")


def bisecting(df: DataFrame, k: int, column: str = "embedding", cosine: bool = True, seed: int = 42) -> DataFrame:
    v = _vectors(df, column, cosine)
    return BisectingKMeans(k=k, seed=seed, featuresCol="_v", predictionCol="cluster_id").fit(v).transform(v).drop("_raw", "_v")


def pca(df: DataFrame, k: int = 2, column: str = "embedding") -> DataFrame:
    v = _vectors(df, column, False)
    return PCA(k=k, inputCol="_v", outputCol="_p").fit(v).transform(v).withColumn("components", vector_to_array("_p")).drop("_raw", "_v", "_p")


def _lloyd(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Centres from farthest-point starts (no random draw); at most as many as there are distinct rows."""
    n = min(k, len(np.unique(x, axis=0)))
    centres = x[[0]]
    while len(centres) < n:
        far = np.min([((x - c) ** 2).sum(1) for c in centres], 0)
        centres = np.vstack([centres, x[int(np.argmax(far))]])
    for _ in range(rounds):
        label = np.argmin([((x - c) ** 2).sum(1) for c in centres], 0)
        centres = np.stack([x[label == c].mean(0) if (label == c).any() else centres[c] for c in range(n)])
    return centres


def hierarchical_kmeans(df: DataFrame, per_level: list[int], id_column: str = "vec_id", column: str = "embedding", rounds: int = 3, sample: int = 5000) -> DataFrame:
    """(id, path): each cluster is split again per level, and path holds the cluster of each level.

    A level starts from centres fitted on at most ``sample`` rows of each cluster (by a hash of the id) and refines them by
    ``rounds`` grouped means over all rows, summed batch by batch first. Only centres, bounded by the product of ``per_level``, and
    counts of hash ranges reach the driver. Null vectors take no part.
    """
    kind = "path string, centres array<array<double>>"
    rows = df.where(F.col(column).isNotNull()).select(id_column, F.col(column).cast("array<double>").alias("v"), F.lit("root").alias("path"))
    placed = f"{id_column} {rows.schema[id_column].dataType.simpleString()}, v array<double>, path string"
    for k in per_level:

        def fit(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(id_column)
            return pd.DataFrame({"path": [key[0]], "centres": [_lloyd(np.stack(g["v"].to_numpy()), k).tolist()]})  # noqa: B023

        centres = _centres(_first_by_hash(rows, id_column, sample).groupBy("path").applyInPandas(fit, kind))
        for _ in range(rounds):
            sums = rows.select("path", "v").mapInArrow(_summed(centres), "path string, c int, n long, v array<double>")
            means = sums.select("path", "c", "n", F.posexplode("v").alias("pos", "x")).groupBy("path", "c", "pos").agg((F.sum("x") / F.sum("n")).alias("x"))
            means = means.groupBy("path", "c").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("v"))
            centres = _centres(means.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("c", "v"))), lambda z: z["v"]).alias("centres")))
        rows = rows.mapInArrow(_split(centres), placed)
    return rows.select(id_column, "path")


def _first_by_hash(rows: DataFrame, id_column: str, most: int) -> DataFrame:
    """Of each path the first ``most`` rows by a hash of the id. Ranges of the hash are counted, so that only rows of those that
    hold the first ones are sorted."""
    place = F.shiftright(F.xxhash64(id_column), 54)
    last: dict[str, int] = {}
    seen: dict[str, int] = {}
    for r in rows.groupBy("path", place.alias("place")).count().orderBy("path", "place").collect():  # at most 1,024 a path
        if seen.get(r["path"], 0) < most:
            last[r["path"]] = r["place"]
        seen[r["path"]] = seen.get(r["path"], 0) + r["count"]
    if not last:
        return rows
    bound = F.create_map(*(F.lit(x) for item in last.items() for x in item))
    order = Window.partitionBy("path").orderBy(F.xxhash64(id_column), id_column)
    return rows.where(place <= F.element_at(bound, F.col("path"))).withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).drop("_n")


def _centres(df: DataFrame) -> dict[str, np.ndarray]:
    return {r["path"]: np.array(r["centres"]) for r in df.collect()}


def matrix(column: pa.Array) -> np.ndarray:
    """Rows of equally long vectors, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False).reshape(len(column), -1 if len(column) else 0)


def _nearest(batch: pa.RecordBatch, centres: dict[str, np.ndarray]) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray]]:
    """(path, places in the batch, vectors, place of the nearest centre) for each path in the batch."""
    paths, x = batch.column("path").to_numpy(zero_copy_only=False), matrix(batch.column("v"))
    for path in sorted(set(paths)):
        at = np.flatnonzero(paths == path)
        yield path, at, x[at], np.argmin([((x[at] - c) ** 2).sum(1) for c in centres[path]], 0)


def _summed(centres: dict[str, np.ndarray]) -> Callable:
    """Numbers and sums of each batch's rows by their path and nearest centre."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [(path, int(c), int((to == c).sum()), x[to == c].sum(0).tolist()) for path, _, x, to in _nearest(batch, centres) for c in np.unique(to)]
            yield pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.list_(pa.float64())))], ["path", "c", "n", "v"])

    return sums


def _split(centres: dict[str, np.ndarray]) -> Callable:
    """Rows with the place of the nearest centre added to their path."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            path = np.empty(batch.num_rows, object)
            for parent, at, _, to in _nearest(batch, centres):
                path[at] = [f"{parent}/{c}" for c in to]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(path, pa.string())], batch.schema.names)

    return split


def merge_tree(x: np.ndarray, linkage: str = "average", cosine: bool = False) -> list[tuple[int, int, float]]:
    """Merges (left, right, distance) by Lance and Williams' update; node n + i is the i-th merge. O(n**2) memory.

    Distances are Euclidean, or one minus the dot product of unit rows with ``cosine`` (not for ward)."""
    square = np.einsum("ij,ij->i", x, x)
    d = 1 - x @ x.T if cosine else np.sqrt(np.maximum(0, square[:, None] + square[None] - 2 * x @ x.T))
    if linkage == "ward":
        d = d**2
    return _merged(d, np.ones(len(x)), linkage)


def _merged(d: np.ndarray, size: np.ndarray, linkage: str) -> list[tuple[int, int, float]]:
    """The merges of clusters with these distances (squared for ward) and sizes; both are changed."""
    n = len(d)
    np.fill_diagonal(d, np.inf)
    name, alive, out = list(range(n)), np.ones(n, bool), []
    for step in range(n - 1):
        i, j = divmod(int(np.argmin(d)), n)
        i, j = min(i, j), max(i, j)
        best = d[i, j]
        a, b = d[i], d[j]
        if linkage == "single":
            new = np.minimum(a, b)
        elif linkage == "complete":
            new = np.where(np.isinf(a) | np.isinf(b), np.inf, np.maximum(a, b))
        elif linkage == "ward":
            new = ((size[i] + size) * a + (size[j] + size) * b - size * best) / (size[i] + size[j] + size)
        else:
            new = (size[i] * a + size[j] * b) / (size[i] + size[j])
        out.append((name[i], name[j], float(np.sqrt(best) if linkage == "ward" else best)))
        alive[j] = False
        new[~alive] = np.inf
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i] += size[j]
        name[i] = n + step
    return out


def _between(x: np.ndarray, w: np.ndarray, start: np.ndarray, size: np.ndarray, take: np.ndarray, linkage: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(clusters, their distances from all) for the clusters ``take``, in parts of bounded memory.

    ``x`` and ``w`` hold the points and their numbers of copies, sorted by cluster, or for ward the centres."""
    square, many = np.einsum("ij,ij->i", x, x), max(1, CELLS // len(x))
    merge = {"single": np.minimum, "complete": np.maximum}.get(linkage, np.add)
    count, copied = np.diff(np.append(start, len(x))), bool((w != 1).any())
    ends = np.cumsum(count[take])
    i = 0
    while i < len(take):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + many, "right")))
        part = take[i:j]
        rows = np.concatenate([np.arange(start[c], start[c] + count[c]) for c in part])
        of = np.repeat(np.arange(len(part)), count[part])
        got = np.full((len(part), len(start)), {"single": np.inf, "complete": -np.inf}.get(linkage, 0.0))
        for at in range(0, len(rows), many):  # a large cluster takes several turns
            r, o = rows[at : at + many], of[at : at + many]
            d = (-2 * x[r]) @ x.T
            d += square
            d += square[r][:, None]
            np.maximum(d, 0, out=d)
            if linkage == "ward":
                d *= 2 * size[part][o][:, None] * size / (size[part][o][:, None] + size)
            else:
                np.sqrt(d, out=d)
                if linkage == "average" and copied:
                    d *= w
                    d *= w[r][:, None]
                d = merge.reduceat(d, start, axis=1) if len(start) < len(x) else d
            first = np.flatnonzero(np.diff(o, prepend=-1))
            got[o[first]] = merge(got[o[first]], merge.reduceat(d, first, axis=0))
        yield part, got / (size[part][:, None] * size) if linkage == "average" else got
        i = j


def merge_rounds(x: np.ndarray, w: np.ndarray, linkage: str = "average", most: int = 2_000) -> list[tuple[int, int, float]]:
    """The merges of ``merge_tree`` over distinct rows with ``w`` copies each, in memory that grows as the rows.

    Clusters that are each other's nearest merge in rounds, which gives the same tree for these linkages; only clusters that
    merged, or whose nearest did, look for their nearest again. From ``most`` clusters on their distances are one matrix."""
    n, start, size, of = len(x), np.arange(len(x)), w.astype(float), np.arange(len(x))
    w, name, height, out = size.copy(), np.arange(n), np.zeros(n), []
    nearest, dist = np.zeros(n, np.int64), np.zeros(n)
    todo = np.arange(n)
    while len(size) > most:
        for part, d in _between(x, w, start, size, todo, linkage):
            d[np.arange(len(part)), part] = np.inf
            dist[part] = d.min(1)
            nearest[part] = (d <= dist[part][:, None] + 1e-12).argmax(1)  # the first of those that rounding alone tells apart
        here = np.arange(len(size))
        left = np.flatnonzero((nearest[nearest] == here) & (here < nearest))
        if not len(left):  # distances that differ by their rounding alone
            left = np.array([dist.argmin()])
        right = nearest[left]
        high = np.maximum(np.sqrt(dist[left]) if linkage == "ward" else dist[left], np.maximum(height[left], height[right]))
        out += zip(name[left].tolist(), name[right].tolist(), high.tolist(), strict=True)
        if linkage == "ward":
            both = size[left] + size[right]
            x[left] = (x[left] * size[left][:, None] + x[right] * size[right][:, None]) / both[:, None]
        name[left], height[left] = n + len(out) - len(left) + np.arange(len(left)), high
        size[left] += size[right]
        changed = np.zeros(len(size), bool)
        changed[left] = changed[right] = True
        again = changed | changed[nearest]
        keep = np.ones(len(size), bool)
        keep[right] = False
        to = np.cumsum(keep) - 1
        to[right] = to[left]
        nearest, dist, again, name, height, size = to[nearest][keep], dist[keep], again[keep], name[keep], height[keep], size[keep]
        if linkage == "ward":
            x, start, w = x[keep], np.arange(len(size)), size
        else:
            of = to[of]
            order = np.argsort(of, kind="stable")
            x, w, of = x[order], w[order], of[order]
            start = np.flatnonzero(np.diff(of, prepend=-1))
        todo = np.flatnonzero(again)
    d = np.empty((len(size), len(size)))
    for part, got in _between(x, w, start, size, np.arange(len(size)), linkage):
        d[part] = got
    base = n + len(out)
    known = lambda c: int(name[c]) if c < len(name) else base + c - len(name)
    last = _merged((d + d.T) / 2, size.copy(), linkage)
    tops = dict(zip(name.tolist(), height.tolist(), strict=True))
    for a, b, far in last:
        a, b = known(a), known(b)
        tops[n + len(out)] = far = max(far, tops[a], tops[b])
        out.append((a, b, far))
    order = np.argsort([far for _, _, far in out], kind="stable")  # a node comes after those below it
    place = np.empty(len(out), np.int64)
    place[order] = np.arange(len(out))
    renamed = lambda c: c if c < n else n + int(place[c - n])
    return [(renamed(out[i][0]), renamed(out[i][1]), out[i][2]) for i in order]


def cuts(x: np.ndarray, ks: list[int], linkage: str, direct: int = 2_000) -> list[list[int]]:
    """Labels of the rows for every k, in first-seen order. Beyond ``direct`` rows copies merge first, at distance 0, and the
    tree is that of ``merge_rounds`` over the distinct rows."""
    n = len(x)
    if n <= direct:
        tree = merge_tree(x, linkage)
        return [cut_tree(tree, n, min(k, n)) for k in ks]
    _, first, of, copies = np.unique(x, axis=0, return_index=True, return_inverse=True, return_counts=True)
    order = np.argsort(first)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    of = place[of.ravel()]
    tree, out = merge_rounds(x[first[order]], copies[order], linkage, direct), []
    for k in ks:
        label = np.array(cut_tree(tree, len(order), min(k, len(order))))[of]
        if k > len(order):  # more clusters than distinct rows: the last copies stay alone
            again = np.ones(n, bool)
            again[first] = False
            alone = np.array(sorted(np.flatnonzero(again), key=lambda i: (of[i], i))[max(0, n - k) :], np.int64)
            label[alone] = n + alone
        seen: dict[int, int] = {}
        out.append([seen.setdefault(c, len(seen)) for c in label.tolist()])
    return out


def cut_tree(tree: list[tuple[int, int, float]], n: int, k: int) -> list[int]:
    """Labels in first-seen order after the first n - k merges."""
    parent = list(range(2 * n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for s, (a, b, _) in enumerate(tree[: max(0, n - k)]):
        parent[find(a)] = parent[find(b)] = n + s
    label: dict[int, int] = {}
    return [label.setdefault(find(i), len(label)) for i in range(n)]


def agglomerative(df: DataFrame, ks: list[int], linkage: str = "average", group: str | None = None, id_column: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(group, id, k, cluster_id) for every k from one tree per group. A group of any size is one task, whose memory grows as
    its rows and whose time as their square; null vectors take no part."""
    rows = df.where(F.col(column).isNotNull()).select((F.col(group).cast("string") if group else F.lit("all")).alias("grp"), F.col(id_column).cast("long").alias("id"), F.col(column).cast("array<double>").alias("v"))

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("id")
        x = np.stack(g["v"].to_numpy())
        x = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        return pd.concat([pd.DataFrame({"grp": g["grp"], "id": g["id"], "k": k, "cluster_id": label}) for k, label in zip(ks, cuts(x, ks, linkage), strict=True)])

    return rows.groupBy("grp").applyInPandas(solve, "grp string, id long, k int, cluster_id int")


def merge_small(df: DataFrame, smallest: int, threshold: float, linkage: str = "average", cluster: str = "label", column: str = "embedding", most: int = 5000) -> DataFrame:
    """(cluster_id, merged_id): clusters of at most ``smallest`` rows are grouped by cosine distance of their centres; merges
    up to ``threshold`` hold, and groups are numbered -1, -2, ... by their least cluster. Others, and a small one that is
    alone, keep their id. Centres come from grouped sums; beyond ``most`` small clusters is an error."""
    sizes = df.groupBy(F.col(cluster).cast("long").alias("cluster_id")).agg(F.count("*").alias("size"))
    means = df.where(F.col(column).isNotNull()).select(F.col(cluster).cast("long").alias("cluster_id"), F.posexplode(column).alias("pos", "x")).groupBy("cluster_id", "pos").agg(F.avg("x").alias("x"))
    centres = means.groupBy("cluster_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))), lambda z: z["x"]).alias("v"))
    small = sizes.where(F.col("size") <= smallest).select("cluster_id").join(centres, "cluster_id")

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        if len(g) > most:
            raise ValueError(f"{len(g)} small clusters; at most {most} can be merged by similarity")
        g = g.sort_values("cluster_id")
        if len(g) < 2:
            return g.assign(merged_id=g["cluster_id"])[["cluster_id", "merged_id"]]
        x = np.stack(g["v"].to_numpy())
        u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
        tree = merge_tree(u, linkage, cosine=True)
        label = cut_tree(tree, len(g), len(g) - sum(d <= threshold for _, _, d in tree))
        return pd.DataFrame({"cluster_id": g["cluster_id"].to_numpy(), "merged_id": [-1 - c for c in label]})

    merged = small.groupBy(F.lit(0).alias("all")).applyInPandas(solve, "cluster_id long, merged_id long")
    return sizes.select("cluster_id").join(merged, "cluster_id", "left").select("cluster_id", F.coalesce("merged_id", "cluster_id").alias("merged_id"))
