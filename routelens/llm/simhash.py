"""SimHash near-duplicates by BK-trees (operator 13).

1. One scan gives each text its fingerprint. Equal fingerprints become one node with its smallest doc_id.
2. Fingerprints are dealt to shards such that any two within the radius of 2 bits share one: of four blocks of a word, two
   differing bits leave two blocks equal, so a shard is a pair of blocks and their values (six shards a fingerprint). A shard
   of more than ``most`` fingerprints is dealt again by the bits that its members don't share yet, which ends after two
   more steps with at most 256 members. So no shard outgrows a task, however alike the texts are, and nothing is capped.
3. A task builds each shard's BK-tree: children are keyed by the integer Hamming distance to their parent. Each member
   follows only edges within the radius of its own distance, and is then added.
4. Links (a spanning forest of each shard) are joined to components; each takes its smallest doc_id. Documents learn it by
   their fingerprint: those of the few fingerprints that many share by a broadcast of a bounded number of rows, the others by
   an exchange.

The trees stay in the tasks that build them, and probes come to them by the exchange: a broadcast of all trees would
gather every fingerprint on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize, release
from routelens.llm.components import connected_components

RADIUS, BLOCKS = 2, 4
#: Fingerprints of a shard, beyond which it is dealt again; and the most fingerprints that can each hold that part of all rows.
MOST, HOT = 512, 1000
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def text_fingerprint(text: bytes, k: int = 3, seed: int = 42) -> bytes:
    """Eight bytes, highest first; a bit is 1 if it is set in over half the shingles' hashes."""
    words = text.translate(_LOWER).split()
    if not words:
        return bytes(8)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *ends[:-1].tolist()]
    stops = (ends - 1).tolist()[min(k, len(words)) - 1 :]
    total, n = np.zeros(64, np.int64), len(stops)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, 1 << 16):  # bounds the bits held at once
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[i : i + (1 << 16)], stops[i : i + (1 << 16)], strict=False)], ">u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return np.packbits(2 * total > n).tobytes()


class BKTree:
    """Values under Hamming distance; a child's key is its distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> None:
        at = 0
        if self.values:
            while True:
                d = (self.values[at] ^ value).bit_count()
                if not d:
                    return
                to = self.children[at].get(d)
                if to is None:
                    self.children[at][d] = len(self.values)
                    break
                at = to
        self.values.append(value)
        self.children.append({})

    def within(self, value: int, radius: int) -> Iterator[int]:
        """Values at most ``radius`` away; of a node's edges only those within the radius of its distance are followed."""
        stack = [0] if self.values else []
        values, children = self.values, self.children
        while stack:
            at = stack.pop()
            d = (values[at] ^ value).bit_count()
            if d <= radius:
                yield values[at]
            edges = children[at]
            if len(edges) > 2 * radius + 1:
                for x in range(d - radius, d + radius + 1):
                    if x in edges:
                        stack.append(edges[x])
            else:
                stack += [to for x, to in edges.items() if -radius <= x - d <= radius]


def shard_links(values: list[int], radius: int = RADIUS) -> list[tuple[int, int]]:
    """A spanning forest of the values' links within the radius."""
    tree, top, links = BKTree(), {v: v for v in values}, []

    def find(x: int) -> int:
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for v in values:
        for other in tree.within(v, radius):
            a, b = find(v), find(other)
            if a != b:
                top[max(a, b)] = min(a, b)
                links.append((v, other))
        tree.add(v)
    return links


def _fingerprints(k: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = b"".join(text_fingerprint((t.as_py() or "").encode(), k) for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], ["doc_id", "f"])

    return rows


def _deal(shards: DataFrame, width: int) -> DataFrame:
    """(f, g: shard, v: its bits that the shard's members don't share, ``width`` of them) to the six shards of the next step."""
    part = width // BLOCKS
    mask = (1 << part) - 1
    block = [F.shiftrightunsigned("v", i * part).bitwiseAND(F.lit(mask)) for i in range(BLOCKS)]
    out = []
    for i, j in combinations(range(BLOCKS), 2):
        p, q = (x for x in range(BLOCKS) if x not in (i, j))
        out.append(F.struct("f", F.xxhash64("g", F.lit(10 * i + j), block[i], block[j]).alias("g"), F.shiftleft(block[p], part).bitwiseOR(block[q]).alias("v")))
    return shards.select(F.inline(F.array(*out)))


def _links(shards: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members = None, []

        def done() -> pa.RecordBatch:
            links = shard_links(members)
            return pa.RecordBatch.from_arrays([pa.array([x[i] for x in links], pa.uint64()).view(pa.int64()) for i in (0, 1)], ["a", "b"])

        for b in batches:
            for g, f in zip(b.column(0).to_pylist(), b.column(1).view(pa.uint64()).to_pylist(), strict=True):
                if g != key:
                    if len(members) > 1:
                        yield done()
                    key, members = g, []
                members.append(f)
        if len(members) > 1:
            yield done()

    return shards.select("g", "f").repartition("g").sortWithinPartitions("g", "f").mapInArrow(rows, "a long, b long")


def simhash_components(docs: DataFrame, k: int = 3, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable by links).

    Documents link when their fingerprints differ in at most two bits. ``docs`` needs doc_id and text; other columns are
    ignored, whatever their names. Null and empty texts and texts without words have fingerprint zero, linked like any
    other. Repeated rows each get a row; rows that share a doc_id with different texts are documents of their own. A null
    doc_id links as others do but names no component: a component without any id has a null one. Very long texts are
    handled whole. An empty table gives an empty result. ``most`` bounds what a task holds at a time, never the result;
    256 is the least that it can bound.
    """
    bounded_batches(docs.sparkSession)
    rows = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_fingerprints(k), "doc_id long, f long"), "simhash")
    unique = materialize(rows.groupBy("f").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n")), "simhashes")
    shards, links, width = unique.select("f", F.lit(0).cast("long").alias("g"), F.col("f").alias("v")), None, 64
    while width > 8:
        dealt, width = materialize(_deal(shards, width), "shards"), width // 2
        sizes = dealt.groupBy("g").agg(F.count("*").alias("c")).where("c > 1")
        sized = materialize(dealt.join(sizes, "g"), "sized")
        fits = F.col("c") <= most if width > 8 else F.lit(True)
        found = materialize(_links(sized.where(fits)), "links")
        links = found if links is None else links.unionByName(found)
        shards = sized.where(~fits).drop("c")
        release(dealt)
        if not shards.limit(1).count():
            break
    joined = materialize(connected_components(links), "joined")
    least = joined.join(unique, joined["node"] == unique["f"]).groupBy("component").agg(F.min("rep").alias("least"))
    of_node = joined.join(least, "component").select(F.col("node").alias("f"), "least")
    named = materialize(unique.join(of_node, "f", "left").select("f", "n", F.coalesce("least", "rep").alias("component_id")), "named")
    hot = F.broadcast(named.where(F.col("n") > named.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] // HOT).drop("n"))  # fewer than HOT rows
    out = rows.join(hot, "f").unionByName(rows.join(hot.select("f"), "f", "left_anti").join(named.drop("n"), "f"))
    return out.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")
