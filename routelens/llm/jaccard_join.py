"""N-gram Jaccard join by prefix trees (operator 1).

Plan, for documents of any number:
1. one scan counts how often shingles repeat inside a task (a fixed-size table of 2**22 hashed counters). It only sets
   the global order (rare first), never the result;
2. one scan turns each text into (size, 128-bit digest of its set, prefix in the global order, count sketch). Equal sets
   become one representative, its smallest doc_id; copies go no further;
3. prefixes meet by shingle. Exact grouped counts say which shingles several share, and which are so frequent that their
   documents are split in blocks. Documents that meet compare count sketches (shingles per hash range): every shingle
   that differs moves one count by one, so counts that differ in more than a link allows rule it out for certain. What is
   left is a sparse graph, and its connected components are the candidate groups;
4. whole texts are sent once to their candidate group, where a trie over the ordered prefixes is traversed: documents
   below a node share its overlap, and subtrees are pruned by their remaining length. Survivors get an exact check;
5. a candidate group beyond ``most_docs`` or ``most_shingles`` isn't put in one task: its documents are dealt to blocks in
   two ways, and the trie works in each. They meet as one group while its blocks are fewer than its documents' prefix
   shingles on average, and shingle by shingle beyond (blocks by their first and by their last shared shingle), so texts
   are copied at most in proportion to the prefix shingles. Both ways are exact.
Blocks (in 3 and 5) are first linked within themselves, which connects what is dense at a linear cost. Then, for each
shingle or group whose documents aren't in one component by now, those outside its largest one meet all others in pairs of blocks.
So every two documents that share a prefix shingle are compared or connected already. Nothing is capped, and no filter can
reject a link. Links inside a group only need to keep it connected, so pairs that are connected already aren't checked again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize, release, small_side, text_bytes
from routelens.llm.components import connected_components
from routelens.llm.shingles import mix, shingle_sets

#: Hashed counters of the order; a fixed bound, whatever the input.
ORDER_BITS = 22
#: Cells of a count sketch (one byte each), those of a set of more than LONG shingles, and documents of a block.
CELLS, FINE, LONG, BLOCK = 64, 256, 1024, 2048


def _least_overlap(n: int, num: int, den: int) -> int:
    """Smallest overlap with any partner that can be similar: ceil(n * num / den)."""
    return -(-n * num // den)


class Roots:
    """Union-find with path halving; the smaller root wins."""

    def __init__(self, n: int):
        self.p = list(range(n))

    def find(self, i: int) -> int:
        p = self.p
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    def union(self, i: int, j: int) -> None:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.p[max(i, j)] = min(i, j)


class PrefixTree:
    """Trie over ordered prefixes. A node keeps the largest set size and the most remaining shingles below it."""

    def __init__(self) -> None:
        self.child: list[dict[int, int]] = [{}]
        self.largest, self.remaining = [0], [0]
        self.docs: list[dict[int, list[int]]] = [{}]
        self.where: dict[int, list[int]] = {}

    def insert(self, path: list[int], places: list[int], size: int, doc: int, root: int) -> None:
        """root: the document's component; a node keeps those of one component together, so they can be skipped at once."""
        at = 0
        for t, i in zip(path, places, strict=True):
            to = self.child[at].get(t)
            if to is None:
                to = self.child[at][t] = len(self.child)
                self.child.append({})
                self.largest.append(0)
                self.remaining.append(0)
                self.docs.append({})
                self.where.setdefault(t, []).append(to)
            at = to
            if size > self.largest[at]:
                self.largest[at] = size
            if size - i > self.remaining[at]:
                self.remaining[at] = size - i
        self.docs[at].setdefault(root, []).append(doc)

    def probe(self, path: list[int], places: list[int], mine: dict[int, int], size: int, least: int) -> Iterator[tuple[int, list[int]]]:
        """(component when inserted, documents) that share a prefix shingle and may reach ``least``; a shared stretch is walked once for all below.

        mine: the place of every shingle of the probing set, as those below a node may reach beyond its prefix.
        """
        seen: set[int] = set()
        for t, i in zip(path, places, strict=True):
            for start in self.where.get(t, ()):
                if start in seen or self.largest[start] < least or 1 + min(size - i - 1, self.remaining[start] - 1) < least:
                    continue
                stack = [(start, 1, size - i - 1)]
                while stack:
                    at, overlap, left = stack.pop()
                    seen.add(at)
                    yield from self.docs[at].items()
                    for u, to in self.child[at].items():
                        if to in seen or self.largest[to] < least:
                            continue
                        j = mine.get(u)
                        got, rest = (overlap + 1, size - j - 1) if j is not None else (overlap, left)
                        if got + min(rest, self.remaining[to] - 1) >= least:
                            stack.append((to, got, rest))


def link_sets(sets: list[np.ndarray], num: int, den: int) -> list[int]:
    """Root (an index) of each set among those linked by Jaccard >= num/den, directly or through others.

    ``overlap`` along a path counts shared shingles from its first shared one on, so bounds hold for whole sets.
    """
    roots, sizes = Roots(len(sets)), [len(s) for s in sets]
    if len(sets) < 2:
        return roots.p
    values, inverse, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rank = np.empty(len(values), np.int64)
    rank[np.lexsort((values, count))] = np.arange(len(values))
    single = int((count == 1).sum())
    local, at = [], 0
    for n in sizes:
        local.append(np.sort(rank[inverse[at : at + n]]))
        at += n
    marked, tree = np.zeros(len(values), bool), PrefixTree()
    for x in sorted(range(len(sets)), key=lambda i: (sizes[i], i)):
        n = sizes[x]
        if not n:
            continue
        least = _least_overlap(n, num, den)
        prefix = local[x][: n - least + 1]
        lone = int(np.searchsorted(prefix, single))
        path = prefix[lone:].tolist()
        if not path:
            continue
        places = list(range(lone, len(prefix)))
        marked[local[x]] = True
        mine, checked = roots.find(x), set()
        for root, docs in tree.probe(path, places, dict(zip(local[x].tolist(), range(n), strict=True)), n, least):
            if roots.find(root) == mine:
                continue
            for y in docs:
                if y in checked or sizes[y] < least:
                    continue
                checked.add(y)
                both = int(np.count_nonzero(marked[local[y]]))
                if den * both >= num * (n + sizes[y] - both):
                    roots.union(x, y)
                    mine = roots.find(x)
                    break  # the others of this list are connected with y
        marked[local[x]] = False
        tree.insert(path, places, n, x, roots.find(x))
    return [roots.find(i) for i in range(len(sets))]


def _cells(values: np.ndarray) -> np.ndarray:
    return (mix(values) >> np.uint64(64 - ORDER_BITS)).astype(np.int64)


def _global_order(docs: DataFrame, k: int) -> np.ndarray:
    """Hashed table of log2 repeat counts (uint8): a sum over all tasks of what repeats inside each."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(1 << ORDER_BITS, np.int32)
        for b in batches:
            for s in shingle_sets(*text_bytes(b.column(0)), k):
                held[_cells(s)] += 1
        found = np.flatnonzero(held > 1)
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(held[part].astype(np.int64))], ["cell", "n"])

    counted = docs.select("text").mapInArrow(count, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n"))
    got = counted.select("cell", F.floor(F.log2("n")).cast("byte").alias("level")).toArrow()
    table = np.zeros(1 << ORDER_BITS, np.uint8)
    table[got["cell"].to_numpy()] = got["level"].to_numpy()
    return table


_EDGES = {c: np.arange(1, c, dtype=np.uint64) << np.uint64(65 - c.bit_length()) for c in (CELLS, FINE)}


def sketch(s: np.ndarray) -> bytes:
    """Shingles of a sorted set in each of CELLS (or FINE) equal hash ranges, modulo 256."""
    cells = FINE if len(s) > LONG else CELLS
    return np.diff(np.searchsorted(s, _EDGES[cells]), prepend=0, append=len(s)).astype(np.uint8).tobytes()


def most_differing(total: np.ndarray, num: int, den: int) -> np.ndarray:
    """Shingles in only one of two sets that link, at most, by the sum of their sizes."""
    return total - 2 * -(-total * num // (num + den))


class Sketches:
    """Sketches of several sets, and whether two of them may link. Never false for a pair that links."""

    def __init__(self, n: np.ndarray, column: pa.Array, num: int, den: int):
        self.n, self.num, self.den = n.astype(np.int64), num, den
        data, off = text_bytes(column)
        self.place = np.full(len(n), -1)
        long = np.flatnonzero(np.diff(off) == FINE)
        self.place[long] = np.arange(len(long))
        self.fine = data[off[long][:, None] + np.arange(FINE)]
        self.coarse = np.empty((len(n), CELLS), np.uint8)
        short = np.flatnonzero(self.place < 0)
        self.coarse[short] = data[off[short][:, None] + np.arange(CELLS)]
        self.coarse[long] = self.fine.reshape(len(long), CELLS, FINE // CELLS).sum(2, dtype=np.uint8)

    @staticmethod
    def _gap(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        d = a - b
        return np.minimum(d, -d).sum(1, dtype=np.int64)

    def may_link(self, x, y: np.ndarray) -> np.ndarray:
        """Of each y with x (one index, or one for each y)."""
        nx, ny = self.n[x], self.n[y]
        most = most_differing(nx + ny, self.num, self.den)
        out = (self.den * np.minimum(nx, ny) >= self.num * np.maximum(nx, ny)) & (self._gap(self.coarse[y], self.coarse[x]) <= most)
        px = np.broadcast_to(self.place[x], len(y))
        both = np.flatnonzero(out & (self.place[y] >= 0) & (px >= 0))
        if len(both):
            out[both] = self._gap(self.fine[self.place[y[both]]], self.fine[px[both]]) <= most[both]
        return out


def _prefix_rows(docs: DataFrame, k: int, num: int, den: int, order) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = order.value
        for b in batches:
            size, d1, d2, prefix, sketches = [], [], [], [], []
            for s in shingle_sets(*text_bytes(b.column(1)), k):
                n = len(s)
                size.append(n)
                d = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                d1.append(int.from_bytes(d[:8], "little", signed=True))
                d2.append(int.from_bytes(d[8:], "little", signed=True))
                sketches.append(sketch(s))
                p = n - _least_overlap(n, num, den) + 1 if n else 0
                if p < n:
                    level = table[_cells(s)]
                    s = s[np.lexsort((s, level))[:p]]
                prefix.append(s)
            ends = np.cumsum([0, *map(len, prefix)]).astype(np.int32)
            prefixes = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(prefix or [np.empty(0, np.uint64)]).view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(size, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), prefixes, pa.array(sketches, pa.binary())], ["doc_id", "n", "d1", "d2", "prefix", "sketch"]
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, n long, d1 long, d2 long, prefix array<long>, sketch binary")


def _meeting(unique: DataFrame) -> DataFrame:
    """(t, rep, n) of the prefix shingles t that several sets share, by exact counts.

    Counts are partial before their exchange; the join is by sort and merge, where a hot shingle's side can be split.
    """
    postings = unique.select(F.explode("prefix").alias("t"), "rep", "n")
    shared = postings.groupBy("t").agg(F.count("*").alias("c")).where("c > 1").select("t")
    return postings.join(shared.hint("merge"), "t")


def _blocks(c: str, w: str, docs: int, shingles: int) -> Column:
    return F.greatest(F.ceil(F.col(c) / docs), F.ceil(F.col(w) / shingles)).cast("long")


def _in_blocks(met: DataFrame, docs: int, shingles: int, deal: int = 1) -> DataFrame:
    """met (t, rep, n) with the number of blocks of each t, and (g, g2) of the row's own one in that deal."""
    sums = met.groupBy("t").agg(F.count("*").alias("c"), F.sum("n").alias("w")).where("c > 1").select("t", _blocks("c", "w", docs, shingles).alias("blocks"))
    own = F.pmod(F.xxhash64("rep", "t", F.lit(deal)), F.col("blocks")) + F.lit(deal << 40)  # the deals' blocks stay apart
    return met.join(sums.hint("merge"), "t").select("t", "rep", "n", "blocks", F.col("t").alias("g"), own.alias("g2"))


def _left_over(met: DataFrame, found: DataFrame, docs: int, shingles: int) -> DataFrame:
    """(g, g2, rep, part): for each t of met whose documents lie in several components of ``found`` (node, component), those
    outside the largest one together with all, in pairs of blocks."""
    parts = found.select(F.col("node").alias("rep"), F.col("component").alias("part"))
    placed = met.select("t", "rep", "n").join(parts.hint("merge"), "rep", "left").withColumn("part", F.coalesce("part", "rep"))
    sums = placed.groupBy("t", "part").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    sums = sums.groupBy("t").agg(F.max(F.struct("c", "part", "w")).alias("top"), F.sum("c").alias("c"), F.sum("w").alias("w")).where("c > top.c")
    sums = sums.withColumns({"rest_c": F.expr("c - top.c"), "rest_w": F.expr("w - top.w")})
    sums = sums.select("t", F.col("top.part").alias("main"), _blocks("c", "w", docs, shingles).alias("all"), _blocks("rest_c", "rest_w", docs, shingles).alias("rest"))
    rows = placed.join(sums.hint("merge"), "t")
    one, two = "pmod(xxhash64(rep, t, 1), all)", "pmod(xxhash64(rep, t, 2), rest)"
    with_all = f"transform(sequence(0L, rest - 1), i -> i * 2147483648L + {one})"
    with_rest = f"if(part = main, cast(array() as array<bigint>), transform(sequence(0L, all - 1), j -> {two} * 2147483648L + j))"
    return rows.select(F.col("t").alias("g"), F.explode(F.expr(f"array_distinct(concat({with_all}, {with_rest}))")).alias("g2"), "rep", "part")


def _once(rows: DataFrame, *more: str) -> DataFrame:
    """rows (g, g2, rep) without the groups that hold the same documents as another one."""
    signs = rows.groupBy("g", "g2").agg(F.count("*").alias("c"), F.bit_xor(F.xxhash64("rep", *more)).alias("x"), F.bit_xor(F.xxhash64(F.lit("second"), "rep", *more)).alias("y"))
    kept = signs.groupBy("c", "x", "y").agg(F.min(F.struct("g", "g2")).alias("k")).select("k.g", "k.g2")
    return rows.join(kept.hint("merge"), ["g", "g2"])


def _whole_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Sorted rows in batches that hold whole groups (equal first two columns), with the groups' begins and the end."""
    held = None
    for b in batches:
        if not b.num_rows:
            continue
        b = b if held is None else pa.Table.from_batches([held, b]).combine_chunks().to_batches()[0]
        g, g2 = b.column(0).to_numpy(), b.column(1).to_numpy()
        begins = np.concatenate(([0], np.flatnonzero((g[1:] != g[:-1]) | (g2[1:] != g2[:-1])) + 1))
        if len(begins) > 1:
            yield b.slice(0, begins[-1]), begins
        held = b.slice(begins[-1])
    if held is not None:
        yield held, np.array([0, held.num_rows])


def _with_sketches(rows: DataFrame, unique: DataFrame, *more: str) -> DataFrame:
    rows = rows.join(unique.select("rep", "n", "sketch").hint("merge"), "rep").select("g", "g2", "rep", "n", "sketch", *more)
    return rows.repartition("g", "g2").sortWithinPartitions("g", "g2")


def _likely_edges(rows: DataFrame, unique: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): a forest over the documents of each group of rows (g, g2, rep) that may link."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_groups(batches):
            rep, sketches = rows.column(2).to_numpy(), Sketches(rows.column(3).to_numpy(), rows.column(4), num, den)
            pairs = begins[:-1][np.diff(begins) == 2]
            pairs = pairs[sketches.may_link(pairs, pairs + 1)] if len(pairs) else pairs
            a, b = [rep[pairs]], [rep[pairs + 1]]
            for i, j in zip(begins.tolist(), begins[1:].tolist(), strict=False):
                left = np.arange(i, j if j - i > 2 else i)
                while len(left) > 1:  # one likely component after the other, by breadth
                    front, left = [left[0]], left[1:]
                    while front and len(left):
                        x = front.pop()
                        fits = sketches.may_link(x, left)
                        if fits.any():
                            got = left[fits]
                            front.extend(got.tolist())
                            a.append(np.full(len(got), rep[x]))
                            b.append(rep[got])
                            left = left[~fits]
            a, b = _forest(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return _with_sketches(rows, unique).mapInArrow(compare, "a long, b long")


def _likely_rows(rows: DataFrame, unique: DataFrame, num: int, den: int) -> DataFrame:
    """The rows (g, g2, rep) that may link with one of another part (g, g2, rep, part) in their group."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, begins in _whole_groups(batches):
            part, sketches = rows.column(5).to_numpy(), Sketches(rows.column(3).to_numpy(), rows.column(4), num, den)
            out = np.zeros(rows.num_rows, bool)
            for i, j in zip(begins.tolist(), begins[1:].tolist(), strict=False):
                here = np.arange(i, j)
                values, count = np.unique(part[i:j], return_counts=True)
                for x in here[part[i:j] != values[np.argmax(count)]].tolist():  # the largest part is met by all others
                    got = here[(part[i:j] != part[x]) & sketches.may_link(x, here)]
                    out[got] = True
                    out[x] |= len(got) > 0
            yield rows.filter(pa.array(out)).select(["g", "g2", "rep"])

    return _with_sketches(rows, unique, "part").mapInArrow(compare, "g long, g2 long, rep long")


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components with at most one edge a node."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    roots = Roots(len(nodes))
    for i, j in zip(at[: len(a)].tolist(), at[len(a) :].tolist(), strict=True):
        roots.union(i, j)
    top = np.array([roots.find(i) for i in range(len(nodes))], np.int64)
    out = top != np.arange(len(nodes))
    return nodes[out], nodes[top[out]]


def _grouped_links(rows: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """rows (g long, g2 long, rep long, text): (rep, root) by the trie within each (g, g2)."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, reps, sets = None, [], []

        def done() -> pa.RecordBatch:
            by = np.argsort(np.array(reps, np.int64), kind="stable")
            ordered = np.array(reps, np.int64)[by]
            top = link_sets([sets[i] for i in by], num, den)
            return pa.RecordBatch.from_arrays([pa.array(ordered), pa.array(ordered[np.array(top, np.int64)])], ["rep", "root"])

        for b in batches:
            gs, g2s, ids = b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()
            for g, g2, rep, s in zip(gs, g2s, ids, shingle_sets(*text_bytes(b.column(3)), k), strict=True):
                if key is not None and (g, g2) != key:
                    yield done()
                    reps, sets = [], []
                key = (g, g2)
                reps.append(rep)
                sets.append(s)
        if reps:
            yield done()

    return rows.select("g", "g2", "rep", "text").repartition("g", "g2").sortWithinPartitions("g", "g2").mapInArrow(solve, "rep long, root long")


def jaccard_components(docs: DataFrame, k: int = 5, num: int = 4, den: int = 5, most_docs: int = 1024, most_shingles: int = 1_000_000, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, n_shingles (set size), component_id (smallest doc_id reachable by links).

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. Two documents link when
    den * intersection >= num * union of their sets of k-word shingles. Null or empty texts, and texts without words,
    have an empty set and link with nothing. Repeated rows each get a row. A null doc_id is kept, and its text's copies
    link as others do, without one of their own. Rows that share a doc_id with different texts count as one node, and
    the node's component is the least of theirs. Very long texts are handled whole. An empty table gives an empty result.
    ``most_docs``, ``most_shingles`` and ``block`` bound what one task holds at a time, never the result.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    order = spark.sparkContext.broadcast(_global_order(docs, k))
    rows = materialize(_prefix_rows(docs, k, num, den, order), "prefixes")
    unique = rows.where("n > 0 and doc_id is not null").groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.first("prefix").alias("prefix"), F.first("sketch").alias("sketch"), F.min("n").alias("n"))
    unique = materialize(unique, "sets")
    met = materialize(_meeting(unique), "meeting")
    dealt = materialize(_in_blocks(met, block, 1 << 62), "dealt")
    likely = connected_components(_likely_edges(_once(dealt.select("g", "g2", "rep")), unique, num, den))
    hot = dealt.where("blocks > 1")
    if hot.limit(1).count():
        rest = _once(materialize(_left_over(hot, likely, block, 1 << 62).select("g", "g2", "rep"), "rest"))
        likely = connected_components(_likely_edges(rest, unique, num, den).unionByName(likely.select(F.col("node").alias("a"), F.col("component").alias("b"))))
    release(dealt)
    groups = materialize(unique.groupBy("rep").agg(F.max("n").alias("n")).join(likely.withColumnRenamed("node", "rep"), "rep"), "groups")
    sizes = groups.groupBy("component").agg(F.count("*").alias("docs"), F.sum("n").alias("shingles"))
    # copies of a whole group in pairs of blocks, against its prefix shingles: the cheaper way for what fits no task
    by_group = _blocks("docs", "shingles", most_docs, most_shingles) * F.col("docs") <= F.col("shingles") * (den - num) / den + F.col("docs")
    fitting = groups.join(sizes.select("component", F.expr(f"docs <= {most_docs} and shingles <= {most_shingles}").alias("fits"), by_group.alias("by_group")), "component")
    texts = docs.withColumnRenamed("doc_id", "rep")
    found = materialize(_grouped_links(_join_texts(texts, fitting.where("fits").select("rep", F.col("component").alias("g"), F.lit(0).cast("long").alias("g2")), "fitting"), k, num, den), "found")
    large = materialize(fitting.where("not fits").select(F.col("component").alias("t"), "rep", "n", "by_group"), "large")
    if large.limit(1).count():
        by_shingle = met.join(large.where("not by_group").select("rep").hint("merge"), "rep").select("t", "rep", "n")
        meets = materialize(large.where("by_group").select("t", "rep", "n").unionByName(by_shingle), "meets")
        # two deals into blocks, so that what is dense gets connected across blocks too
        one, two = (meets.groupBy("rep").agg(least("t").alias("t"), F.first("n").alias("n")) for least in (F.min, F.max))
        first = materialize(_in_blocks(one, most_docs, most_shingles, 1).unionByName(_in_blocks(two, most_docs, most_shingles, 2)), "first").select("rep", "g", "g2").distinct()
        linked = connected_components(_root_edges(_grouped_links(_join_texts(texts, _once(first), "first"), k, num, den)))
        rest = materialize(_left_over(meets, linked, most_docs, most_shingles), "rest")
        rest = _once(materialize(_likely_rows(_once(rest, "part"), unique, num, den), "likely"))
        more = _root_edges(_grouped_links(_join_texts(texts, rest.select("rep", "g", "g2"), "rest"), k, num, den))
        linked = connected_components(more.unionByName(linked.select(F.col("node").alias("a"), F.col("component").alias("b"))))
        found = found.unionByName(linked.select(F.col("node").alias("rep"), F.col("component").alias("root")))
    found = materialize(found.groupBy("rep").agg(F.min("root").alias("root")), "links")
    release(met, groups, large)
    of_set = unique.select("d1", "d2", "rep").join(found, "rep", "left").select("d1", "d2", F.coalesce("root", "rep").alias("root"))
    out = rows.select("doc_id", "n", "d1", "d2").join(of_set, ["d1", "d2"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("root", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _join_texts(texts: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
    return texts.join(small_side(keys, tag), "rep")


def _root_edges(links: DataFrame) -> DataFrame:
    return links.select(F.col("rep").alias("a"), F.col("root").alias("b"))
