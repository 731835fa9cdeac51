"""Best-fit packing of tokenized documents into sequences (operator 5).

What decides a packing is only how many pieces have each length, at most ``capacity`` numbers however large the corpus.
The plan is made from these counts: pieces above one third of the capacity pair at most twice per sequence by greedy
matching (the largest with the largest that still fits); smaller ones go best-fit, longest first, into the remaining
gaps. It is kept as runs of ranks, so its size is bounded by the capacity too. Each piece then finds its place from its
rank among the pieces of its length; ranks come from counts by (length, bucket) and a window inside each, so a length
that a third of all documents share is spread over all buckets.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize
from routelens.llm.spaced import SpacedEncoder

#: Rows that one bucket of a length holds on average at most.
BUCKET_ROWS = 20_000


class Plan:
    """runs[length]: (first rank, first sequence, pieces a sequence, offset of the first)."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity, self.sequences = capacity, 0
        self.runs: dict[int, list[tuple[int, int, int, int]]] = {}
        self.used: dict[int, int] = {}
        self.gaps: dict[int, list[tuple[int, int]]] = {}
        self.sorted_gaps: list[int] = []
        large = {n: c for n, c in counts.items() if c and 3 * n > capacity}
        self._match(large)
        for n in sorted((n for n in counts if counts[n] and n not in large), reverse=True):
            self._best_fit(n, counts[n])

    def _place(self, n: int, pieces: int, sequence: int, each: int, offset: int) -> None:
        at = self.used.get(n, 0)
        self.runs.setdefault(n, []).append((at, sequence, each, offset))
        self.used[n] = at + pieces

    def _free(self, gap: int, sequence: int, count: int) -> None:
        if gap and count:
            if gap not in self.gaps:
                self.gaps[gap] = []
                insort(self.sorted_gaps, gap)
            self.gaps[gap].append((sequence, count))

    def _open(self, count: int) -> int:
        self.sequences += count
        return self.sequences - count

    def _match(self, left: dict[int, int]) -> None:
        lengths = sorted(left)
        while lengths:
            n = lengths[-1]
            fit = bisect_left(lengths, self.capacity - n + 1) - 1
            m = lengths[fit] if fit >= 0 else 0
            count = left[n] // 2 if m == n else min(left[n], left[m]) if m else left[n]
            if m == n and not count:  # one piece is left of that length: try the next shorter one
                m = lengths[fit - 1] if fit else 0
                count = 1
            s = self._open(count)
            self._place(n, count, s, 1, 0)
            if m:
                self._place(m, count, s, 1, n)
            self._free(self.capacity - n - m, s, count)
            for x in (n, m) if m else (n,):
                left[x] -= count
            lengths = [x for x in lengths if left[x]]

    def _best_fit(self, n: int, count: int) -> None:
        while count:
            at = bisect_left(self.sorted_gaps, n)
            if at == len(self.sorted_gaps):
                each = self.capacity // n
                s = self._open(-(-count // each))
                self._free(self.capacity, s, -(-count // each))
                continue
            gap = self.sorted_gaps[at]
            sequence, free = self.gaps[gap].pop()
            if not self.gaps[gap]:
                del self.gaps[gap]
                self.sorted_gaps.pop(at)
            each = gap // n
            full = min(free, count // each)
            if full:
                self._place(n, full * each, sequence, each, self.capacity - gap)
                self._free(gap - each * n, sequence, full)
                count -= full * each
            if full < free and count and count < each:
                self._place(n, count, sequence + full, count, self.capacity - gap)
                self._free(gap - count * n, sequence + full, 1)
                full, count = full + 1, 0
            self._free(gap, sequence + full, free - full)

    def arrays(self) -> dict[int, tuple[np.ndarray, ...]]:
        return {n: tuple(np.array(x, np.int64) for x in zip(*runs, strict=True)) for n, runs in self.runs.items()}


def _byte_letters() -> dict[str, int]:
    """Byte of each letter by which byte-level BPE files write bytes: printable ones stand for themselves."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [x for x in range(256) if x not in shown]
    return {chr(x): x for x in shown} | {chr(256 + i): x for i, x in enumerate(hidden)}


@lru_cache(maxsize=2)
def _tokenizer(path: str, pattern: str) -> Callable[[str], bytes]:
    """Encoder of a byte-level BPE file of the tokenizers library; its ids are in merge order, so they serve as ranks.

    Texts are split at the file's added tokens, the longest first where several start, as the library does whatever
    ``add_special_tokens`` says; where one strips spaces or takes whole words only, the library encodes texts that hold it.
    """
    import tiktoken

    with open(path, encoding="utf-8") as f:
        read = json.load(f)
    letters, tokens = _byte_letters(), read.get("added_tokens") or []
    added = {x["content"]: x["id"].to_bytes(4, "little") for x in tokens}
    ranks = {bytes(letters[x] for x in token): i for token, i in read["model"]["vocab"].items() if token not in added}
    encoding = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    plain = SpacedEncoder(lambda s: encoding.encode_to_numpy(s, disallowed_special=()).astype("<u4").tobytes())
    if not added:
        return plain
    cut = re.compile("(" + "|".join(re.escape(x) for x in sorted(added, key=len, reverse=True)) + ")")
    whole = None
    if any(x.get(k) for x in tokens for k in ("lstrip", "rstrip", "single_word")):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)

    def encode(text: str) -> bytes:
        if not any(x in text for x in added):
            return plain(text)
        if whole:
            return np.array(whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return b"".join(added[x] if i % 2 else plain(x) for i, x in enumerate(cut.split(text)))

    return encode


def pieces(docs: DataFrame, tokenizer: str, pattern: str, capacity: int) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(tokenizer, pattern)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py() or "") + b"\0\0\0\0"
                n = len(ids) // 4
                at, to = 0, n % capacity or capacity
                for k in range(-(-n // capacity)):
                    for column, x in zip(out, (doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])), strict=True):
                        column.append(x)
                    at, to = to, to + capacity
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, tokenizer: str, pattern: str, capacity: int = 2048) -> DataFrame:
    """Per piece of each document's ids (with the end id 0): doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Only documents of more than ``capacity`` ids are cut; all pieces but the first then have ``capacity`` ids. ``docs``
    needs doc_id and text; other columns are ignored. ``tokenizer`` is a byte-level BPE file of the tokenizers library, and
    ``pattern`` its splitting pattern. Added tokens' strings in a text get the tokens' ids. A null or empty text is the end id alone. Repeated rows are
    packed each; an empty table gives an empty result.
    """
    cut = materialize(pieces(docs, tokenizer, pattern, capacity), "pieces")
    buckets = max(1, cut.count() // BUCKET_ROWS)
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    counts = materialize(cut.groupBy("length", "bucket").agg(F.count("*").alias("c")), "counts")
    plan = Plan({r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}, capacity)
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(starts, ["length", "bucket"]).withColumn("rank", F.col("before") + F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1)
    runs = docs.sparkSession.sparkContext.broadcast(plan.arrays())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = runs.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                first, base, each, begin = held[n]
                i = np.searchsorted(first, rank[at], "right") - 1
                inside = rank[at] - first[i]
                sequence[at] = base[i] + inside // each[i]
                offset[at] = begin[i] + inside % each[i] * n
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
