"""Byte-level BPE encoding and decoding (operator 3).

Merges of one pre-token run over a linked list of its bytes. A hierarchical bitmap over merge ranks (256-bit words and
one word above) says which ranks have candidates; find-first-set gives the next rank, whose bucket holds list positions,
leftmost first. Entries whose pair has changed since are stale and skipped. Work is O(n log n) however long the
pre-token, as each merge adds two entries at most.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches
from routelens.llm.spaced import SpacedEncoder

_WORD = 8  # log2 of the bits of a bitmap word
_BITS = [1 << i for i in range(1 << 13)]  # vocabularies of up to 2**21 ranks


class RankQueue:
    """Positions by merge rank: a bitmap word per 256 ranks, and a bucket (heap of positions) per rank that has any.

    The word above, with a bit per bitmap word, is the caller's; all are empty again when a pre-token is done.
    """

    def __init__(self, most: int):
        self.words = [0] * ((most >> _WORD) + 1)
        self.buckets: dict[int, list[int]] = {}


class BytePairEncoder:
    def __init__(self, ranks: dict[bytes, int], pattern: str, most: int = 1_000_000, longest: int = 48):
        import regex

        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0))
        self.held: dict[str, bytes] = {}
        self.most, self.longest = most, longest
        self.encode = SpacedEncoder(self._matches, most=700_000)

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token."""
        ranks = self.ranks
        if (whole := ranks.get(piece)) is not None:
            return [whole]
        # the queue's push and pop, written out: this loop is nearly all of the work
        n, get = len(piece), ranks.get
        words, buckets, top, bits = self.queue.words, self.queue.buckets, 0, _BITS
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [-1] * n
        for i in range(n - 1):
            r = get(piece[i : i + 2], -1)
            if r >= 0:
                pair[i] = r
                if r in buckets:
                    heappush(buckets[r], i)
                else:
                    buckets[r] = [i]
                    w = r >> _WORD
                    words[w] |= bits[r & 255]
                    top |= bits[w]
        while top:
            w = (top & -top).bit_length() - 1
            word = words[w]
            r = (w << _WORD) | ((word & -word).bit_length() - 1)
            bucket = buckets[r]
            i = heappop(bucket)
            if not bucket:
                del buckets[r]
                words[w] = word = word & (word - 1)
                if not word:
                    top &= top - 1
            if pair[i] != r:
                continue
            j = end[i]
            pair[j] = -1
            e = end[i] = end[j]
            h = before[i]
            if e < n:
                before[e] = i
                pair[i] = r = get(piece[i : end[e]], -1)
            else:
                pair[i] = r = -1
            for at in (i, h):
                if at == h:
                    if h < 0:
                        break
                    pair[h] = r = get(piece[h:e], -1)
                if r >= 0:
                    if r in buckets:
                        heappush(buckets[r], at)
                    else:
                        buckets[r] = [at]
                        w = r >> _WORD
                        words[w] |= bits[r & 255]
                        top |= bits[w]
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _matches(self, text: str) -> bytes:
        held, out = self.held, []
        for m in self.find(text):
            got = held.get(m)
            if got is None:
                got = np.array(self.merge(m.encode()), "<u4").tobytes()
                if len(m) <= self.longest:
                    if len(held) >= self.most:
                        held.clear()
                    held[m] = got
            out.append(got)
        return b"".join(out)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: White space as the rank files' pattern means it (Unicode White_Space), where Python's own class holds more.
_WHITE = r"\t-\r\x20\x85\xa0  -     　"


def explicit_white_space(pattern: str) -> str:
    """The pattern with \\s and \\S spelt out; fit for patterns that use them bare or inside a negated set."""
    return pattern.replace(r"[^\s", f"[^{_WHITE}").replace(r"\S", f"[^{_WHITE}]").replace(r"\s", f"[{_WHITE}]")


@lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> BytePairEncoder:
    return BytePairEncoder(read_ranks(path), explicit_white_space(pattern))


def encode_decode(docs: DataFrame, vocabulary: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """Per document: doc_id, n_tokens, ids_sha256, decoded_sha256, and with ``with_ids`` the ids and the decoded text.

    ``docs`` needs doc_id and text; other columns are ignored. A null text counts as empty (no ids; digests of nothing).
    Repeated rows each get a row; an empty table gives an empty result. ``vocabulary`` is a file of base64 tokens and
    ranks that every executor can open.
    """
    bounded_batches(docs.sparkSession)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<long>, decoded string" if with_ids else "")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(vocabulary, pattern)
        for b in batches:
            n, first, second, ids_of, texts = [], [], [], [], []
            for t in b.column(1):
                ids = bpe.encode(t.as_py() or "")
                back = bpe.decode(ids)
                n.append(len(ids) // 4)
                first.append(hashlib.sha256(ids).hexdigest())
                second.append(hashlib.sha256(back).hexdigest())
                if with_ids:
                    ids_of.append(np.frombuffer(ids, "<u4").astype(np.int64).tolist())
                    texts.append(back.decode())
            more = [pa.array(ids_of, pa.list_(pa.int64())), pa.array(texts, pa.string())] if with_ids else []
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"][: 4 + len(more)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string()), *more], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, schema)
