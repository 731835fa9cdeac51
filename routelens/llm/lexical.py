"""Ranked lexical search, score at a time over impact-ordered postings (operator 11).

1. One scan counts each document's terms and keeps the counts of those that some item asks for. N, L and df are grouped
   sums over all documents; only the terms of the items at hand, a bounded number, reach the driver.
2. The counts are read in blocks. A block's index holds, for each term, its postings by descending exact impact: the whole
   part of a document's score that the term gives. Nothing of it is exchanged.
3. An item's postings are processed by descending impact, in rounds that end between two impacts. After a round the
   next impact of each term bounds what it can still give. Once their sum lies below the k-th best score so far (of this
   block's partial scores and the best of the task's earlier blocks) no unseen document can enter; those seen that still can
   have their scores completed from their own term counts. Nothing is dropped but by that proof.
4. Each task gives its best k of each item, and two steps of ranking (first in salted parts) give the best of all.

Items are the stated query set. They are searched in groups of a bounded number of items and code points, each against all
documents, so what is broadcast is bounded; more items take more scans.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize, release

#: Items of a group and code points of their texts (a single longer item is a group of its own).
MOST_ITEMS, MOST_CHARS = 4096, 4 << 20
#: Documents and postings of a block, postings of an item's first round, and parts in which tasks' results are ranked first.
BLOCK_DOCS, BLOCK_POSTINGS, FIRST_ROUND, PARTS = 16_384, 1_000_000, 4096, 16

#: A-Z lower-cased; letters, digits and all bytes of other than ASCII characters stay; the rest separates terms.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def terms(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(_FOLD).split()


def weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


class ImpactIndex:
    """Postings of a block of documents, by term and descending impact.

    doc_at, term, tf: the documents' term counts, document by document; n: their lengths; w: weights by term.
    """

    def __init__(self, doc_at: np.ndarray, term: np.ndarray, tf: np.ndarray, n: np.ndarray, w: np.ndarray, n_docs: int, total: int):
        m = np.array([50 + 50 * x * n_docs // total for x in n.tolist()], np.int64)
        tf = tf.astype(np.int64)
        doc = np.repeat(np.arange(len(n)), np.diff(doc_at))
        self.doc_at, self.term, self.size = doc_at, term, len(n)
        self.impact = w[term] * (1_000_000_000 * tf // (1000 * tf + 20 * m[doc]))
        order = np.lexsort((-self.impact, term))
        self.docs, self.falling = doc[order], self.impact[order]
        self.first = np.searchsorted(term[order], np.arange(len(w) + 1))
        self.asked = np.zeros(len(w), bool)

    def _complete(self, docs: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Whole scores of ``docs`` for the terms ``wanted``, from the documents' own counts."""
        count = self.doc_at[docs + 1] - self.doc_at[docs]
        at = np.repeat(self.doc_at[docs] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(count.sum())
        self.asked[wanted] = True
        hit = self.asked[self.term[at]]
        self.asked[wanted] = False
        out = np.zeros(len(docs), np.int64)
        np.add.at(out, np.repeat(np.arange(len(docs)), count)[hit], self.impact[at[hit]])
        return out

    def top(self, wanted: np.ndarray, k: int, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(documents, whole scores) of all that can be among the k highest; best: scores known from elsewhere, at most k.

        The third number counts the postings that were processed.
        """
        begin, end = self.first[wanted], self.first[wanted + 1]
        count = end - begin
        size = int(count.sum())
        if not size:
            return np.empty(0, np.int64), np.empty(0, np.int64), 0
        owner = np.repeat(np.arange(len(wanted)), count)
        at = np.repeat(begin - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(size)
        order = np.argsort(-self.falling[at], kind="stable")
        at, owner = at[order], owner[order]
        impact, docs = self.falling[at], self.docs[at]
        score, done, step, next_at = np.zeros(self.size, np.int64), 0, FIRST_ROUND, begin.copy()
        while done < size:
            to = min(size, done + step)
            to = int(np.searchsorted(-impact, -impact[to - 1], "right"))  # an impact's postings stay together
            np.add.at(score, docs[done:to], impact[done:to])
            next_at += np.bincount(owner[done:to], minlength=len(wanted))
            done, step = to, 2 * step
            rest = int(self.falling[np.minimum(next_at, end - 1)][next_at < end].sum())
            seen = np.flatnonzero(score)
            known = np.concatenate((best, score[seen]))
            least = int(np.partition(known, len(known) - k)[len(known) - k]) if len(known) >= k else 0
            if rest < least:
                break
        able = seen[score[seen] + rest >= max(least, 1)]
        whole = score[able] if done == size else self._complete(able, wanted)
        enough = whole >= least
        return able[enough], whole[enough], done


class Best:
    """The k best of each item so far, highest score first, then ascending id (null last)."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.scores, self.ids, self.nulls = ([np.empty(0, t) for _ in range(n)] for t in (np.int64, np.int64, bool))

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray) -> None:
        s, i, z = (np.concatenate(x) for x in ((self.scores[item], scores), (self.ids[item], ids), (self.nulls[item], nulls)))
        order = np.lexsort((i, z, -s))[: self.k]
        self.scores[item], self.ids[item], self.nulls[item] = s[order], i[order], z[order]


def _count(asked: object):
    """Rows (doc_id, text) to (doc_id, n, terms, tfs) of each document that has terms; only terms asked for are kept."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = asked.value[0]
        for b in batches:
            keep, n, sizes, term, tf = [], [], [0], [], []
            for i, text in enumerate(b.column(1)):
                found = terms(text.as_py())
                if not found:
                    continue
                for t, c in Counter(found).items():
                    x = number.get(t)
                    if x is not None:
                        term.append(x)
                        tf.append(c)
                keep.append(i)
                n.append(len(found))
                sizes.append(len(term))
            lists = [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(x, pa.int32())) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(keep, pa.int32())), pa.array(n, pa.int64()), *lists], ["doc_id", "n", "terms", "tfs"])

    return rows


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held, docs, postings = [], 0, 0
    for b in batches:
        held.append(b)
        docs, postings = docs + len(b), postings + len(b.column(2).flatten())
        if docs >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
            yield pa.Table.from_batches(held).combine_chunks()
            held, docs, postings = [], 0, 0
    if docs:
        yield pa.Table.from_batches(held).combine_chunks()


def _search(asked: object, w: object, n_docs: int, total: int, k: int):
    """Counted documents to the task's k best of each item of the group."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, keys, wanted = asked.value
        best = Best(len(keys), k)
        for t in _blocks(batches):
            ids, n, term, tf = (t.column(i).chunk(0) for i in range(4))
            sizes = np.concatenate(([0], np.cumsum(term.value_lengths().to_numpy(zero_copy_only=False)))).astype(np.int64)
            index = ImpactIndex(sizes, term.flatten().to_numpy(), tf.flatten().to_numpy(), n.to_numpy(), w.value, n_docs, total)
            null, ids = ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy()
            for item, x in enumerate(wanted):
                docs, scores, _ = index.top(x, k, best.scores[item])
                if len(docs):
                    best.add(item, scores, ids[docs], null[docs])
        sizes = [len(x) for x in best.scores]
        h = [np.repeat(np.array([x[i] for x in keys], np.int64), sizes) for i in (0, 1)]
        scores, ids, nulls = (np.concatenate(x) if x else np.empty(0) for x in (best.scores, best.ids, best.nulls))
        yield pa.RecordBatch.from_arrays([pa.array(h[0]), pa.array(h[1]), pa.array(ids.astype(np.int64), mask=nulls.astype(bool)), pa.array(scores.astype(np.int64))], ["h1", "h2", "doc_id", "score"])

    return rows


def _grouped(texts: DataFrame, most_items: int, most_chars: int) -> tuple[DataFrame, int]:
    """Texts with a group number g, and the number of groups; no group of several texts exceeds a bound."""
    held = texts.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    groups = max(1, -(-held[0] // most_items), -(-held[1] // most_chars))
    while True:
        dealt = texts.withColumn("g", F.pmod("h1", F.lit(groups)))
        over = dealt.groupBy("g").agg(F.count("*").alias("c"), F.sum(F.length("text")).alias("chars")).where(f"c > 1 and (c > {most_items} or chars > {most_chars})")
        if not over.limit(1).count():
            return dealt, groups
        groups *= 2


def _best_in_group(docs: DataFrame, items: list, k: int) -> DataFrame:
    spark = docs.sparkSession
    number: dict[bytes, int] = {}
    wanted = [np.array(sorted({number.setdefault(t, len(number)) for t in terms(r["text"])}), np.int64) for r in items]
    asked = spark.sparkContext.broadcast((number, [(r["h1"], r["h2"]) for r in items], wanted))
    counted = materialize(docs.mapInArrow(_count(asked), "doc_id long, n long, terms array<int>, tfs array<int>"), "counted")
    n_docs, total = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = np.zeros(len(number), np.int64)
    for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
        df[r["t"]] = r["count"]
    w = spark.sparkContext.broadcast(np.array([weight(n_docs, x) for x in df.tolist()], np.int64))
    best = materialize(counted.mapInArrow(_search(asked, w, n_docs, total, k), "h1 long, h2 long, doc_id long, score long"), "best")
    release(counted)
    return best


def ranked_search(docs: DataFrame, items: DataFrame, k: int = 50, most_items: int = MOST_ITEMS, most_chars: int = MOST_CHARS) -> DataFrame:
    """Per item its ``k`` highest-scoring documents with a score above 0: item_id, rank (from 1), doc_id, score.

    Equal scores rank by ascending doc_id, null ids last. ``docs`` needs doc_id and text, ``items`` item_id and text; other
    columns are ignored, whatever their names. Null and empty texts and texts without terms count nowhere and find nothing.
    Repeated rows of ``docs`` are documents of their own and rank side by side. Repeated rows of ``items`` give one result;
    rows that share an item_id (null included) with different texts are ranked each on their own. Very long texts are handled
    whole. An empty table on either side gives an empty result. ``most_items`` and ``most_chars`` bound the items searched at
    a time, never the result.
    """
    bounded_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = items.where("text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2"))
    texts, groups = _grouped(materialize(items.groupBy("h1", "h2").agg(F.first("text").alias("text")), "items"), most_items, most_chars)
    best = None
    for g in range(groups):
        if asked := texts.where(F.col("g") == g).collect():
            found = _best_in_group(docs, asked, k)
            best = found if best is None else best.unionByName(found)
    if best is None:
        return items.select("item_id", F.lit(1).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score")).limit(0)
    order = (F.desc("score"), F.asc_nulls_last("doc_id"))
    part = F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS))
    first = best.withColumn("part", part).withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2", "part").orderBy(*order))).where(f"rank <= {k}")
    last = first.withColumn("rank", F.row_number().over(Window.partitionBy("h1", "h2").orderBy(*order))).where(f"rank <= {k}")
    return items.select("item_id", "h1", "h2").distinct().join(last.select("h1", "h2", "rank", "doc_id", "score"), ["h1", "h2"]).select("item_id", "rank", "doc_id", "score")
