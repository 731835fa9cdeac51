"""Sharding by vector bin packing (operator 10).

Equal texts form a group that stays in one shard. Groups are summed to items of three sizes (bytes, tokens, rows) by a
hash of the text into a bounded number of buckets; a group too heavy for one bucket, by bytes or by rows, is an item of its
own, and one whose bytes are too many to keep shards level is cut into parts. Items, whose number is bounded whatever the
input, are placed largest first: among the shards where an item fits by all three sizes, into the one where its dot
product with the residual capacity is highest. Where it fits nowhere, bytes decide, as they are the law that holds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from routelens.llm.common import digest_columns, materialize

#: Buckets of ordinary groups, and the most parts of all bytes or rows that make a group an item of its own.
BUCKETS, HEAVY_PARTS = 8192, 1024
#: By how much of its share a shard may be overfilled by bytes, tokens and rows while items still fit.
SLACK = (0.0002, 0.02, 0.02)


def place(items: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows: bytes, tokens, rows). Bounded by the number of items, not by the corpus."""
    share = items / np.maximum(items.sum(0).astype(float), 1)
    capacity, least = np.full((shards, items.shape[1]), 1 / shards), -np.array(SLACK) / shards
    out = np.zeros(len(items), np.int64)
    for i in np.lexsort((np.arange(len(items)), -share.max(1))):
        left = capacity - share[i]
        fits = (left >= least).all(1)
        if not fits.any():
            fits = left[:, 0] >= least[0]
        if not fits.any():
            fits = capacity[:, 0] >= capacity[:, 0].max() - 1e-15
        out[i] = int(np.argmax(np.where(fits, capacity @ share[i], -np.inf)))
        capacity[out[i]] -= share[i]
    return out


def shard(docs: DataFrame, shards: int = 16) -> DataFrame:
    """Per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``docs`` needs doc_id and text; other columns are ignored, whatever their names. size is the UTF-8 bytes of the text (null: none) plus 1;
    the law is ``bytes``, so grown_shard is null. Slots are gapless from 0 in each shard, in no particular order between
    groups. Repeated rows get a slot each; an empty table gives an empty result. Null texts are one group of equal ones (size 1).
    Groups of equal sizes are placed by their hash. Very long texts are items of their own. A null doc_id is kept.
    A group of over 1/shards of all bytes, which no shard can hold, is cut; all others stay whole. Only where shards still
    differ from their mean by over 1 % in bytes (many groups of nearly a shard each) those of over 1/(4 * shards) are cut too.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = digest_columns(docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), (F.octet_length(text) + 1).cast("long").alias("size")))
    tokens = F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1
    spread = F.coalesce("doc_id", F.monotonically_increasing_id())
    sized = materialize(rows.select("doc_id", "size", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"), "h1", "h2", tokens.cast("long").alias("tokens"), spread.alias("spread")), "sizes")
    total, count = sized.agg(F.coalesce(F.sum("size"), F.lit(1)), F.count("*")).first()
    heavy_bytes, heavy_rows = max(1, total // HEAVY_PARTS), max(1, count // HEAVY_PARTS)
    groups = sized.groupBy("h1", "h2").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    # fewer than 2 * HEAVY_PARTS groups can reach that share, and their parts are fewer than twice as many
    parts = F.ceil(F.greatest(F.col("bytes") / F.lit(heavy_bytes), F.col("n") / F.lit(heavy_rows))).cast("long")
    heavy = materialize(groups.where((F.col("bytes") > heavy_bytes) | (F.col("n") > heavy_rows)).select("h1", "h2", "bytes", parts.alias("parts")), "heavy")
    none = F.lit(0).cast("long")
    for share in (1, 4):
        marked = heavy.select("h1", "h2", "parts", (F.col("bytes") > total // (share * shards)).alias("cut"))
        rows = sized.join(F.broadcast(marked), ["h1", "h2"], "left")
        # a cut group's parts are placed each; a whole group's go to one shard, and only their slots are counted apart
        dealt = F.pmod(F.xxhash64("spread", F.lit("part")), F.greatest("parts", F.lit(1).cast("long")))
        item = F.when(F.col("parts").isNull(), F.pmod("h1", F.lit(BUCKETS).cast("long"))).otherwise(F.lit(BUCKETS).cast("long") + F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 40).cast("long")))
        rows = rows.select("doc_id", "size", "text_crc32", "tokens", item.alias("item"), F.when(F.col("cut"), dealt).otherwise(none).alias("part"), F.when(F.col("cut"), none).otherwise(F.coalesce(dealt, none)).alias("sub"))
        sums = rows.groupBy("item", "part", "sub").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
        got = sums.orderBy("item", "part", "sub").toArrow()  # at most BUCKETS + 4 * HEAVY_PARTS rows
        keys = np.stack([got[c].to_numpy() for c in ("item", "part", "sub")], 1)
        if not len(keys):
            return spark.createDataFrame([], "doc_id long, size long, text_crc32 long, law string, shard int, slot long, grown_shard int")
        values = np.stack([got[c].to_numpy() for c in ("bytes", "tokens", "n")], 1)
        units, of_unit = np.unique(keys[:, :2], axis=0, return_inverse=True)
        of_unit = of_unit.ravel()
        sizes = np.zeros((len(units), 3), np.int64)
        np.add.at(sizes, of_unit, values)
        to = place(sizes, shards)[of_unit]
        held = np.bincount(to, values[:, 0], shards)
        if held.max() <= 1.01 * held.mean() and held.min() >= 0.99 * held.mean():
            break
    slots = np.zeros(len(keys), np.int64)
    for s in range(shards):
        at = np.flatnonzero(to == s)
        slots[at] = np.cumsum(values[at, 2]) - values[at, 2]
    plan = spark.createDataFrame(pa.table({"item": keys[:, 0], "part": keys[:, 1], "sub": keys[:, 2], "shard": to.astype(np.int32), "begin": slots}))
    within = Window.partitionBy("item", "part", "sub").orderBy("doc_id", "text_crc32")
    ranked = rows.withColumn("within", F.row_number().over(within)).join(F.broadcast(plan), ["item", "part", "sub"])
    return ranked.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("begin") + F.col("within") - 1).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
