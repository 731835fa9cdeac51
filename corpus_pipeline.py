"""Corpus pipeline: quality filter, near-duplicate removal, masking of personal data, packing into sequences.

STAGES lists (name, function) in order. Each function takes (spark, docs, sf_dir), works on every row of docs and returns
a DataFrame, which is written as Parquet and read again as the next one's docs. All but the last keep the columns of
``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.llm.common import bounded_batches, materialize, small_side
from routelens.llm.jaccard_join import jaccard_components
from routelens.llm.packing import pack
from routelens.llm.pii import mask_pii
from routelens.llm.quality import classify, row_key


def quality_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality classifier keeps, each judged by its own text, source and language whatever its doc_id.

    Null and empty texts have neutral evidence, so their site decides; nulls in other columns change nothing. Repeated rows
    fare alike. All columns stay, whatever their names. An empty table gives an empty result.
    """
    bounded_batches(spark)
    rejected = classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), with_key=True).where("not keep").select("h1", "h2").distinct()
    rejected = small_side(rejected, "rejected")
    h1, h2 = row_key()
    return docs.join(rejected, (h1 == rejected["h1"]) & (h2 == rejected["h2"]), "left_anti")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group that shares 80 % of its five-word shingles: that of smallest doc_id.

    Rows are nodes of their own by doc_id and text: null ids, and all texts but one of a doc_id that has several, get a
    number above all ids (62 bits of a hash), so a group's row with an id of its own comes first. Of repeated rows the one
    that is least as JSON stays. Texts without words link with nothing. All columns stay, whatever their names. An empty
    table gives an empty result.
    """
    # the given row travels in one column, so no name of it can clash with those made here
    rows = docs.select(F.struct(*(F.col("`" + c.replace("`", "``") + "`").alias(c) for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("own"), "text")
    h = F.xxhash64("text")
    repeated = rows.where("own is not null").groupBy(F.col("own").alias("again")).agg(F.min(h).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    repeated = small_side(repeated, "repeated")
    above = F.lit(1 << 62) + F.pmod(F.xxhash64(F.lit("node"), F.col("own"), F.col("text")), F.lit(1 << 62))
    rows = rows.join(repeated, rows["own"] == repeated["again"], "left")
    rows = rows.select("row", "text", F.when(F.col("own").isNull() | (h != F.col("least")), above).otherwise(F.col("own")).alias("node"), (F.col("own").isNull() | F.col("again").isNotNull()).alias("several"))
    found = jaccard_components(rows.select(F.col("node").alias("doc_id"), "text"), k=5, num=4, den=5)
    gone = small_side(found.where("doc_id <> component_id").select(F.col("doc_id").alias("gone")).distinct(), "gone")
    kept = rows.join(gone, rows["node"] == gone["gone"], "left_anti").select("row", "node", "several")
    if rows.where("several").limit(1).count():
        once = kept.where("several").groupBy("node").agg(F.min_by("row", F.to_json("row")).alias("row")).select("row")
        kept = kept.where("not several").select("row").unionByName(once)
    return kept.select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, with personal data masked by its kind; null and empty texts and all other columns stay as they are."""
    return mask_pii(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 ids and their places in sequences. A null or empty text is its end id alone; repeated rows and
    null ids are packed each; an empty table gives an empty result."""
    return pack(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


STAGES = [("quality", quality_filter), ("near_duplicates", near_duplicates), ("personal_data", personal_data), ("packing", packing)]

#: A trained classifier, similarity joins and byte-level BPE aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what lies between two stages is written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
