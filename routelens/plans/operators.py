"""Queries that go through DataFrame operators; SQL for another engine where results are unique."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.adapters import read_table
from routelens.functions import patches as P
from routelens.functions import text as T
from routelens.functions import vectors as V
from routelens.operators import cluster, sample, search


def kmeans_assign(spark: SparkSession, d: str) -> DataFrame:
    return cluster.kmeans(read_table(spark, d, "embeddings"), 10).select("vec_id", "cluster_id")


def bisecting_assign(spark: SparkSession, d: str) -> DataFrame:
    return cluster.bisecting(read_table(spark, d, "embeddings"), 10).select("vec_id", "cluster_id")


def hac_cut(spark: SparkSession, d: str) -> DataFrame:
    return cluster.agglomerative(read_table(spark, d, "embeddings"), [2, 5], group="label")


def hac_cut_ward(spark: SparkSession, d: str) -> DataFrame:
    return cluster.agglomerative(read_table(spark, d, "embeddings"), [3], linkage="ward", group="label")


def hierarchical_kmeans(spark: SparkSession, d: str) -> DataFrame:
    return cluster.hierarchical_kmeans(read_table(spark, d, "embeddings"), [4, 3])


def pca2(spark: SparkSession, d: str) -> DataFrame:
    return cluster.pca(read_table(spark, d, "embeddings")).select("vec_id", F.transform("components", lambda x: F.round(x, 6)).alias("components"))


def kdpp_select(spark: SparkSession, d: str) -> DataFrame:
    return sample.representatives(read_table(spark, d, "embeddings"), 5, "kdpp")


def farthest_first(spark: SparkSession, d: str) -> DataFrame:
    return sample.representatives(read_table(spark, d, "embeddings"), 7)


def normalized_norms(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "embeddings").select("vec_id", F.round(V.norm(V.l2_normalize(F.col("embedding"))), 6).alias("norm"))


def code_fence_strip(spark: SparkSession, d: str) -> DataFrame:
    wrapped = F.concat(F.lit("```java\n"), "text", F.lit("\n```"))
    return read_table(spark, d, "documents").select("doc_id", F.md5(T.strip_code_fences(wrapped)).alias("digest"))


def sr_blocks(spark: SparkSession, d: str) -> DataFrame:
    marked = F.concat(F.lit("<<<<<<< SEARCH\n"), "text", F.lit("\n=======\n"), "lang", F.lit("\n>>>>>>> REPLACE"))
    b = T.search_replace_blocks(marked)
    return read_table(spark, d, "documents").select("doc_id", F.size(b).alias("n"), F.md5(b[0]["search"]).alias("search"), b[0]["replace"].alias("replacement"), T.detect_format(marked).alias("format"))


def patch_features(spark: SparkSession, d: str) -> DataFrame:
    patch = F.concat(F.lit("--- a\n+++ b\n@@ -1 +1 @@\n-"), F.replace("text", F.lit("\n"), F.lit("\n+")))
    f = T.patch_features(patch)
    return read_table(spark, d, "documents").select("doc_id", f["additions"].alias("additions"), f["deletions"].alias("deletions"), f["hunks"].alias("hunks"))


def chunk_overlap(spark: SparkSession, d: str) -> DataFrame:
    chunks = T.chunk_tokens(F.col("text"), 200, 20)
    return read_table(spark, d, "documents").select("doc_id", F.size(chunks).alias("chunks"), F.md5(chunks[0]).alias("first_chunk"))


def identifier_obfuscation(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.md5(T.hash_identifiers("text")).alias("digest"))


def outlier_merge_similarity(spark: SparkSession, d: str) -> DataFrame:
    return cluster.merge_small(read_table(spark, d, "embeddings"), 52, 0.9)


def format_detect(spark: SparkSession, d: str) -> DataFrame:
    marked = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("\n<<<<<<< SEARCH"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("### f()\n"), F.replace("text", F.lit("#"), F.lit("")))).otherwise(F.replace("text", F.lit("#"), F.lit("")))
    return read_table(spark, d, "documents").select("doc_id", T.detect_format(marked).alias("format"))


def search_replace_apply(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(T.apply_search_replace(F.col("text"), F.lit("the"), F.lit("THE"))).alias("digest"))


def diff_round_trip(spark: SparkSession, d: str) -> DataFrame:
    after = F.concat(F.lit("first\n"), "text", F.lit("\nlast"))
    made = P.diff_applied("text", after, F.lit("text.txt"))
    docs = read_table(spark, d, "documents").select("doc_id", made.alias("made")).select("doc_id", "made.*")
    return docs.select("doc_id", F.md5("applied").alias("digest"), P.patch_info(F.col("patch"))["path"].alias("path"), P.hunk_order_ok(F.col("patch")).alias("ordered"))


def reverse_patch_apply(spark: SparkSession, d: str) -> DataFrame:
    back = P.diff_undone("text", F.concat("text", F.lit("\nlast")), F.lit("text.txt"))
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.md5(back["applied"]).alias("digest"))


def locate_blocks(spark: SparkSession, d: str) -> DataFrame:
    found = P.locate_block(F.concat(F.lit("{\n  begin of text\n\n"), "text", F.lit("\n}")), F.lit("begin of text"))
    return read_table(spark, d, "documents").select("doc_id", F.size(found).alias("n"), found[0]["first"].alias("first_line"))


def signature_keys(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("public static <T> List<T> f"), F.col("p_partkey").cast("string"), F.lit("(final Map<String, T> a, int[] b) {"))
    return read_table(spark, d, "part").select("p_partkey", P.signature_key(text).alias("signature"))


def anonymized_patches(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "conversations").select("conv_id", "turn", F.md5(P.anonymize_patch("text")).alias("digest"))


def rewrite_parse(spark: SparkSession, d: str) -> DataFrame:
    got = P.rewrite_blocks(F.concat(F.lit("### f(int)\nbody\n### g()\n"), F.col("p_name")))
    return read_table(spark, d, "part").select("p_partkey", F.size(got).alias("n"), got[0]["signature"].alias("signature"), got[1]["code"].alias("code"))


def embedding_json(spark: SparkSession, d: str) -> DataFrame:
    response = F.to_json(F.struct(F.array(F.struct("embedding")).alias("data")))
    return read_table(spark, d, "embeddings").select("vec_id", F.size(P.embedding_of(response)).alias("dims"), F.round(V.norm(P.embedding_of(response)), 4).alias("norm"))


def logprob_json(spark: SparkSession, d: str) -> DataFrame:
    content = F.array(F.struct(F.lit("a").alias("token"), (-F.col("value") / 100).alias("logprob")), F.struct(F.lit("b").alias("token"), F.lit(-0.5).alias("logprob")))
    response = F.to_json(F.struct(F.array(F.struct(F.struct(content.alias("content")).alias("logprobs"))).alias("choices")))
    nll = P.mean_nll(P.token_logprobs(response))
    return read_table(spark, d, "events").where("value is not null").select("event_id", F.round(nll, 6).alias("avg_nll"), F.round(F.exp(nll), 6).alias("ppl"))


def number_range_list(spark: SparkSession, d: str) -> DataFrame:
    text = F.concat(F.lit("1-3, x,"), F.col("r_regionkey").cast("string"))
    return read_table(spark, d, "region").select("r_regionkey", F.explode(P.number_ranges(text)).alias("n"))


def batch_knn_all(spark: SparkSession, d: str) -> DataFrame:
    return search.batch_search(read_table(spark, d, "embeddings")).select("query_id", "vec_id", "place", F.round("dist", 6).alias("dist"))


def batch_knn(spark: SparkSession, d: str) -> DataFrame:
    """Five nearest of every vector whose id is divisible by 20, among all."""
    rows = read_table(spark, d, "embeddings")
    return search.nearest_of(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows).select("query_id", "vec_id", "place", F.round("dist", 6).alias("dist"))


def self_knn_check(spark: SparkSession, d: str) -> DataFrame:
    """Whether each vector whose id is divisible by 20 is found first by a search for it, as after a migration."""
    rows = read_table(spark, d, "embeddings")
    found = search.nearest_of(rows.where("vec_id % 20 = 0").withColumnRenamed("vec_id", "query_id"), rows, 1)
    return found.select("query_id", "vec_id", (F.col("query_id") == F.col("vec_id")).alias("itself"), F.round("dist", 6).alias("dist"))


def knn_exact(spark: SparkSession, d: str) -> DataFrame:
    """The ten vectors nearest to the mean of all, by one scan and a top-k of each task."""
    rows = read_table(spark, d, "embeddings").where("embedding is not null")
    mean = rows.agg(Summarizer.mean(array_to_vector("embedding")).alias("m"))
    query = F.broadcast(mean.select(vector_to_array("m").alias("q")))  # one row
    dist = V.squared_l2(F.col("embedding"), F.col("q"))
    return rows.join(query).select("vec_id", F.round(dist, 6).alias("dist")).orderBy(F.round(dist, 9), "vec_id").limit(10).select("vec_id", "dist")


_ALL = (batch_knn, knn_exact, self_knn_check, batch_knn_all, kmeans_assign, bisecting_assign, hac_cut, hac_cut_ward, hierarchical_kmeans, pca2, kdpp_select, farthest_first, normalized_norms, code_fence_strip, sr_blocks, patch_features, chunk_overlap, identifier_obfuscation, outlier_merge_similarity, format_detect, search_replace_apply, diff_round_trip, reverse_patch_apply, locate_blocks, signature_keys, anonymized_patches, rewrite_parse, embedding_json, logprob_json, number_range_list)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "batch_knn": "select query_id, vec_id, place, round(dist, 6) as dist from (select *, cast(row_number() over (partition by query_id order by round(dist, 9), vec_id) as int) as place from (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (cast(x[1] as double) - x[2]) * (cast(x[1] as double) - x[2]))) as dist from embeddings q, embeddings v where q.vec_id % 20 = 0) t) u where place <= 5",
        "self_knn_check": "select query_id, vec_id, query_id = vec_id as itself, round(dist, 6) as dist from (select *, row_number() over (partition by query_id order by round(dist, 9), vec_id) as place from (select q.vec_id as query_id, v.vec_id, list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (cast(x[1] as double) - x[2]) * (cast(x[1] as double) - x[2]))) as dist from embeddings q, embeddings v where q.vec_id % 20 = 0) t) u where place = 1",
        "knn_exact": "with dims as (select vec_id, unnest(range(len(embedding))) as pos, cast(unnest(embedding) as double) as x from embeddings), m as (select pos, avg(x) as c from dims group by pos) select vec_id, round(dist, 6) as dist from (select vec_id, sum((x - c) * (x - c)) as dist from dims join m using (pos) group by vec_id) t order by round(dist, 9), vec_id limit 10",
        "normalized_norms": "select vec_id, cast(1 as double) as norm from embeddings",
        "code_fence_strip": "select doc_id, md5(text) as digest from documents",
        "sr_blocks": "select doc_id, 1 as n, md5(text) as search, lang as replacement, 'edit' as format from documents",
        "patch_features": "select doc_id, cast(len(string_split(text, chr(10))) - 1 as int) as additions, 1 as deletions, 1 as hunks from documents",
        "format_detect": "select doc_id, case when doc_id % 3 = 1 then 'rewrite' else 'edit' end as format from documents",
        "search_replace_apply": "select doc_id, md5(case when contains(text, 'the') then replace(text, 'the', 'THE') else 'error' end) as digest from documents",
        "diff_round_trip": "select doc_id, md5('first' || chr(10) || text || chr(10) || 'last') as digest, 'text.txt' as path, true as ordered from documents",
        "reverse_patch_apply": "select conv_id, turn, md5(text) as digest from conversations",
        "locate_blocks": "select doc_id, 1 as n, 1 as first_line from documents",
        "signature_keys": "select p_partkey, 'f' || cast(p_partkey as varchar) || '(Map,int[])' as signature from part",
        "rewrite_parse": "select p_partkey, 2 as n, 'f(int)' as signature, p_name as code from part",
        "embedding_json": "select vec_id, cast(len(embedding) as int) as dims, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) as norm from embeddings",
        "logprob_json": "select event_id, round((value / 100 + 0.5) / 2, 6) as avg_nll, round(exp((value / 100 + 0.5) / 2), 6) as ppl from events where value is not null",
        "number_range_list": "select distinct r_regionkey, n from (select r_regionkey, unnest([1, 2, 3, r_regionkey]) as n from region) t",
    }
