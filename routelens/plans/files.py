"""Queries through sinks and sources (tables are written to the shared folder and read back), and over texts and paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.adapters import read_table, view, with_views
from routelens.functions import patches as P
from routelens.functions import text as T
from routelens.functions import vectors as V
from routelens.operators.shared import new_folder
from routelens.operators.store import VectorStore
from routelens.sources import readers, sinks


def score_lines(spark: SparkSession, d: str) -> DataFrame:
    """Scores as JSON lines, every tenth of them no number, and their mean by slug."""
    rows = read_table(spark, d, "events").select(F.col("user_id").cast("string").alias("slug"), F.when(F.col("event_id") % 10 == 0, "bad").otherwise(F.col("value").cast("string")).alias("value"))
    sinks.write_jsonl(rows, path := new_folder(spark, "scores"))
    return readers.read_scores(spark, path, "edit").groupBy("slug", "strategy").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("value"))


def assignment_lines(spark: SparkSession, d: str) -> DataFrame:
    """Assignments by item, whose slug holds a double underscore itself."""
    rows = read_table(spark, d, "embeddings").select(F.concat(F.col("vec_id").cast("string"), F.lit("__a__view")).alias("item_id"), F.col("label").alias("cluster_id"))
    sinks.write_assignments(rows, path := new_folder(spark, "assignments"))
    return readers.read_assignments(spark, path).select("slug", "cluster_id")


def representative_lines(spark: SparkSession, d: str) -> DataFrame:
    rows = view(spark, d, "representatives").select("cluster_id", "rank", F.concat(F.col("slug").cast("string"), F.lit("__v")).alias("item_id"), F.col("slug").cast("string").alias("slug"), F.lit("v").alias("view"))
    sinks.write_representatives(rows, path := new_folder(spark, "representatives"))
    return readers.read_representatives(spark, path).select("cluster_id", "rank", "item_id", "slug", "view")


def member_lists(spark: SparkSession, d: str) -> DataFrame:
    sinks.write_members(view(spark, d, "assignments"), path := new_folder(spark, "members"))
    read = spark.read.schema("cluster_id int, members array<long>").json(path)
    return read.select("cluster_id", F.size("members").alias("n"), F.array_min("members").alias("first"), F.array_max("members").alias("last"))


def failed_rows_split(spark: SparkSession, d: str) -> DataFrame:
    rows = read_table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("failed "), "source")).alias("error"))
    sinks.write_split_failures(rows, good := new_folder(spark, "rows"), bad := new_folder(spark, "errors"))
    of = lambda path, kind: spark.read.schema("doc_id long, error string").json(path).groupBy("error").agg(F.count("*").alias("n"), F.max("doc_id").alias("last")).withColumn("kind", F.lit(kind))
    return of(good, "row").unionByName(of(bad, "error"))


def report_lines(spark: SparkSession, d: str) -> DataFrame:
    """One CSV of frames with different columns, with texts that hold quotes, commas and line ends."""
    one = read_table(spark, d, "conversations").select(F.col("conv_id").alias("id"), F.concat(F.lit('a "q", '), F.coalesce("role", F.lit("")), F.lit(" b")).alias("text"))
    two = read_table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("id"), F.col("n_name").alias("name"))
    sinks.write_report([one, two], path := new_folder(spark, "report"))
    return readers.read_csv(spark, path, "id long, text string, name string").groupBy("text", "name").agg(F.count("*").alias("n"), F.sum("id").alias("ids"))


def records_appended(spark: SparkSession, d: str) -> DataFrame:
    rows, path = read_table(spark, d, "orders").select("o_orderkey", "o_totalprice"), new_folder(spark, "records")
    for _ in range(2):
        sinks.append_records(rows, path)
    read = spark.read.schema("o_orderkey long, o_totalprice double").json(path)
    return readers.latest_per_key(read, "o_orderkey", "o_totalprice").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


def embedding_lines(spark: SparkSession, d: str) -> DataFrame:
    """Embedding records with views and errors; one view without errors is read, and its vectors keep their length."""
    v = read_table(spark, d, "embeddings")
    rows = v.select(F.concat(F.col("vec_id").cast("string"), F.lit("__x")).alias("item_id"), F.col("vec_id").cast("string").alias("slug"), F.when(F.col("vec_id") % 2 == 0, "even").otherwise("odd").alias("view"), "embedding", F.when(F.col("vec_id") % 5 == 0, "no answer").alias("error"))
    sinks.write_jsonl(rows, path := new_folder(spark, "embeddings"))
    read = readers.read_embeddings(spark, path, "even", 64)
    return read.select(F.col("slug").cast("long").alias("vec_id"), F.size("embedding").alias("dims"), F.round(V.norm(F.col("embedding")), 4).alias("norm"))


def work_left(spark: SparkSession, d: str) -> DataFrame:
    """Orders without a returned line: those that a run still has to do."""
    done = read_table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") == "R").alias("ok"))
    return readers.unprocessed(read_table(spark, d, "orders").select("o_orderkey"), done, "o_orderkey", "ok")


def store_versions(spark: SparkSession, d: str) -> DataFrame:
    """Vectors added, some of them again in another folder, and the store's statistics."""
    v = read_table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), F.concat(F.lit("f"), F.col("label").cast("string")).alias("folder"), "embedding")
    store = VectorStore(spark, new_folder(spark, "store"))
    store.add(v)
    store.add(v.where("cast(id as int) % 3 = 0").withColumn("folder", F.lit("moved")))
    return store.statistics()


def slug_forms(spark: SparkSession, d: str) -> DataFrame:
    item = F.concat("source", F.lit("__"), F.col("doc_id").cast("string"), F.lit("__"), F.coalesce("lang", F.lit("")))
    rows = read_table(spark, d, "documents").select("doc_id", item.alias("item"), "source")
    return rows.select("doc_id", P.slug_of(F.col("item")).alias("last"), P.slug_of(F.col("item"), "first").alias("first"), P.slug_of(F.col("source")).alias("plain"), P.slug_fold(F.upper("source")).alias("folded"), P.markdown_escape(F.concat("source", F.lit("|x"))).alias("cell"))


def relative_paths(spark: SparkSession, d: str) -> DataFrame:
    root = F.when(F.col("p_partkey") % 4 == 0, "/w/b/source/org/").when(F.col("p_partkey") % 4 == 1, "/w/src/main/java/org/").when(F.col("p_partkey") % 4 == 2, "/w/src/org/").otherwise("/w/lib/org/")
    return read_table(spark, d, "part").select("p_partkey", P.relative_path(F.concat(root, "p_brand", F.lit(".java"))).alias("path"))


def test_logs(spark: SparkSession, d: str) -> DataFrame:
    """Logs made of orders: with a count and names, without, and of builds that failed."""
    k, n = F.col("o_orderkey") % 5, F.col("o_orderkey") % 3
    names = F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1)).cast("int")), lambda i: F.concat(F.lit("  - a.B::t"), i.cast("string"))), "\n")
    log = F.when(k == 0, F.concat(F.lit("BUILD FAILED\n"), "o_orderpriority")).when(k == 1, F.col("o_orderpriority")).otherwise(F.concat(F.lit("x\nFailing tests: "), n.cast("string"), F.when(n > 0, F.concat(F.lit("\n"), names)).otherwise("")))
    got = T.parse_test_output(log)
    return read_table(spark, d, "orders").select("o_orderkey", P.test_verdict(log).alias("verdict"), got["failing"].alias("failing"), F.size(got["names"]).alias("names"))


def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "documents").select("doc_id", F.md5(T.number_lines(F.col("text"), F.lit(5))).alias("digest"))


def code_block_list(spark: SparkSession, d: str) -> DataFrame:
    plain = F.replace("text", F.lit("`"), F.lit("'"))
    answer = F.concat(F.lit("a\n```java\n"), plain, F.lit("\n```\nb\n```\n"), "role", F.lit("\n```\n"))
    blocks = T.code_blocks(answer)
    return read_table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", F.size(blocks).alias("n"), F.md5(blocks[0]).alias("first"), blocks[1].alias("second"))


def chunk_windows(spark: SparkSession, d: str) -> DataFrame:
    """Every window of 50 words that shares 10 with the one before."""
    return read_table(spark, d, "documents").where("text is not null").select("doc_id", F.posexplode(T.chunk_tokens(F.col("text"), 50, 10)).alias("place", "chunk")).select("doc_id", "place", F.md5("chunk").alias("digest"))


def cosine_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """Cosine and squared distance of each vector to the one with the next id."""
    v = read_table(spark, d, "embeddings").select("vec_id", "embedding")
    after = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    a, b = F.col("embedding"), F.col("b")
    return v.join(after, "vec_id").select("vec_id", F.round(V.cosine_distance(a, b), 6).alias("cosine"), F.round(V.squared_l2(a, b), 6).alias("squared"))


_ALL = (
    score_lines, assignment_lines, representative_lines, member_lists, failed_rows_split, report_lines, records_appended, embedding_lines, work_left, store_versions, slug_forms, relative_paths, test_logs, numbered_lines, code_block_list, chunk_windows,
    cosine_neighbours,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    return {
        "score_lines": "select cast(user_id as varchar) as slug, 'edit' as strategy, count(*) as n, round(avg(value), 6) as value from events where event_id % 10 <> 0 and value is not null group by user_id",
        "assignment_lines": "select vec_id || '__a' as slug, label as cluster_id from embeddings where label is not null",
        "representative_lines": with_views("select cast(cluster_id as int) as cluster_id, cast(rank as int) as rank, slug || '__v' as item_id, cast(slug as varchar) as slug, 'v' as view from representatives", duck=True),
        "member_lists": "select label as cluster_id, cast(count(*) as int) as n, min(vec_id) as first, max(vec_id) as last from embeddings group by label",
        "failed_rows_split": "select error, count(*) as n, max(doc_id) as last, case when error is null then 'row' else 'error' end as kind from (select doc_id, case when doc_id % 7 = 0 then 'failed ' || source end as error from documents) t group by error",
        "report_lines": "select 'a \"q\", ' || coalesce(role, '') || ' b' as text, null as name, count(*) as n, cast(sum(conv_id) as bigint) as ids from conversations group by role union all select null, n_name, count(*), cast(sum(n_nationkey) as bigint) from nation group by n_name",
        "records_appended": "select count(*) as n, round(sum(o_totalprice), 2) as total from orders",
        "embedding_lines": "select vec_id, cast(len(embedding) as int) as dims, round(sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))), 4) as norm from embeddings where vec_id % 2 = 0 and vec_id % 5 <> 0",
        "work_left": "select o_orderkey from orders where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')",
        "store_versions": "select case when vec_id % 3 = 0 then 'moved' else 'f' || label end as folder, count(*) as vectors, cast(max(len(embedding)) as int) as dims from embeddings group by 1",
        "slug_forms": "select doc_id, source || '__' || doc_id as last, source as first, source as plain, lower(source) as folded, source || '\\|x' as cell from documents",
        "relative_paths": "select p_partkey, case p_partkey % 4 when 0 then 'source/org/' when 1 then 'src/main/java/org/' when 2 then 'src/org/' else '/w/lib/org/' end || p_brand || '.java' as path from part",
        "test_logs": "select o_orderkey, case when o_orderkey % 5 = 0 then 'compile' when o_orderkey % 5 = 1 then 'unknown' when o_orderkey % 3 = 0 then 'passed' else 'failed' end as verdict, cast(case when o_orderkey % 5 > 1 then o_orderkey % 3 end as int) as failing, cast(case when o_orderkey % 5 > 1 then o_orderkey % 3 else 0 end as int) as names from orders",
        "numbered_lines": "select doc_id, md5(array_to_string(list_transform(string_split(text, chr(10)), lambda x, i: x || ' // Line ' || (i + 4)), chr(10))) as digest from documents",
        "code_block_list": "select conv_id, turn, cast(2 as int) as n, md5(replace(text, '`', '''') || chr(10)) as first, role || chr(10) as second from conversations where text is not null",
        "chunk_windows": "with w as (select doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') as words from documents where text is not null), s as (select doc_id, words, unnest(range(0, greatest(1, cast(ceil((len(words) - 10) / 40) as bigint)))) as place from w) select doc_id, cast(place as int) as place, md5(coalesce(array_to_string(words[40 * place + 1:40 * place + 50], ' '), '')) as digest from s",
        "cosine_neighbours": "select vec_id, round(1 - dot / (na * nb), 6) as cosine, round(squared, 6) as squared from (select a.vec_id, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: cast(x[1] as double) * x[2])) as dot, sqrt(list_sum(list_transform(a.embedding, lambda x: cast(x as double) * x))) as na, sqrt(list_sum(list_transform(b.embedding, lambda x: cast(x as double) * x))) as nb, list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (cast(x[1] as double) - x[2]) * (cast(x[1] as double) - x[2]))) as squared from embeddings a join embeddings b on b.vec_id = a.vec_id + 1) t",
    }
