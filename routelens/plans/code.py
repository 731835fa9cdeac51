"""Queries over source code, patches and stored results; sources and patches are derived from the given tables.

``part`` becomes Java classes of 20 parts each: overloaded methods of three shapes with braces in strings and comments, every
fifth with an anonymous class. Oracles compute lines and results from the parts' columns, without reading any source.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from routelens.adapters import read_table, view, with_views
from routelens.functions import chunks, java
from routelens.functions import responses as R
from routelens.functions import diffs as D
from routelens.functions import patches as P
from routelens.functions import text as T
from routelens.functions import vectors as V
from routelens.operators import grid, ivf, layout, methods, normalize, patch_items, prompts, ranks
from routelens.operators.shared import new_folder
from routelens.sources import evaluation, hierarchy

_SHAPES = ("final java.util.Map<String, List<T>> a", "final Map<String, T> a, int[] b", "String... c")
_TYPES = ("Map", "Map,int[]", "String[]")


def _name() -> Column:
    return F.concat(F.lit("f"), (F.col("p_partkey") % 7).cast("string"))


def _of_shape(options: tuple[str, ...]) -> Column:
    return F.when(F.col("p_partkey") % 3 == 0, options[0]).when(F.col("p_partkey") % 3 == 1, options[1]).otherwise(options[2])


def _parts(spark: SparkSession, d: str) -> DataFrame:
    nested = F.when(F.col("p_partkey") % 5 == 0, "        go(new Runnable() { @Override\n            public void run() { { } }\n        });\n").otherwise("")
    text = F.concat(
        F.lit("    // { "), "p_name", F.lit("\n    public static <T> int "), _name(), F.lit("("), _of_shape(_SHAPES), F.lit(") {\n        String s = \"} "), "p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit("\";\n"),
        nested, F.repeat(F.lit("        if (a != null) { b('{'); }\n"), (F.col("p_size") % 3).cast("int")), F.lit("        return "), F.col("p_size").cast("string"), F.lit(";\n    }\n"),
    )
    return read_table(spark, d, "part").select("*", F.expr("p_partkey div 20").alias("file"), text.alias("method"))


def _files(spark: SparkSession, d: str) -> DataFrame:
    held = _parts(spark, d).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("p_partkey", "method"))).alias("ms"))
    source = F.concat(F.lit("package a;\n/* class { */\npublic class C"), F.col("file").cast("string"), F.lit(" {\n"), F.array_join(F.transform("ms", lambda m: m["method"]), ""), F.lit("}\n"))
    return held.select(_path().alias("path"), F.concat(F.lit("r"), (F.col("file") % 5).cast("string")).alias("repo"), source.alias("source"))


def _path() -> Column:
    return F.concat(F.lit("repo/src/C"), F.col("file").cast("string"), F.lit(".java"))


def java_method_ranges(spark: SparkSession, d: str) -> DataFrame:
    return methods.method_table(_files(spark, d)).select("path", "key", "first_line", "last_line")


def java_methods_located(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.concat(F.lit("public int "), _name(), F.lit("("), F.when(F.col("p_size") % 10 == 0, "long q").otherwise(_of_shape(("Map<K, V> x", "Map<K, V> x, int[] y", "String[] z"))), F.lit(")"))
    asked = _parts(spark, d).select(F.col("p_partkey").alias("id"), _path().alias("path"), wanted.alias("signature"))
    return methods.locate_methods(_files(spark, d), asked).select("id", "found", "first_line", "last_line")


def method_ranges_by_text(spark: SparkSession, d: str) -> DataFrame:
    """Ranges by the text of a method's first line; every fourth with other white space, which only its line matches."""
    line = F.concat(F.lit("public static <T> int "), _name(), F.lit("("), _of_shape(_SHAPES))
    head = F.when(F.col("p_partkey") % 4 == 0, F.concat(F.lit("  "), line)).otherwise(line)
    asked = _parts(spark, d).select("p_partkey", _path().alias("path"), head.alias("head"), (F.col("p_size") % 3 + 4).alias("length"))
    found = java.method_range(F.col("source"), F.col("head"), F.col("length"))
    return asked.join(_files(spark, d), "path").select("p_partkey", found["first"].alias("first_line"), found["last"].alias("last_line"))


def edits_matched_to_functions(spark: SparkSession, d: str) -> DataFrame:
    p = read_table(spark, d, "part")
    functions = p.select(F.col("p_brand").alias("case_id"), F.col("p_partkey").alias("function_id"), F.concat("p_type", F.lit("( "), F.split("p_name", " ")[0], F.lit(" a)")).alias("signature"))
    edits = p.select(F.col("p_brand").alias("case_id"), F.col("p_partkey").alias("edit_id"), F.concat(F.lit("### public "), "p_type", F.lit(" ("), F.split("p_name", " ")[0], F.lit("\ta) {\nbody")).alias("text"))
    return methods.match_edits(functions, edits)[0]


def source_file_search(spark: SparkSession, d: str) -> DataFrame:
    wanted = _parts(spark, d).select(F.col("p_partkey").alias("id"), F.concat(F.lit("r"), (F.col("file") % 5).cast("string")).alias("repo"), F.concat(_name(), F.lit("("), _of_shape(_TYPES), F.lit(")")).alias("signature"), F.concat(F.lit("return "), F.col("p_size").cast("string"), F.lit(";")).alias("block"))
    return methods.source_file_of(_files(spark, d), wanted).select("id", "path", "candidates", "chosen")


def _patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch a part: an edit in its method, by a line that is its own, or by one that others may share; or a rewrite."""
    p, k = _parts(spark, d), F.col("p_partkey") % 4
    signature = F.concat(_name(), F.lit("("), _of_shape(_TYPES), F.lit(")"))
    back, own = F.concat(F.lit("return "), F.col("p_size").cast("string"), F.lit(";")), F.concat(F.lit('String s = "} '), "p_type", F.lit(" "), F.col("p_partkey").cast("string"), F.lit('";'))
    code = F.concat(F.lit("public int "), _name(), F.lit("() {\n    return 1;\n}"))
    block = F.struct(F.when(k.isin(0, 2), signature).otherwise("gone()").alias("signature"), F.when(k == 1, own).when(k != 2, back).alias("search"), F.when(k == 2, code).otherwise("        x();").alias("replace"))
    return p.select(F.col("p_partkey").alias("id"), _path().alias("path"), F.when(k == 2, "rewrite").otherwise("edit").alias("kind"), F.array(block).alias("blocks"))


def patches_normalized(spark: SparkSession, d: str) -> DataFrame:
    got = normalize.normalize(_patches(spark, d), _files(spark, d), with_source=True)
    last = F.element_at(F.transform("tried", lambda x: x["quality"]), -1)
    after = F.when(F.col("diff").isNotNull(), F.md5(P.apply_unified_diff("source", "diff")))
    return got.select("id", "strategy", "located", F.size("tried").alias("failures"), F.when(F.size("tried") > 0, last).alias("quality"), after.alias("after"))


def normalization_reports(spark: SparkSession, d: str) -> DataFrame:
    reports = normalize.report_rows(normalize.normalize(_patches(spark, d), _files(spark, d)))
    return normalize.report_summary(reports).select("status", "strategy", "n", F.round("share", 6).alias("share"))


def _diff(counted: Column) -> Column:
    head = F.concat(F.lit("@@ -1,"), counted.cast("string"), F.lit(" +1,"), counted.cast("string"), F.lit(" @@\n"))
    return F.concat(head, F.array_join(F.transform(F.split("text", "\n", -1), lambda x: F.concat(F.lit(" "), x)), "\n"))


def diff_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Diffs of documents, each broken in the way that its id says, and hunks whose counts are off."""
    docs, k = read_table(spark, d, "documents").where("text is not null"), F.col("doc_id") % 9
    count = F.size(F.split("text", "\n", -1)) + F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    names, body = F.lit("--- a/x\n+++ b/x\n"), _diff(count)
    patch = (
        F.when(k == 0, F.concat(names, body)).when(k == 1, F.concat(F.lit("+++ b/x\n"), body)).when(k == 2, F.concat(F.lit("--- a/x\n"), body)).when(k == 3, names)
        .when(k == 4, F.concat(F.lit("+++ b/x\n--- a/x\n"), body)).when(k == 5, F.concat(names, F.lit("@@ -1,x +1 @@\n"), body)).when(k == 6, F.concat(names, F.lit("@@ -0,1 +1,1 @@\n"), body)).when(k == 7, F.concat(names, body, F.lit("\nodd"))).otherwise(" \n")
    )
    made = docs.select("doc_id", patch.alias("patch"))
    return made.select("doc_id", D.diff_error(F.col("patch")).alias("error"), F.size(D.hunk_count_errors(F.col("patch"))).alias("miscounted"))


def patch_verifications(spark: SparkSession, d: str) -> DataFrame:
    """Diffs of documents against their reversals, some of them changed afterwards, and the order of their lines."""
    docs, k = read_table(spark, d, "documents").where("text is not null"), F.col("doc_id") % 5
    lines = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 3 == 0, "-").when(i % 3 == 1, "+").otherwise(" "), F.lit("."), x)), "\n")
    patch = F.concat(F.lit("--- a/x\n+++ b/x\n@@ -1,9 +1,9 @@\n-old\n+new\n"), lines)
    made = docs.select("doc_id", patch.alias("patch"), T.reverse_patch(patch).alias("back"))
    changed = F.when(k == 1, F.concat("back", F.lit("\n+more"))).when(k == 2, F.concat("back", F.lit("\n-more"))).when(k == 3, F.concat("back", F.lit("\n more"))).when(k == 4, F.concat("back", F.lit("\n@@ -1 +1 @@"))).otherwise(F.col("back"))
    return made.select("doc_id", D.reversal_error(F.col("patch"), changed).alias("error"), D.misplaced_deletions(F.col("patch")).alias("misplaced"))


def cut_lines_joined(spark: SparkSession, d: str) -> DataFrame:
    cut = F.regexp_replace("text", r"([^\n]{78})", "$1\n")
    return read_table(spark, d, "documents").select("doc_id", F.md5(D.join_cut_lines(cut)).alias("digest"))


def chunks_halved(spark: SparkSession, d: str) -> DataFrame:
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    cut = read_table(spark, d, "documents").select("doc_id", chunks.halved_counted("text", 300, ranks, pattern).alias("cut"))
    return cut.select("doc_id", F.md5(F.array_join("cut.pieces", "")).alias("digest"), (F.array_max("cut.tokens") <= 300).alias("within"))


def edits_applied_in_order(spark: SparkSession, d: str) -> DataFrame:
    edit = lambda a, b: F.struct(F.lit(a).alias("search"), F.lit(b).alias("replace"))
    one = D.apply_in_order(F.col("text"), F.array(edit("the", "THE"), edit("THE ", "a the "), edit("of", "OF")))
    many = D.apply_all(F.array("text", F.lit("of the")), F.array(edit("the", "x"), edit("of", "")))
    return read_table(spark, d, "documents").select("doc_id", F.md5(one).alias("digest"), F.size(many).alias("n"))


def edit_checks(spark: SparkSession, d: str) -> DataFrame:
    """Validity of edits and rewrites made of conversation turns."""
    turns, k = read_table(spark, d, "conversations"), F.col("conv_id") % 4
    edit = D.search_replace_error(F.when(k != 0, "f()"), F.when(k != 1, F.concat("text", F.lit("\n"))), F.when(k == 2, F.concat(F.lit(" "), "text")).otherwise(F.concat(F.lit("x"), "text")))
    return turns.select("conv_id", "turn", edit.alias("edit_error"), D.rewrite_error(F.col("role"), F.when(k == 0, F.concat(F.lit("{"), "text", F.lit("}"))).otherwise(F.col("text"))).alias("rewrite_error"))


def block_counts(spark: SparkSession, d: str) -> DataFrame:
    """Functions asked for against edits answered, in pairs made of each turn."""
    fence = F.concat(F.lit("```java\n"), F.replace("text", F.lit("`"), F.lit("")), F.lit("\n```\n"))
    asked = F.concat(F.lit("```c\nx\n```\n"), F.when(F.col("role") != "system", "### Buggy functions\n").otherwise(""), F.repeat(fence, (F.col("turn") % 4).cast("int")))
    answer = F.repeat(F.lit("<<<<<<<  SEARCH\na\n=======\nb\n>>>>>>> REPLACE\n"), (F.col("conv_id") % 4).cast("int"))
    got = D.block_check(asked, answer)
    return read_table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", got["functions"].alias("functions"), got["edits"].alias("edits"), got["same"].alias("same"))


def tree_positions(spark: SparkSession, d: str) -> DataFrame:
    """Regions, nations and customers as a tree under one root."""
    of = lambda prefix, key: F.concat(F.lit(prefix), F.col(key).cast("string"))
    region = read_table(spark, d, "region").select(of("r", "r_regionkey").alias("node"), F.lit("root").alias("parent"))
    nation = read_table(spark, d, "nation").select(of("n", "n_nationkey").alias("node"), of("r", "n_regionkey").alias("parent"))
    customer = read_table(spark, d, "customer").select(of("c", "c_custkey").alias("node"), of("n", "c_nationkey").alias("parent"))
    root = spark.createDataFrame([("root", None)], "node string, parent string")
    return layout.tree_layout(root.unionByName(region).unionByName(nation).unionByName(customer)).select("node", "depth", F.round("x", 6).alias("x"))


def _results(spark: SparkSession, d: str) -> DataFrame:
    found = view(spark, d, "attempts").groupBy("slug").agg(F.count("*").cast("int").alias("total_attempts"), F.min(F.when(F.col("reward"), F.col("attempt"))).cast("int").alias("successful_attempt"))
    return found.select(F.col("slug").cast("string").alias("bug"), "total_attempts", "successful_attempt", F.when(F.col("slug") % 2 == 0, "edit").otherwise("rewrite").alias("modeling_type"), (F.col("slug") % 10 / 4).alias("seconds"))


def evaluation_stored(spark: SparkSession, d: str) -> DataFrame:
    """Results saved twice, the second time for bugs of an odd number alone with a second more, and their batch result."""
    store, results = evaluation.EvaluationStore(spark, new_folder(spark, "evaluation")), _results(spark, d)
    store.save_results(results)
    store.save_results(results.where("modeling_type = 'rewrite'").withColumn("seconds", F.col("seconds") + 1))
    return store.batch_result().select("bugs", "fixed", "failed", "edit_fixed", "rewrite_fixed", F.round("share", 6).alias("share"), F.round("edit_share", 6).alias("edit_share"), "attempts", F.round("mean_attempts", 6).alias("mean_attempts"), F.round("seconds", 6).alias("seconds"))


def _index_search(spark: SparkSession, d: str, kind: str) -> DataFrame:
    rows = read_table(spark, d, "embeddings")
    index = ivf.IVFIndex.build(rows.select(F.col("vec_id").cast("string").alias("id"), "embedding"), new_folder(spark, "index"), kind)
    asked = rows.where("vec_id % 20 = 0").select(F.col("vec_id").cast("string").alias("query_id"), "embedding")
    return index.search(asked, 10).select(F.col("query_id").cast("long").alias("query_id"), "rank", F.col("id").cast("long").alias("vec_id"), F.round("dist", 6).alias("dist"))


def ivf_pq_search(spark: SparkSession, d: str) -> DataFrame:
    """Ten nearest of every vector whose id is divisible by 20, among all, by product-quantised lists."""
    return _index_search(spark, d, "ivf_pq")


def ivf_flat_search(spark: SparkSession, d: str) -> DataFrame:
    """The same by lists of whole vectors."""
    return _index_search(spark, d, "ivf_flat")


def member_rank(spark: SparkSession, d: str) -> DataFrame:
    """Members of each label by distance to its centre; no label is sorted in one task."""
    rows = read_table(spark, d, "embeddings").where("embedding is not null")
    centres = rows.groupBy("label").agg(vector_to_array(Summarizer.mean(array_to_vector("embedding"))).alias("c"))
    dist = rows.join(centres, "label").select("label", "vec_id", V.squared_l2(F.col("embedding"), F.col("c")).alias("dist")).withColumn("near", F.round("dist", 9))
    return ranks.placed(dist, ["label"], ["near", "vec_id"]).select("label", "vec_id", F.col("place").cast("int").alias("place"), F.round("dist", 6).alias("dist"))


def answers_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Answers made of conversation turns: edits with and without a heading, rewrites, of a kind that is given or unknown."""
    k = F.col("conv_id") % 4
    edit = F.concat(F.lit("### int f(int a)\n<<<<<<< SEARCH\n"), F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\n=======\nnew\n>>>>>>> REPLACE\n<<<<<<< SEARCH\nx\n=======\nx\n>>>>>>> REPLACE\n"))
    rewrite = F.concat(F.lit("### g()\n```java\nint g() { return "), F.col("turn").cast("string"), F.lit("; }\n```\nand\n```java\nlong h(int z)\n```\n"))
    got = R.parse_answer(F.when(k == 0, edit).otherwise(rewrite), F.lit(""), F.when(k == 2, "other").when(k == 3, "rewrite"))
    held = read_table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", got.alias("x"))
    says = lambda c, of: F.array_join(F.transform(F.col(f"x.{c}"), lambda e: F.concat_ws(":", e["signature"], F.coalesce(e["error"], F.lit("ok")))), ",")
    return held.select("conv_id", "turn", "x.kind", "x.ok", "x.error", says("edits", "search").alias("edits"), says("rewrites", "code").alias("rewrites"))


def prompt_queries(spark: SparkSession, d: str) -> DataFrame:
    """Prompts for customers as bugs, their orders as functions and failing orders as messages."""
    orders = read_table(spark, d, "orders")
    name = F.concat(F.lit("f"), F.col("o_orderkey").cast("string"))
    functions = orders.select(
        F.col("o_custkey").alias("slug"), F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderpriority")).alias("comment"), F.concat(F.lit("void "), name, F.lit("() { }")).alias("buggy_code"), F.concat(F.lit("/w/"), F.col("o_custkey").cast("string"), F.lit("_buggy/A.java")).alias("path"),
        F.col("o_orderkey").alias("start_line"), (F.col("o_orderkey") + 1).alias("end_line"), name.alias("method_name"), F.concat(name, F.lit("()")).alias("method_sig"),
    )
    messages = orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("slug"), F.concat(F.lit("E"), F.col("o_orderkey").cast("string")).alias("exception_info"), F.lit(None).cast("string").alias("test_method"))
    query = prompts.build_query("agent", "C:{BUGGY_COMMENT}E:{ERROR_MESSAGE}\nT:{FAILED_TEST}\nB:{BUGGY_CODE}")
    return prompts.bug_info(functions, messages).select("slug", "func_num", F.size("method_names").alias("names"), F.md5(query).alias("digest"))


def hierarchy_lines(spark: SparkSession, d: str) -> DataFrame:
    """Regions and nations with their customers as the JSON of a hierarchical clustering, read back as lines of a tree."""
    c = read_table(spark, d, "customer").join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    level = lambda name, parent: c.groupBy(name.alias("key"), parent.alias("parent")).agg(F.count("*").alias("size"))
    region, nation = F.concat(F.lit("r"), F.col("n_regionkey").cast("string")), F.concat(F.lit("n"), F.col("n_nationkey").cast("string"))
    as_map = lambda rows, name: rows.agg(F.map_from_entries(F.collect_list(F.struct("key", F.struct("parent", "size")))).alias("m")).select(F.lit(name).alias("name"), "m")
    both = as_map(level(region, F.lit(None).cast("string")), "level_0").unionByName(as_map(level(nation, region), "level_1"))
    text = both.agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(F.struct("name", "m"))).alias("hierarchy"))).alias("value"))
    return hierarchy.tree_lines(hierarchy.clusters_of(text))


def _document_patches(spark: SparkSession, d: str) -> DataFrame:
    """A patch a document: its lines added, deleted or left by their number and the document's; null texts give none."""
    k = F.col("doc_id") % 4
    sign = lambda i: F.when(k == 0, F.when(i % 2 == 0, "+").otherwise("-")).when(k == 1, "+").when(k == 2, F.when(i % 3 == 0, "-").otherwise(" ")).otherwise(" ")
    body = F.array_join(F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(sign(i), F.lit("."), x)), "\n")
    path = F.concat(F.lit("src/A"), F.when(F.col("doc_id") % 3 == 0, ".java").when(F.col("doc_id") % 3 == 1, ".xml").otherwise(""))
    return read_table(spark, d, "documents").select(F.col("source").alias("project"), F.col("doc_id").alias("bug_id"), F.concat(F.lit("--- a/"), path, F.lit("\n+++ b/"), path, F.lit("\n@@ -1,1 +1,1 @@\n"), body).alias("text"))


def patch_sizes(spark: SparkSession, d: str) -> DataFrame:
    return patch_items.patch_items(_document_patches(spark, d), reverse=True).select("item_id", "source_file", "file_path", "additions", "deletions", "total_changes")


def patch_statistics(spark: SparkSession, d: str) -> DataFrame:
    got = patch_items.patch_statistics(patch_items.patch_items(_document_patches(spark, d)))
    return got.select("kind", "name", "n", "least", "most", *(F.round(c, 6).alias(c) for c in ("mean", "median", "deviation")))


def interesting_patches(spark: SparkSession, d: str) -> DataFrame:
    return patch_items.interesting_patches(patch_items.patch_items(_document_patches(spark, d)))


def _grid(spark: SparkSession, d: str, algorithms: list[str], samplers: list[str], reps: list[int]) -> DataFrame:
    got = grid.run_grid(read_table(spark, d, "embeddings"), view(spark, d, "score_pairs"), algorithms, [5, 10], samplers, reps, ["majority", "mean_score"])
    return got.select("algorithm", "k", "sampler", "reps", "voting", "clusters", "total", "wins", *(F.round(c, 6).alias(c) for c in ("win_rate", "mean_score", "oracle_score")))


def experiment_grid_given(spark: SparkSession, d: str) -> DataFrame:
    """The grid over the labels as the clustering, with one and two farthest-first representatives."""
    return _grid(spark, d, ["given"], ["farthest_first"], [1, 2])


def experiment_grid_fitted(spark: SparkSession, d: str) -> DataFrame:
    """The grid over fitted clusterings and both samplers."""
    return _grid(spark, d, ["kmeans", "bisecting", "hierarchical"], ["farthest_first", "kdpp"], [1, 3])


_ALL = (
    experiment_grid_given, experiment_grid_fitted, member_rank, answers_parsed, prompt_queries, hierarchy_lines, patch_sizes, patch_statistics, interesting_patches,
    java_method_ranges, java_methods_located, method_ranges_by_text, edits_matched_to_functions, source_file_search, patches_normalized, normalization_reports, diff_verdicts, patch_verifications, cut_lines_joined, chunks_halved, edits_applied_in_order,
    edit_checks, block_counts, tree_positions, evaluation_stored, ivf_pq_search, ivf_flat_search,
)

#: Each part's lines in its file: a comment, the head, a string, what is nested or repeated, the return and the end.
_PARTS_SQL = """parts as (select *, p_partkey // 20 as file, 'f' || (p_partkey % 7) as name, case p_partkey % 3 when 0 then 'Map' when 1 then 'Map,int[]' else 'String[]' end as types,
  5 + p_size % 3 + case when p_partkey % 5 = 0 then 3 else 0 end as lines from part),
placed as (select *, 4 + cast(coalesce(sum(lines) over (partition by file order by p_partkey rows between unbounded preceding and 1 preceding), 0) as int) as comment_line, 'repo/src/C' || file || '.java' as path from parts)"""
_PATCHES_SQL = """counted as (select doc_id, source, len(string_split(text, chr(10))) as n, 'src/A' || case doc_id % 3 when 0 then '.java' when 1 then '.xml' else '' end as file_path, case doc_id % 3 when 0 then '.java' when 1 then '.xml' else '' end as extension from documents where text is not null),
items as (select source || '_' || doc_id || '__patch' as item_id, doc_id, source, file_path, extension, cast(case doc_id % 4 when 0 then (n + 1) // 2 when 1 then n else 0 end as int) as additions, cast(case doc_id % 4 when 0 then n // 2 when 2 then (n + 2) // 3 else 0 end as int) as deletions from counted)"""
_TEXT_SQL = """texts as (select *, '    // { ' || p_name || chr(10) as comment, '    public static <T> int ' || name || '(' || case p_partkey % 3 when 0 then 'final java.util.Map<String, List<T>> a' when 1 then 'final Map<String, T> a, int[] b' else 'String... c' end || ') {' || chr(10) as head,
  '        String s = "} ' || p_type || ' ' || p_partkey || '";' || chr(10) as own, case when p_partkey % 5 = 0 then '        go(new Runnable() { @Override' || chr(10) || '            public void run() { { } }' || chr(10) || '        });' || chr(10) else '' end || repeat('        if (a != null) { b(''{''); }' || chr(10), p_size % 3) as rest,
  '        return ' || p_size || ';' || chr(10) as back, '    }' || chr(10) as tail from placed)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in _ALL}


def oracle_sql() -> dict[str, str]:
    lines = "from (select doc_id, unnest(range(1, len(l) + 1)) as i, unnest(l) as line, unnest(list_append(l[2:], null)) as after"
    return {
        "java_method_ranges": f"with {_PARTS_SQL} select path, name || '(' || types || ')' as key, cast(comment_line + 1 as int) as first_line, cast(comment_line + lines - 1 as int) as last_line from placed union all select path, 'run()', cast(comment_line + 3 as int), cast(comment_line + 4 as int) from placed where p_partkey % 5 = 0",
        "java_methods_located": f"with {_PARTS_SQL} select p_partkey as id, p_size % 10 <> 0 as found, cast(case when p_size % 10 <> 0 then comment_line + 1 end as int) as first_line, cast(case when p_size % 10 <> 0 then comment_line + lines - 1 end as int) as last_line from placed",
        "method_ranges_by_text": f"with {_PARTS_SQL} select p_partkey, cast(comment_line as int) as first_line, cast(comment_line + p_size % 3 + 4 as int) as last_line from placed",
        "edits_matched_to_functions": "select f.p_brand as case_id, f.p_partkey as function_id, e.p_partkey as edit_id from part f join part e on f.p_brand = e.p_brand and contains(regexp_replace('public' || e.p_type || '(' || split_part(e.p_name, ' ', 1) || 'a){', '\\s', '', 'g'), regexp_replace(f.p_type || '(' || split_part(f.p_name, ' ', 1) || 'a)', '\\s', '', 'g'))",
        "source_file_search": f"with {_PARTS_SQL}, held as (select file % 5 as repo, name, types, path, p_size from placed), asked as (select p_partkey, file % 5 as repo, name, types, p_size from placed) select p_partkey as id, coalesce(min(case when h.p_size = a.p_size then path end), min(path)) as path, count(distinct path) as candidates, case when count(distinct path) = 1 then 'only' when count(case when h.p_size = a.p_size then 1 end) > 0 then 'block' else 'first' end as chosen from asked a join held h using (repo, name, types) group by p_partkey",
        "normalization_reports": f"with {_PARTS_SQL}, same as (select *, count(*) over (partition by file, p_size) as same from placed) select status, strategy, count(*) as n, round(count(*) / (select count(*) from part), 6) as share from (select case when p_partkey % 4 = 3 and same > 1 then 'ambiguous' else 'success' end as status, case when p_partkey % 4 in (0, 2) then 'method_scoped_exact' when p_partkey % 4 = 1 or same = 1 then 'file_scoped_exact' else 'manual_review' end as strategy from same) t group by status, strategy",
        "patches_normalized": f"""with {_PARTS_SQL}, {_TEXT_SQL}, same as (select *, count(*) over (partition by file, p_size) as n, 'package a;' || chr(10) || '/* class {{ */' || chr(10) || 'public class C' || file || ' {{' || chr(10) as top from texts),
outcome as (select *, case when p_partkey % 4 in (0, 2) then 'method_scoped_exact' when p_partkey % 4 = 1 or n = 1 then 'file_scoped_exact' else 'manual_review' end as strategy from same),
changed as (select a.p_partkey as id, a.strategy, a.p_partkey % 4 as k, min(a.top) || string_agg(case when b.p_partkey <> a.p_partkey then b.comment || b.head || b.own || b.rest || b.back || b.tail when a.p_partkey % 4 = 2 then b.comment || '    public int ' || b.name || '() {{' || chr(10) || '        return 1;' || chr(10) || '    }}' || chr(10)
  when a.p_partkey % 4 = 1 then b.comment || b.head || '        x();' || chr(10) || b.rest || b.back || b.tail else b.comment || b.head || b.own || b.rest || '        x();' || chr(10) || b.tail end, '' order by b.p_partkey) || '}}' || chr(10) as source from outcome a join same b using (file) group by a.p_partkey, a.strategy)
select id, strategy, cast(case when strategy = 'manual_review' then 0 else 1 end as int) as located, cast(case strategy when 'manual_review' then 2 when 'file_scoped_exact' then 1 else 0 end as int) as failures, case strategy when 'manual_review' then 'exact_ambiguous' when 'file_scoped_exact' then 'method_not_found' end as quality, case when strategy <> 'manual_review' then md5(source) end as after from changed""",
        "diff_verdicts": "select doc_id, case doc_id % 9 when 1 then 'from' when 2 then 'to' when 3 then 'hunk' when 4 then 'order' when 5 then 'header: @@ -1,x +1 @@' when 6 then 'number: @@ -0,1 +1,1 @@' when 7 then 'prefix: odd' when 8 then 'empty' end as error, cast(case when doc_id % 9 in (3, 8) then 0 else case when doc_id % 9 in (5, 6) then 1 else 0 end + case when doc_id % 9 = 7 then case when doc_id % 5 = 0 then 0 else 1 end when doc_id % 5 = 0 then 1 else 0 end end as int) as miscounted from documents where text is not null",
        "patch_verifications": "select doc_id, case doc_id % 5 when 1 then 'additions: 0' when 2 then 'deletions: 0' when 3 then 'context: 0' when 4 then 'hunks' end as error, cast(1 as int) as misplaced from documents where text is not null",
        "cut_lines_joined": f"""with split as (select doc_id, string_split(regexp_replace(text, '([^\\n]{{78}})', '\\1' || chr(10), 'g'), chr(10)) as l from documents where text is not null),
marked as (select *, coalesce(length(regexp_replace(line, '\\s+$', '')) > 75 and not regexp_matches(line, '[;,{{}})\\]:]\\s*$') and regexp_matches(after, '^\\s*[^\\s{{]') and length(regexp_extract(after, '^\\s*')) <= length(regexp_extract(line, '^\\s*')), false) as cut {lines} from split)),
counted as (select *, cut and (i - coalesce(max(case when not cut then i end) over (partition by doc_id order by i), 0)) % 2 = 1 as joins from marked),
shown as (select *, coalesce(lag(joins) over (partition by doc_id order by i), false) as taken from counted)
select doc_id, md5(string_agg(case when joins then regexp_replace(line, '\\s+$', '') || regexp_replace(after, '^\\s+', '') else line end, chr(10) order by i)) as digest from shown where not taken group by doc_id union all select doc_id, null from documents where text is null""",
        "chunks_halved": "select doc_id, md5(text) as digest, true as within from documents",
        "edits_applied_in_order": "with one as (select doc_id, text, case when contains(text, 'the') then replace(text, 'the', 'THE') end as a from documents), two as (select doc_id, text, case when contains(a, 'THE ') then replace(a, 'THE ', 'a the ') end as b from one) select doc_id, md5(case when contains(b, 'of') then replace(b, 'of', 'OF') else 'error' end) as digest, cast(case when contains(text, 'the') then 2 else 0 end as int) as n from two",
        "edit_checks": "select conv_id, turn, case when conv_id % 4 = 0 then 'signature' when conv_id % 4 = 1 then 'search' when conv_id % 4 = 2 then 'identical' end as edit_error, case when role = '' then 'signature' when conv_id % 4 = 0 then null when text = '' then 'code' when not (contains(text, '{') and contains(text, '}')) then 'braces' end as rewrite_error from conversations",
        "block_counts": "select conv_id, turn, cast(case when role <> 'system' then turn % 4 end as int) as functions, cast(case when role <> 'system' then conv_id % 4 end as int) as edits, case when role <> 'system' then turn % 4 = conv_id % 4 end as same from conversations where text is not null",
        "tree_positions": """with recursive p as (select 'root' as node, cast(null as varchar) as parent union all select 'r' || r_regionkey, 'root' from region union all select 'n' || n_nationkey, 'r' || n_regionkey from nation union all select 'c' || c_custkey, 'n' || c_nationkey from customer),
kids as (select parent, count(*) as n from p where parent is not null group by parent), leaf as (select node, row_number() over (order by node) - 1 as x from p where node not in (select parent from kids)),
depth as (select node, 0 as depth from p where parent is null union all select p.node, depth.depth + 1 from p join depth on p.parent = depth.node),
up as (select node as leaf, node, parent, cast(1 as double) as w from p where node in (select node from leaf) union all select up.leaf, p.node, p.parent, up.w / kids.n from up join kids on kids.parent = up.parent join p on p.node = up.parent)
select up.node, cast(min(depth.depth) as int) as depth, round(sum(w * leaf.x), 6) as x from up join leaf on leaf.node = up.leaf join depth on depth.node = up.node group by up.node""",
        "member_rank": with_views("select label, vec_id, cast(place as int) as place, round(dist, 6) as dist from (select *, row_number() over (partition by label order by round(dist, 9), vec_id) as place from (select d.label, d.vec_id, sum((d.x - c.c) * (d.x - c.c)) as dist from dims d join centroids c on c.label = d.label and c.pos = d.pos group by d.label, d.vec_id) t) u", duck=True),
        "hierarchy_lines": "with n as (select n_regionkey as r, n_nationkey as n, count(*) as size from customer join nation on c_nationkey = n_nationkey group by n_regionkey, n_nationkey), g as (select r, cast(sum(size) as bigint) as size from n group by r) select 0 as level, 'r' || r as cluster, 'r' || r || ': ' || size as line from g union all select 1, 'n' || n.n, '  n' || n.n || ': ' || n.size || ', ' || cast(round(100 * n.size / g.size, 1) as varchar) || ' % of r' || n.r from n join g using (r)",
        "patch_sizes": f"with {_PATCHES_SQL} select item_id, doc_id || '.src.patch' as source_file, file_path, deletions as additions, additions as deletions, additions + deletions as total_changes from items",
        "patch_statistics": f"with {_PATCHES_SQL}, each as (select 'all' as kind, '' as name, additions + deletions as s from items union all select 'project', source, additions + deletions from items union all select 'extension', extension, additions + deletions from items) select kind, name, count(*) as n, min(s) as least, max(s) as most, round(avg(s), 6) as mean, round(median(s), 6) as median, round(coalesce(stddev_samp(s), 0), 6) as deviation from each group by kind, name",
        "interesting_patches": f"with {_PATCHES_SQL} select (select item_id from items order by additions + deletions, item_id limit 1) as smallest, (select item_id from items order by additions + deletions desc, item_id limit 1) as largest, count(case when additions > 0 and deletions = 0 then 1 end) as only_additions, count(case when deletions > 0 and additions = 0 then 1 end) as only_deletions, count(case when abs(additions - deletions) <= 2 and additions + deletions > 4 then 1 end) as balanced from items",
        "answers_parsed": "select conv_id, turn, case conv_id % 4 when 0 then 'edit' when 2 then 'other' else 'rewrite' end as kind, conv_id % 4 <> 2 as ok, case when conv_id % 4 = 2 then 'unknown kind: other' end as error, case when conv_id % 4 = 0 then 'int f(int a):' || case when text = '' then 'search' when trim(replace(text, chr(10), ' ')) = 'new' then 'identical' else 'ok' end || ',:signature' else '' end as edits, case when conv_id % 2 = 1 then 'g():ok,long h(int z):braces' else '' end as rewrites from conversations where text is not null",
        "prompt_queries": "with f as (select o_custkey as slug, count(*) as n, string_agg('   ' || case when o_orderkey % 2 = 0 then trim(o_orderpriority) else 'This function has no comment.' end || chr(10), '' order by o_orderkey) as c, string_agg('```java' || chr(10) || 'void f' || o_orderkey || '() { }' || chr(10) || '```' || chr(10), '' order by o_orderkey) as b from orders group by o_custkey), m as (select o_custkey as slug, string_agg('E' || o_orderkey, chr(10) order by 'E' || o_orderkey) as e from orders where o_orderstatus = 'F' group by o_custkey) select f.slug, cast(n as int) as func_num, cast(n as int) as names, md5('C:' || c || 'E:' || coalesce(e, 'This function has no exception info.') || chr(10) || 'T:' || case when e is null then 'This function has no failed test.' else '' end || chr(10) || 'B:' || rtrim(b, chr(10))) as digest from f left join m on m.slug = f.slug",
        "experiment_grid_given": with_views("""with unit as (select vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as n from embeddings where embedding is not null),
u as (select vec_id, label, unnest(range(len(embedding))) as pos, unnest(embedding) / n as x from unit), mid as (select label, pos, avg(x) as c from u group by label, pos),
one as (select label, vec_id from (select label, vec_id, row_number() over (partition by label order by round(near, 9) desc, vec_id) as rn from (select u.label, u.vec_id, sum(u.x * mid.c) as near from u join mid on mid.label = u.label and mid.pos = u.pos group by u.label, u.vec_id)) where rn = 1),
two as (select label, vec_id from (select label, vec_id, row_number() over (partition by label order by round(far, 9) desc, vec_id) as rn from (select b.label, b.vec_id, 1 - sum(a.x * b.x) as far from one join u a on a.vec_id = one.vec_id join u b on b.label = one.label and b.pos = a.pos and b.vec_id <> one.vec_id group by b.label, b.vec_id)) where rn = 1),
reps as (select 1 as reps, label, vec_id from one union all select 2, label, vec_id from one union all select 2, label, vec_id from two),
vote as (select reps, label, count(case when p.e <= p.g or p.e is not null and p.g is null then 1 end) as ev, count(case when p.g < p.e or p.g is not null and p.e is null then 1 end) as gv, round(avg(p.e), 9) as me, round(avg(p.g), 9) as mg from reps left join score_pairs p on p.slug = reps.vec_id group by reps, label),
means as (select *, case when me is not null and (mg is null or me <= mg) then 'edit' when mg is not null then 'gen' else 'edit' end as by_mean from vote),
choice as (select reps, label, 'majority' as voting, case when ev > gv then 'edit' when gv > ev then 'gen' else by_mean end as chosen from means union all select reps, label, 'mean_score', by_mean from means),
item as (select a.label, p.e, p.g from embeddings a join score_pairs p on p.slug = a.vec_id where p.e is not null and p.g is not null and a.embedding is not null)
select 'given' as algorithm, cast(0 as int) as k, 'farthest_first' as sampler, cast(reps as int) as reps, voting, count(distinct c.label) as clusters, count(i.e) as total, count(case when chosen = case when i.e <= i.g then 'edit' else 'gen' end then i.e end) as wins,
  round(count(case when chosen = case when i.e <= i.g then 'edit' else 'gen' end then i.e end) / count(i.e), 6) as win_rate, round(sum(case when chosen = 'edit' then i.e else i.g end) / count(i.e), 6) as mean_score, round(sum(least(i.e, i.g)) / count(i.e), 6) as oracle_score from choice c left join item i on i.label = c.label group by reps, voting""", duck=True),
        "evaluation_stored": "with r as (select user_id, count(*) as total, min(case when event_type = 'purchase' then 1 end) as won, user_id % 2 = 0 as edit, (user_id % 10) / 4 + case when user_id % 2 = 0 then 0 else 1 end as seconds from events group by user_id) select count(*) as bugs, count(won) as fixed, count(*) - count(won) as failed, count(case when edit then won end) as edit_fixed, count(case when not edit then won end) as rewrite_fixed, round(count(won) / count(*), 6) as share, round(count(case when edit then won end) / count(case when edit then 1 end), 6) as edit_share, cast(sum(total) as bigint) as attempts, round(sum(total) / count(*), 6) as mean_attempts, round(sum(seconds), 6) as seconds from r",
    }
