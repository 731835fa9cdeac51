"""Queries give all their rows, and operators keep their results where groups and copies are many."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from routelens.adapters import read_table, view
from routelens.functions import chunks
from routelens.operators import cluster, methods, normalize
from routelens.plans import catalogue

DATA = "/root/testdata/sf0.001"


def test_run_diffs_lead_has_a_row_for_every_run(spark):
    got = catalogue.queries()["run_diffs_lead"](spark, DATA)
    assert got.count() == view(spark, DATA, "runs").count()
    assert got.where("next_ts is null").count() == view(spark, DATA, "runs").select("slug").distinct().count()


def test_source_search_meets_no_pairs(spark):
    """Each wanted method of a signature that all files share finds its block's first file; rows of joins don't multiply."""
    body = lambda i: f"class C{i} {{\n int f(int a) {{\n  x{i % 3}();\n\n  y{i % 2}();\n }}\n}}"
    files = spark.createDataFrame([("r", f"p{i:03d}", body(i)) for i in range(300)] + [("r", "p000", None), ("r", None, "")], "repo string, path string, source string")
    blocks = ["x1();\ny1();", "x2();", "{\n  x2();\n}\n y1();\n", "y1();\nx1();", "", None, "int f(int a) {\n x2();"]
    wanted = spark.createDataFrame([(i, "r", "f(int z)", blocks[i % 7]) for i in range(350)] + [(900, None, "f(int z)", "x1();"), (901, "r", None, None)], "id int, repo string, signature string, block string")
    found = methods.source_file_of(files, wanted)
    first = ["p001", "p002", "p005", None, None, None, "p002"]
    want = {(i, first[i % 7] or "p000", 300, "block" if first[i % 7] else "first") for i in range(350)} | {(900, None, 0, None), (901, None, 0, None)}
    assert {tuple(r) for r in found.collect()} == want and found.count() == 352
    widest = found._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in widest and "Window" not in widest


@pytest.mark.parametrize("linkage", ["average", "ward", "single", "complete"])
def test_trees_by_rounds_are_the_trees_of_the_matrix(linkage):
    r = np.random.default_rng(0)
    x = r.normal(size=(400, 12))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    tree = cluster.merge_tree(x, linkage)
    for most in (1, 60):
        other = cluster.merge_rounds(x.copy(), np.ones(400), linkage, most)
        assert np.allclose([m[2] for m in tree], [m[2] for m in other])
        assert all(cluster.cut_tree(tree, 400, k) == cluster.cut_tree(other, 400, k) for k in range(1, 401))
    copied = np.concatenate([x[:90], x[:30], np.repeat(x[3:4], 40, 0)])[r.permutation(160)]
    assert cluster.cuts(copied, [1, 3, 90], linkage, direct=20) == cluster.cuts(copied, [1, 3, 90], linkage)
    assert [len(set(y)) for y in cluster.cuts(copied, [95, 160, 500], linkage, direct=20)] == [95, 160, 160]


def test_groups_of_any_size_have_trees(spark):
    x = np.random.default_rng(1).normal(size=(6000, 2)).round(2)
    rows = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)] + [(9000, None, 1)], "vec_id long, embedding array<double>, label int")
    got = cluster.agglomerative(rows, [2, 5], linkage="ward", group="label").groupBy("k").agg(F.count("*"), F.countDistinct("cluster_id"))
    assert sorted(map(tuple, got.collect())) == [(2, 6000, 2), (5, 6000, 5)]


def test_copies_of_edits_and_functions_meet_once(spark):
    """Copies pair up in the last joins alone; an id with several signatures gives a pair once."""
    functions = spark.createDataFrame([("c", i, "f(int)") for i in range(60)] + [("c", 99, "f("), ("c", 99, "int)"), ("c", 99, "int)")], "case_id string, function_id int, signature string")
    edits = spark.createDataFrame([("c", i, "### f( int )\nx") for i in range(50)] + [("c", 70, "### g()"), ("c", 7, "### int f(int)"), (None, 1, "### f(int)")], "case_id string, edit_id int, text string")
    pairs, left = methods.match_edits(functions, edits)
    assert sorted(map(tuple, pairs.collect())) == sorted(("c", f, e) for f in [*range(60), 99] for e in range(50)) and list(map(tuple, left.collect())) == [("c", 1)]
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lstrip().startswith("Project") and "Join" in plan.split("\n")[1]  # nothing gathers the pairs after the join


def test_batches_of_long_rows_are_bounded(spark):
    spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
    rows = read_table(spark, DATA, "documents").limit(1).select(F.explode(F.sequence(F.lit(1), F.lit(2000))).alias("i")).repartition(1).select(F.repeat(F.lit("x"), 20_000).alias("t"))
    largest = rows.mapInArrow(lambda batches: (b.from_pydict({"n": [len(b)]}) for b in batches), "n long").agg(F.max("n")).first()[0]
    assert largest * 20_000 <= 9 << 20


def test_sources_meet_their_patches_without_a_broadcast(spark):
    """Texts that compress well look small where they are exchanged; a table of them fills memory all the same."""
    body = lambda i: f"class C{i} {{\n int f(int a) {{\n  x();\n }}\n" + "// same\n" * 500 + "}"
    files = spark.createDataFrame([(f"p{i}", body(i)) for i in range(40)], "path string, source string").repartition(3)
    patches = [(i, f"p{i % 45}", "edit", [("f(int z)" if i % 2 else "gone()", "x();", f"y{i}();")]) for i in range(200)]
    kind = "id int, path string, kind string, blocks array<struct<signature:string,search:string,replace:string>>"
    got = normalize.normalize(spark.createDataFrame(patches, kind).repartition(3), files)
    rows = {r["id"]: (r["strategy"], "" if r["diff"] is None else r["diff"].split("\n")[-4]) for r in got.collect()}
    want = {i: (normalize.MANUAL, "") if i % 45 >= 40 else (normalize.METHOD if i % 2 else normalize.FILE, f"+y{i}();") for i in range(200)}
    assert rows == want and "BroadcastHashJoin" not in got._jdf.queryExecution().executedPlan().toString()


def test_first_rows_by_hash_sort_few_rows(spark):
    """A level's sample is that of sorting all rows, but only ranges of the hash that hold it reach the sort."""
    rows = spark.range(0, 30_000).select(F.col("id").alias("vec_id"), F.concat(F.lit("root/"), (F.col("id") % 2).cast("string")).alias("path")).unionByName(spark.range(40_000, 40_007).select(F.col("id").alias("vec_id"), F.lit("small").alias("path")))
    got = cluster._first_by_hash(rows, "vec_id", 100)
    want = [r["vec_id"] for p in ("root/0", "root/1", "small") for r in rows.where(F.col("path") == p).orderBy(F.xxhash64("vec_id"), "vec_id").limit(100).collect()]
    assert sorted(r["vec_id"] for r in got.collect()) == sorted(want) and len(want) == 207
    sorted_rows = got._jdf.queryExecution().optimizedPlan()
    while sorted_rows.nodeName() != "Window":
        sorted_rows = sorted_rows.children().head()
    assert spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, sorted_rows.children().head()).count() < 400


@pytest.mark.parametrize("query", ["chunks_halved", "diff_round_trip", "reverse_patch_apply"])
def test_a_row_passes_one_python_worker(spark, query):
    """Each Python step of a task holds a worker of its own, with its modules, vocabulary and batches."""
    plan = catalogue.queries()[query](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("EvalPython") == 1 and "Generate" not in plan and "Exchange" not in plan


def test_halving_counts_its_pieces(spark):
    import public_tokenizers

    ranks, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    texts = ["", "naïve 😀 text " * 30, "word " * 900, None, "a   b\n\n\n" * 50, "a   b\n\n\n" * 50]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(chunks.halved_counted("t", 20, ranks, pattern).alias("c"))
    pieces = rows.select(F.explode(F.arrays_zip("c.pieces", "c.tokens")).alias("p")).select(F.col("p.tokens").alias("n"), chunks.token_number("p.pieces", ranks, pattern).alias("again")).collect()
    assert len(pieces) > 100 and all(r["n"] == r["again"] <= 20 for r in pieces)
    assert [r["c"]["pieces"] and "".join(r["c"]["pieces"]) for r in rows.collect()] == texts
    assert [r["c"]["tokens"] for r in rows.collect()][3] is None


def test_pairs_of_copies_are_small_where_they_are_written(spark, tmp_path):
    """The pairs of one large class are dealt over tasks and take far less than a byte each; before, 0.7."""
    functions = spark.range(100).selectExpr("string(id div 10000) as case_id", "id * 7919 as function_id", "'f(int)' as signature")
    edits = spark.range(8000).selectExpr("string(id div 10000) as case_id", "id * 7919 as edit_id", "'### f(int)' as text")
    methods.match_edits(functions, edits)[0].write.parquet(f"{tmp_path}/pairs")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.distinct().count() == got.count() == 800_000
    files = list((tmp_path / "pairs").glob("*.parquet"))
    assert sum(f.stat().st_size for f in files) < 0.35 * 800_000 and len(files) > 1


def test_groups_and_runs_lose_no_pair(spark, monkeypatch):
    """Classes of several groups and runs, the last of them short, and null ids."""
    monkeypatch.setattr(methods, "GROUP", 20)
    monkeypatch.setattr(methods, "RUN", 3)
    ids = [None, *range(70)]
    functions = spark.createDataFrame([("c", i, "f(int)") for i in ids] + [("d", 1, "g()")], "case_id string, function_id int, signature string")
    edits = spark.createDataFrame([("c", i, "### f(int)") for i in ids] + [("d", None, "### g()")], "case_id string, edit_id int, text string")
    pairs, left = methods.match_edits(functions, edits)
    assert Counter(map(tuple, pairs.collect())) == Counter([("c", f, e) for f in ids for e in ids] + [("d", 1, None)])
