from __future__ import annotations

import numpy as np
import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from routelens.functions import patches as P
from routelens.functions import text as T
from routelens.functions import vectors as V
from routelens.operators import cluster, sample, search
from routelens.plans import catalogue
from routelens.sources import readers, sinks
from routelens.streaming import ingest


def blobs():
    r = np.random.default_rng(1)
    return np.concatenate([r.normal(0, 0.5, (20, 8)) + 10 * np.eye(8)[i] for i in range(3)])


@pytest.mark.parametrize("linkage", ["average", "single", "complete", "ward"])
def test_tree_finds_blobs(linkage):
    labels = cluster.cut_tree(cluster.merge_tree(blobs(), linkage), 60, 3)
    assert labels == [0] * 20 + [1] * 20 + [2] * 20


def test_cuts_at_the_ends():
    tree = cluster.merge_tree(blobs())
    assert cluster.cut_tree(tree, 60, 60) == list(range(60)) and set(cluster.cut_tree(tree, 60, 1)) == {0}


def test_kmeans_finds_blobs(spark):
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(blobs())], "vec_id long, embedding array<double>")
    for f in (cluster.kmeans, cluster.bisecting):
        got = {r.vec_id: r.cluster_id for r in f(df, 3, cosine=False).collect()}
        assert len({got[i] for i in range(20)}) == 1 and len(set(got.values())) == 3


def brute_search(rows, k=5):
    out = {}
    for q, a in rows:
        dist = [(round(float(((np.array(a) - b) ** 2).sum()), 9), i) for i, b in rows if len(a) == len(b)]
        out[q] = [i for _, i in sorted(dist)[:k]]
    return out


def test_batch_search_of_every_row(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = r.integers(-2, 3, (300, 4)).astype(float) + r.integers(0, 2, (300, 1)) * 0.25
    x[50:150] = x[50]
    rows = [(i, y.tolist()) for i, y in enumerate(x)] + [(400, [1.0, 2.0]), (401, [1.0, 2.5])]
    bad = [(500, None), (501, [float("nan")] * 4), (502, []), (7, rows[7][1])]
    monkeypatch.setattr(search, "BLOCK", 40)
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>")
    got = {}
    for g in search.batch_search(df).orderBy("query_id", "place").collect():
        got.setdefault(g.query_id, []).append(g.vec_id)
    assert got == brute_search(rows)
    assert search.batch_search(df.limit(0)).count() == 0


def test_batch_knn_all_answers_every_id(spark):
    rows = [(r.vec_id, [float(y) for y in r.embedding]) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    got = {}
    for g in catalogue.queries()["batch_knn_all"](spark, "/root/testdata/sf0.001").orderBy("query_id", "place").collect():
        got.setdefault(g.query_id, []).append(g.vec_id)
    assert got == brute_search(rows)


def test_selection_orders():
    x = blobs()
    assert len({i // 20 for i in sample.farthest_first_order(x, 3)}) == 3
    assert len({i // 20 for i in sample.greedy_dpp_order(x, 3)}) == 3
    same = np.ones((4, 3))
    assert sample.greedy_dpp_order(same, 3) == [0] and sample.farthest_first_order(same, 2) == [0, 1]


def test_vectors(spark):
    r = spark.range(1).select(F.array(F.lit(3.0), F.lit(4.0)).alias("a"), F.array(F.lit(0.0), F.lit(0.0)).alias("z")).select(V.norm(F.col("a")), V.cosine_distance(F.col("a"), F.col("a")), V.norm(V.l2_normalize(F.col("z")))).first()
    assert r[0] == 5 and abs(r[1]) < 1e-12 and r[2] == 0


def test_text(spark):
    sr = "x\n<<<<<<< SEARCH\na = 1\n=======\na = 2\n>>>>>>> REPLACE\n<<<<<<< SEARCH\nb\n=======\n>>>>>>> REPLACE"
    df = spark.createDataFrame([(sr, "```java\nint x;\n```", "p\r\nq\rr", "Failing tests: 2\n  - A::b\n  - C::d", "int foo = bar;", "--- a\n+++ b\n@@ -1,2 +1,1 @@\n-old\n-two\n+new")], "sr string, f string, n string, t string, c string, p string")
    r = df.select(T.search_replace_blocks(F.col("sr")), T.strip_code_fences(F.col("f")), T.normalize_newlines(F.col("n")), T.parse_test_output(F.col("t")), T.hash_identifiers("c"), T.reverse_patch("p"), T.detect_format(F.col("sr")), T.number_lines(F.col("n"), F.lit(1))).first()
    assert [tuple(b) for b in r[0]] == [("a = 1", "a = 2"), ("b", "")]
    assert r[1] == "int x;" and r[2] == "p\nq\nr" and r[3].failing == 2 and r[3].names == ["A::b", "C::d"]
    assert r[4].startswith("int ID_") and r[5] == "--- b\n+++ a\n@@ -1,1 +1,2 @@\n-new\n+old\n+two" and r[6] == "edit"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"slug":"P_1","value":0.5}\n\n{"slug":"P_2","value":"x"}\n{"value":1}\n')
    assert [tuple(r) for r in readers.read_scores(spark, str(tmp_path / "s.jsonl"), "edit").collect()] == [("P_1", "edit", 0.5)]
    (tmp_path / "a.jsonl").write_text('{"slug":"P_1","cluster_id":4,"view":"v"}\n{"item_id":"Q__2__v","cluster_id":"5"}\n{"slug":"x"}\n')
    a = readers.read_assignments(spark, str(tmp_path / "a.jsonl"))
    assert sorted((r.slug, r.cluster_id) for r in a.collect()) == [("P_1", 4), ("Q__2", 5)]
    d = tmp_path / "tree/Proj_1/3"
    d.mkdir(parents=True)
    (d / "result.json").write_text('{"task":"edit","ppl":"1.5"}')
    r = readers.read_result_tree(spark, str(tmp_path / "tree")).first()
    assert (r.slug, r.sample_idx, r.metric) == ("Proj_1", 3, 1.5)
    sinks.write_members(a, str(tmp_path / "m"))
    sinks.write_report([a, spark.range(1)], str(tmp_path / "r"))
    assert spark.read.csv(str(tmp_path / "r"), header=True).count() == 3


def test_patch_lines():
    a = "int f() {\n  x = 1;\n\n  y = 2;\n}\nend"
    b = "int f() {\n  x = 3;\n\n  y = 2;\n}\nend\nmore"
    d = P.diff_text(a, b, "src/A.java")
    assert P.apply_diff(a, d) == b and P.diff_text(a, a, "x") == "" and P.apply_diff("other", d) == "error"
    assert P.apply_diff("pad\n" + a, d) == "pad\n" + b
    assert P.locate(a, "x = 1;\n{\n y = 2;") == [(1, 3)] and P.locate("a\na\na", "a") == [(0, 0), (1, 1), (2, 2)] and P.locate(a, " ") == []
    assert P.signature_text("public static <T> Map<String, List<T>> get(final java.util.Map<K, V> m, int[] x, String... y) {") == "get(Map,int[],String[])"
    assert P.anonymize("Foo getBar(int baz) { return baz; }") == "CLASS_0 getMethod0(int VAR_0) { return VAR_0; }"
    assert P.split_rewrites("### f(int)\nint f;\n### g()\nint g;\n") == [("f(int)", "int f;"), ("g()", "int g;")] and P.split_rewrites(" ") == []


@given(st.lists(st.sampled_from(["a", "b", "", " c"]), max_size=14), st.lists(st.sampled_from(["a", "b", "", " c", "d"]), max_size=14))
def test_diff_round_trip(x, y):
    a, b = "\n".join(x), "\n".join(y)
    assert P.apply_diff(a, P.diff_text(a, b, "p")) == b


def test_patch_columns(spark):
    row = ('{"data":[{"embedding":[1,2]}]}', '{"choices":[{"message":{"logprobs":{"content":[{"token":"a","logprob":-1},{"token":"b","logprob":-3}]}}}]}', "a__b__v", "1-3, 5,x,2", "/w/src/main/java/A.java", "Failing tests: 0", "--- a/x\n+++ b/x\n@@ -1 +1 @@\n+n\n-o", None)
    df = spark.createDataFrame([row], "e string, l string, i string, n string, p string, t string, d string, z string")
    c = F.col
    r = df.select(P.embedding_of(c("e")), P.mean_nll(P.token_logprobs(c("l"))), P.slug_of(c("i")), P.slug_of(c("i"), "first"), P.number_ranges(c("n")), P.relative_path(c("p")), P.test_verdict(c("t")), P.hunk_order_ok(c("d")), P.patch_info(c("d")), P.test_verdict(c("z")), P.unified_diff("z", "d", "i"), P.slug_fold(c("z")), P.locate_block("d", F.lit("+n"))).first()
    assert list(r)[:8] == [[1.0, 2.0], 2.0, "a__b", "a", [1, 2, 3, 5], "src/main/java/A.java", "passed", False]
    assert tuple(r[8]) == ("x", 1, 1) and r[9] is None and r[10] is None and r[11] == "unknown" and tuple(r[12][0]) == (3, 3)


def test_merge_small(spark):
    x = [(0, [1.0, 0.0])] * 9 + [(1, [0.0, 1.0]), (2, [0.1, 1.0]), (3, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, c, v) for i, (c, v) in enumerate(x)], "vec_id long, label int, embedding array<double>")
    assert {tuple(r) for r in cluster.merge_small(df, 2, 0.1).collect()} == {(0, 0), (1, -1), (2, -1), (3, -2)}
    assert {tuple(r) for r in cluster.merge_small(df.where("label < 2"), 2, 0.1).collect()} == {(0, 0), (1, 1)}


@pytest.mark.parametrize("method", ["farthest_first", "kdpp"])
def test_rounds_pick_the_same(spark, method):
    r = np.random.default_rng(3)
    df = spark.createDataFrame([(i, i % 3, [float(y) for y in r.normal(size=6)]) for i in range(90)] + [(100, 7, [1.0] * 6), (101, 7, [1.0] * 6), (102, 7, None)], "vec_id long, label int, embedding array<double>")
    one = {tuple(x) for x in sample.representatives(df, 4, method).collect()}
    assert one == {tuple(x) for x in sample.representatives(df, 4, method, most=1).collect()} and {x[0] for x in one} == {0, 1, 2, 7}


def test_levels_find_blobs(spark):
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in enumerate(blobs())], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.path for r in cluster.hierarchical_kmeans(df, [3, 2], sample=30).collect()}
    tops = [{got[20 * b + i].split("/")[1] for i in range(20)} for b in range(3)]
    assert all(len(t) == 1 for t in tops) and len(set.union(*tops)) == 3 and all(p.count("/") == 2 for p in got.values()) and len(got) == 60


def test_more_sources_and_sinks(spark, tmp_path):
    np.save(tmp_path / "v.npy", np.arange(6.0).reshape(3, 2))
    assert [(r.row, list(r.embedding)) for r in readers.read_npy(spark, str(tmp_path)).orderBy("row").collect()] == [(0, [0, 1]), (1, [2, 3]), (2, [4, 5])]
    (tmp_path / "a.log").write_text("ok\nERROR x\nERROR y\n")
    assert tuple(readers.count_log_lines(spark, str(tmp_path / "a.log"), {"errors": "^ERROR", "good": "^ok"}).first()) == ("a.log", 2, 1)
    done = spark.createDataFrame([(1, True), (2, False)], "id long, ok boolean")
    work = spark.range(4)
    assert sorted(r.id for r in readers.unprocessed(work, done, "id").collect()) == [0, 3] and sorted(r.id for r in readers.unprocessed(work, done, "id", "ok").collect()) == [0, 2, 3]
    twice = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "c")], "id long, run int, x string")
    assert {tuple(r) for r in readers.latest_per_key(twice, "id", "run").collect()} == {(1, 2, "b"), (2, 1, "c")}
    items = spark.createDataFrame([("P__1__v", 3)], "item_id string, cluster_id int")
    for _ in range(2):
        sinks.append_records(items, str(tmp_path / "app"))
    assert spark.read.json(str(tmp_path / "app")).count() == 2
    sinks.write_assignments(items, str(tmp_path / "as"))
    assert readers.read_assignments(spark, str(tmp_path / "as")).first().slug == "P__1"


def test_stream_runs_to_the_end_and_goes_on(spark, tmp_path):
    src, out, at = (str(tmp_path / x) for x in ("in", "out", "at"))
    (tmp_path / "in").mkdir()
    line = '{{"slug":"a","strategy":"edit","value":{},"ts":"2024-01-{:02d}T00:00:00Z"}}\n'
    (tmp_path / "in/1.json").write_text(line.format(1, 1) + line.format(3, 1) + line.format(9, 9))
    ingest.run_available(ingest.daily_means(ingest.score_stream(spark, src)), out, at)
    (tmp_path / "in/2.json").write_text(line.format(5, 20))
    ingest.run_available(ingest.daily_means(ingest.score_stream(spark, src)), out, at)
    got = {(r.window.start.day, r.value, r.n) for r in spark.read.parquet(out).collect()}
    assert {(1, 2.0, 2), (9, 9.0, 1)} <= got


def test_grid_cells_by_hand(spark):
    """Votes and metrics of every cell again in Python, from the clusterings and samples that the grid's steps give."""
    from routelens.operators import grid

    r = np.random.default_rng(3)
    v = spark.createDataFrame([(i, r.normal(size=6).tolist(), int(i % 4)) for i in range(90)] + [(900, None, 1)], "vec_id long, embedding array<double>, label int")
    score = {i: (None if i % 7 == 0 else float(r.random()), None if i % 11 == 0 else float(r.random())) for i in range(80)}
    scores = spark.createDataFrame([(i, e, g) for i, (e, g) in score.items()], "slug long, e double, g double")
    settings = (["given", "kmeans", "hierarchical"], [4], ["farthest_first", "kdpp"], [1, 3], ["majority", "mean_score"])
    got = {tuple(x[c] for c in grid.CELL): x for x in grid.run_grid(v, scores, *settings).collect()}
    assigned = grid.clusterings(v.where("embedding is not null"), settings[0], settings[1])
    picked = grid.samples(v.where("embedding is not null"), assigned, settings[2], 3).collect()
    assigned = assigned.collect()
    assert len(got) == 3 * 2 * 2 * 2 and len({x["cell_key"] for x in got.values()}) == 24
    mean = lambda xs: sum(xs) / len(xs) if xs else None
    for (algorithm, k, sampler, reps, voting), cell in got.items():
        mine = [x for x in assigned if (x["algorithm"], x["k"]) == (algorithm, k)]
        chosen = {}
        for c in {x["cluster_id"] for x in mine}:
            votes = [score.get(x["id"], (None, None)) for x in picked if (x["algorithm"], x["k"], x["sampler"], x["cluster_id"]) == (algorithm, k, sampler, c) and x["rank"] <= reps]
            assert 1 <= len(votes) <= reps
            edit, gen = sum(e is not None and (g is None or e <= g) for e, g in votes), sum(g is not None and (e is None or g < e) for e, g in votes)
            me, mg = mean([e for e, _ in votes if e is not None]), mean([g for _, g in votes if g is not None])
            by_mean = "edit" if me is not None and (mg is None or me <= mg) or mg is None else "gen"
            chosen[c] = by_mean if voting == "mean_score" or edit == gen else "edit" if edit > gen else "gen"
        items = [(chosen[x["cluster_id"]], *score[x["id"]]) for x in mine if x["id"] in score and None not in score[x["id"]]]
        wins = sum(c == ("edit" if e <= g else "gen") for c, e, g in items)
        assert (cell["clusters"], cell["total"], cell["wins"]) == (len(chosen), len(items), wins)
        assert abs(cell["mean_score"] - mean([e if c == "edit" else g for c, e, g in items])) < 1e-9 and abs(cell["win_rate"] - wins / len(items)) < 1e-9
    cells = grid.run_grid(v, scores, ["given"], [4], ["kdpp"], [1], ["majority"])
    assert grid.remaining_cells(cells, cells.limit(0)).count() == 1 and grid.remaining_cells(cells, cells).count() == 0
