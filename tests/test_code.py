"""Java methods, edits, diffs, normalisation, storage, layout and chunks against plain Python rules and edge cases."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from routelens.functions import chunks, java
from routelens.functions import diffs as D
from routelens.functions import patches as P
from routelens.functions import responses as R
from routelens.operators import layout, methods, normalize, prompts, ranks
from routelens.sources import evaluation

SOURCE = '''package a.b;
/* class X { void no() {} } */
@Deprecated
public class Foo<T extends Comparable<T>> extends Bar {
    private static final Runnable R = () -> { int x = f(3); };
    int[] a = {1, 2}, b = g();
    static { init(); }
    String s = "void bad() { }";  // void c() {
    public Foo(final int x, java.util.Map<String, List<T>> m) throws E {
        this(x, new Thread() { @Override public void run() { if (x > 0) { go(); } } });
        for (int i = 0; i < 3; i++) { foo(); }
    }
    @Test(timeout = 10, v = {1, 2})
    public <K, V> Map<K, V> sort(List<K> items, V... rest)
    {
        char c = '}'; String t = """
           { } " x """;
        class Local { int inner(int q[]) { return 1; } }
        return null;
    }
    abstract void none(int[][] z);
    enum E { A(1) { int k() { return 2; } }, B(f(2)), C; E(int... v) { } int k() { return 1; } }
    interface I { int m(Object o); default void d() { } }
    record P(int x, int y) { P { check(); } int sum() { return x + y; } }
}
'''
METHODS = [
    ("Foo(int,Map)", "Foo(int, Map<String,List<T>>)", 9, 12), ("run()", "run()", 10, 10), ("sort(List,V[])", "sort(List<K>, V[])", 13, 20), ("inner(int[])", "inner(int[])", 18, 18), ("none(int[][])", "none(int[][])", 21, 21),
    ("k()", "k()", 22, 22), ("E(int[])", "E(int[])", 22, 22), ("k()", "k()", 22, 22), ("m(Object)", "m(Object)", 23, 23), ("d()", "d()", 23, 23), ("sum()", "sum()", 24, 24),
]


def test_methods_of_a_class():
    found = java.methods(SOURCE)
    assert [(m["key"], m["signature"], m["first_line"], m["last_line"]) for m in found] == METHODS
    for m in found:
        assert SOURCE[m["begin"] : m["end"]].rstrip()[-1] in "};" and m["name"] in SOURCE[m["begin"] : m["end"]]


@pytest.mark.parametrize("text,keys", [("public int f(int a) { return g(a); }", ["f(int)"]), ("Foo(int a) { }", ["Foo(int)"]), ("int x = f(3); foo(bar);", []), ("{{{", []), ("}}}", []), ("", []), ("void f() { /* } ", []), ('void f() { "unclosed\n }', ["f()"]), ("class A { A(B this, int x) {} }", ["A(int)"])])
def test_methods_of_fragments(text, keys):
    assert [m["key"] for m in java.methods(text)] == keys


def test_long_and_deep_sources_are_linear():
    deep = "class A { void f() { " + "{ " * 20_000 + "} " * 20_000 + "} }"
    assert [m["key"] for m in java.methods(deep)] == ["f()"]
    wide = "class A {" + "".join(f"void f{i}(int a) {{ g(); }}\n" for i in range(5000)) + "}"
    assert len(java.methods(wide)) == 5000


def test_locate_methods(spark):
    files = spark.createDataFrame([("p", SOURCE), ("q", None), ("r", "")], "path string, source string")
    wanted = [(1, "p", "public Map sort(List<String> x, V... y)"), (2, "p", "sort(List)"), (3, "gone", "k()"), (4, "p", "private int k()"), (5, "p", "no parentheses"), (6, "p", None), (None, "p", "d()"), (7, "q", "k()")]
    got = {r["id"]: (r["found"], r["first_line"], r["last_line"]) for r in methods.locate_methods(files, spark.createDataFrame(wanted, "id int, path string, signature string")).collect()}
    none = (False, None, None)
    assert got == {1: (True, 13, 20), 2: none, 3: none, 4: (True, 22, 22), 5: none, 6: none, None: (True, 23, 23), 7: none}
    assert methods.locate_methods(files.limit(0), spark.createDataFrame(wanted, "id int, path string, signature string")).where("found").count() == 0


def test_method_range_by_text(spark):
    rows = [("a\n  int f(int b) {\nx\n}", "int f(int b)", 3), ("a\n  int f(int b) {\nx\n}", "  int f(int b  \nmore", 2), ("a", "b", 1), (None, "b", 1), ("x\ny", "x", 1)]
    got = spark.createDataFrame(rows, "s string, h string, n int").select(java.method_range(F.col("s"), F.col("h"), F.col("n")).alias("r")).collect()
    assert [r["r"] and tuple(r["r"]) for r in got] == [(1, 4), (1, 3), None, None, (0, 1)]


def test_match_edits_is_the_theta_join(spark):
    r = random.Random(1)
    word = lambda: "".join(r.choices("ab (", k=r.randint(0, 12)))
    functions = [(r.choice("xyz"), i, word()) for i in range(120)] + [("x", 900, None), (None, 901, "a"), ("x", 902, "")]
    edits = [(r.choice("xyz"), i, r.choice(["###", "### "]) + word() + "\nrest") for i in range(120)] + [("x", 900, None), ("y", 901, "no head"), ("z", 902, "###\n")]
    bare = lambda s: "".join(s.split())
    head = lambda t: m[1].strip() if t and (m := re.match(r"###([^\n]+)", t)) else None
    want = {(c, f, e) for c, f, s in functions for d, e, t in edits if c == d and c and s is not None and head(t) and bare(s) in bare(head(t))}
    pairs, left = methods.match_edits(spark.createDataFrame(functions, "case_id string, function_id int, signature string"), spark.createDataFrame(edits, "case_id string, edit_id int, text string"))
    assert {tuple(p) for p in pairs.collect()} == want and len(want) > 50
    lost = [c for c, e, _ in edits if not any((c, e) == (p[0], p[2]) for p in want)]
    assert {tuple(x) for x in left.collect()} == {(c, lost.count(c)) for c in lost}
    assert "NestedLoop" not in pairs._jdf.queryExecution().toString() and "Cartesian" not in pairs._jdf.queryExecution().toString()


def test_source_file_of(spark):
    files = [("r", "b/A.java", "class A { int f(int a) { return 1; } }"), ("r", "a/B.java", "class B { int f(int a) {\n  return 2;\n} int g() { return 3; } }"), ("s", "x", "class C { int f(int a) { return 1; } }")]
    wanted = [(1, "r", "f(int)", "return 2;"), (2, "r", "int f(int z)", "nowhere"), (3, "r", "g()", None), (4, "r", "h()", "x"), (5, "s", "f(int)", None), (6, "r", "f(int)", None)]
    got = methods.source_file_of(spark.createDataFrame(files, "repo string, path string, source string"), spark.createDataFrame(wanted, "id int, repo string, signature string, block string"))
    assert sorted(map(tuple, got.collect())) == [(1, "a/B.java", 2, "block"), (2, "a/B.java", 2, "first"), (3, "a/B.java", 1, "only"), (4, None, 0, None), (5, "x", 1, "only"), (6, "a/B.java", 2, "first")]


BODY = "class A {\n    int f(int a) {\n        x();\n        y();\n    }\n    int g() {\n        y();\n        z();\n    }\n}\n"


def normalized(spark, patches):
    kind = "id int, path string, kind string, blocks array<struct<signature:string,search:string,replace:string>>"
    files = spark.createDataFrame([("repo/src/A.java", BODY)], "path string, source string")
    got = normalize.normalize(spark.createDataFrame(patches, kind), files)
    rows = got.withColumn("after", P.apply_unified_diff(F.lit(BODY), "diff")).collect()
    return {r["id"]: (r["strategy"], r["located"], [tuple(t) for t in r["tried"]], r["after"]) for r in rows}, got


def test_normalize_falls_back_and_keeps_failures(spark):
    path, m, f = "repo/src/A.java", normalize.METHOD, normalize.FILE
    got, table = normalized(spark, [
        (1, path, "edit", [("g()", "y();", "        w();")]), (2, path, "edit", [("h()", "  x();\n  y();", "w();")]), (3, path, "edit", [("h()", "y();", "w();")]), (4, path, "edit", [("f(int)", "x();", "1"), ("g()", "z();", "2")]),
        (5, path, "rewrite", [("f(int)", None, "int f(int b) {\n    q();\n}"), ("no()", None, "x")]), (6, "gone", "edit", [("g()", "y();", "w();")]), (7, path, "rewrite", [("no()", None, "x")]), (8, path, "other", []), (9, path, "edit", []), (10, path, "edit", None),
        (11, path, "edit", [("f(int)", "x();\ny();", "1"), ("f(int)", "y();", "2")]), (12, path, "edit", [("f(int)", "nothing", "1")]), (13, path, "edit", [("g()", "z();", None)]), (14, None, "edit", [("g()", "z();", "a"), (None, None, None)]), (15, path, None, [("g()", "z();", "a")]),
    ])
    assert got[1] == (m, 1, [], BODY.replace("        y();\n        z();", "        w();\n        z();"))
    assert got[2] == (f, 1, [(m, 0, "method_not_found")], BODY.replace("        x();\n        y();\n", "w();\n"))
    assert got[3] == (normalize.MANUAL, 0, [(m, 0, "method_not_found"), (f, 0, "exact_ambiguous")], None)
    assert got[4] == (m, 2, [], BODY.replace("        x();", "1").replace("        z();", "2"))
    assert got[5] == (m, 1, [], BODY.replace("    int f(int a) {\n        x();\n        y();\n    }", "    int f(int b) {\n        q();\n    }"))
    assert got[6] == (normalize.MANUAL, 0, [(m, 0, "no_file"), (f, 0, "no_file")], None)
    assert got[7][:3] == (m, 0, []) and got[9][:3] == got[10][:3] == (m, 0, []) and got[8][0] == normalize.MANUAL
    assert got[11] == (normalize.MANUAL, 0, [(m, 0 + 1, "overlapping"), (f, 1, "exact_ambiguous")], None)
    assert got[12][2] == [(m, 0, "not_found"), (f, 0, "not_found")] and got[13][3] == BODY.replace("        z();", "")
    assert got[14][0] == got[15][0] == normalize.MANUAL and got[14][2][0] == (m, 0, "no_file")
    assert normalize.failure_report(table).where("id = 3").first()["report"] == "Patch 3 needs a manual review\n1. method_scoped_exact: block 1, method_not_found\n2. file_scoped_exact: block 1, exact_ambiguous"


def column(spark, f, rows):
    return [r[0] for r in spark.createDataFrame([tuple(x) if isinstance(x, tuple) else (x,) for x in rows], ", ".join(f"c{i} string" for i in range(len(rows[0]) if isinstance(rows[0], tuple) else 1))).select(f).collect()]


def test_diff_errors(spark):
    head = "--- a/x\n+++ b/x\n"
    rows = [head + "@@ -1,1 +1,1 @@\n-a\n+b", head + "@@ -1 +1 @@\n-a\n+b\n\\ No newline", None, " \n", "@@ -1 +1 @@", "--- a\n@@ -1 +1 @@", head, "+++ b\n--- a\n@@ -1 +1 @@", head + "@@ -x +1 @@", head + "@@ -0,0 +1,2 @@", head + "@@ -1 +1 @@\nodd", head + "@@ -1 +1 @@\n a\n@@ -3,1 +0,1 @@"]
    assert column(spark, D.diff_error(F.col("c0")), rows) == [None, None, "empty", "empty", "from", "to", "hunk", "order", "header: @@ -x +1 @@", "number: @@ -0,0 +1,2 @@", "prefix: odd", "number: @@ -3,1 +0,1 @@"]


def test_hunk_counts(spark):
    rows = ["@@ -1,2 +1,2 @@\n a\n-b\n+c", "@@ -1,2 +1,2 @@\n a\n-b", "@@ -1 +1 @@\n-a\n+b\n", "@@ -1,3 +1,2 @@\n a\n\n-b", "@@ -1 +1 @@\n-a\n+b\n\\ No newline\n@@ -9,5 +9,5 @@\n x", "nothing", "@@ bad @@\n a"]
    assert column(spark, D.hunk_count_errors(F.col("c0")), rows) == [[], [0], [], [], [1], [], []]


def test_reversals_and_order(spark):
    a = "--- a\n+++ b\n@@ -1,2 +1,2 @@\n x\n-old\n+new\n@@ -9 +9 @@\n-p\ndiff --git\n+q"
    back = "--- b\n+++ a\n@@ -1,2 +1,2 @@\n x\n-new\n+old\n@@ -9 +9 @@\n+p"
    rows = [(a, back), (a, back.replace("+p", "+P")), (a, back.replace(" x", " y")), (a, back.replace("-new", "-nil")), (a, "none"), ("none", "none")]
    assert column(spark, D.reversal_error(F.col("c0"), F.col("c1")), rows) == [None, "additions: 1", "context: 0", "deletions: 0", "hunks", None]
    assert column(spark, D.misplaced_deletions(F.col("c0")), [a, "@@ @@\n+a\n+b\n-c\n x\n+d\n-e", "+a\n-b", "@@ @@\n+a\n--- b\n-c"]) == [0, 2, 0, 0]


def joined(code):
    lines, out, i = code.split("\n"), [], 0
    indent = lambda x: len(x) - len(x.lstrip())
    while i < len(lines):
        x = lines[i].rstrip()
        if i + 1 < len(lines) and len(x) > 75 and x[-1] not in ";,{})]:" and lines[i + 1].strip() and lines[i + 1].strip()[0] != "{" and indent(lines[i + 1]) <= indent(lines[i]):
            out.append(x + lines[i + 1].lstrip())
            i += 1
        else:
            out.append(lines[i])
        i += 1
    return "\n".join(out)


def test_cut_lines(spark):
    r = random.Random(3)
    texts = ["\n".join(" " * r.randint(0, 4) + "x" * r.choice([0, 3, 74, 75, 76, 80]) + r.choice(["", ";", " ", "{"]) for _ in range(r.randint(1, 12))) for _ in range(200)] + ["", "\n", "x" * 80, "x" * 80 + "\n" + "y" * 80 + "\nz"]
    assert column(spark, D.join_cut_lines(F.col("c0")), texts) == [joined(t) for t in texts]
    assert column(spark, D.join_cut_lines(F.col("c0")), ["a", None]) == ["a", None]


def test_indent_edits_and_checks(spark):
    rows = [("    a", "b\n  c\n\n"), ("a", "    b\n  c\n    d"), ("", "  x"), ("\n  a", "\n b"), ("  a", "  b")]
    assert column(spark, D.adjust_indent(F.col("c0"), F.col("c1")), rows) == ["    b\n      c\n\n", "b\n  c\nd", "x", "\n  b", "  b"]
    edit = lambda a, b: F.struct(F.lit(a).alias("search"), F.lit(b).alias("replace"))
    assert column(spark, D.apply_in_order(F.col("c0"), F.array(edit("a", "b"), edit("b", "e"), edit("c", "d"))), ["ac", "a", "x"]) == ["ed", "error", "error"]
    assert column(spark, D.apply_all(F.array("c0", F.lit("b")), F.array(edit("a", "x"), edit("b", "y"))), ["a", "c"]) == [["x", "y"], []]
    assert column(spark, D.search_replace_error(F.col("c0"), F.col("c1"), F.col("c2")), [("s", "a", "b"), ("", "a", "b"), (None, "a", "b"), ("s", "", "b"), ("s", "a", None), ("s", " a\n", "a")]) == [None, "signature", "signature", "search", "replace", "identical"]
    assert column(spark, D.rewrite_error(F.col("c0"), F.col("c1")), [("s", "{}"), (None, "{}"), ("s", ""), ("s", "{")]) == [None, "signature", "code", "braces"]
    asked = "```c\n```\n### Buggy functions\n```java\nx\n```\n```java\n"
    assert [r and tuple(r) for r in column(spark, D.block_check(F.col("c0"), F.col("c1")), [(asked, "<<<<<<< SEARCH\n<<<<<<<\tSEARCH"), (asked, "x"), ("none", "x"), (asked, None)])] == [(2, 2, True), (2, 0, False), None, None]


def test_chunks_halved(spark):
    import public_tokenizers as T

    ranks, r = T.path("byte_bpe_50k.tiktoken"), random.Random(4)
    texts = ["", "a", "😀" * 40, "naïve 😀 text " * 30, "".join(r.choices("abc é😀\n中", k=500)), "word " * 3000, None]
    for limit in (1, 5, 64):
        frame = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chunks.halved("t", limit, ranks, T.PATTERN).alias("p"))
        for row in frame.collect():
            assert row["p"] == row["t"] if row["t"] is None else "".join(row["p"]) == row["t"]
        piece = frame.select(F.explode("p").alias("p")).select("p", chunks.token_number("p", ranks, T.PATTERN).alias("n")).collect()
        assert all(x["n"] <= limit or len(x["p"]) == 1 for x in piece)


def test_tree_layout(spark):
    rows = [("root", None), ("a", "root"), ("b", "root"), ("a1", "a"), ("a2", "a"), ("a2x", "a2"), ("a2y", "a2"), ("lone", "unknown"), ("c1", "c2"), ("c2", "c1"), (None, "a"), ("b", "root")]
    got = {r["node"]: (r["depth"], r["x"]) for r in layout.tree_layout(spark.createDataFrame(rows, "node string, parent string")).collect()}
    # leaves by name: a1 0, a2x 1, a2y 2, b 3, lone 4
    assert got == {"a1": (2, 0.0), "a2x": (3, 1.0), "a2y": (3, 2.0), "b": (1, 3.0), "lone": (0, 4.0), "a2": (2, 1.5), "a": (1, 0.75), "root": (0, 1.875)}
    assert layout.tree_layout(spark.createDataFrame([], "node string, parent string")).count() == 0


def test_evaluation_store(spark, tmp_path):
    store = evaluation.EvaluationStore(spark, f"{tmp_path}/e")
    assert tuple(store.summary().first()) == (0, 0) and store.batch_result().first()["share"] == 0.0
    results = spark.createDataFrame([("b1", 2, 1, "edit", ["x"], 1.5), ("b2", 3, None, "rewrite", ["x", "y"], 2.0), (None, 1, 1, "edit", [], 0.0)], "bug string, total_attempts int, successful_attempt int, modeling_type string, failure_reasons array<string>, seconds double")
    patches = spark.createDataFrame([("b1", 1, "d1", 7), ("b1", 1, "d0", 8), ("b1", 2, "d2", 9), ("b1", None, "no", 1)], "bug string, attempt int, diff string, version int")
    for _ in range(2):  # as after a lost driver
        store.save_results(results)
        store.save_patches(patches)
    assert tuple(store.summary().first()) == (2, 2) and store.patch("b1", 1).first()["diff"] == "d0"
    store.save_results(results.where("bug = 'b2'").withColumn("successful_attempt", F.lit(3)))
    assert store.result("b2").first()["successful_attempt"] == 3 and store.results().count() == 2
    batch = store.batch_result().first()
    assert (batch["bugs"], batch["fixed"], batch["edit_fixed"], batch["rewrite_fixed"], batch["attempts"], batch["seconds"], batch["tests"]) == (2, 2, 1, 1, 5, 3.5, 0)
    assert sorted(map(tuple, evaluation.reason_counts(store.results()).collect())) == [("x", 2), ("y", 1)]
    store.clear()
    assert tuple(store.summary().first()) == (0, 0)


def test_long_patches_are_linear(spark):
    """20,000 lines in 5,000 hunks: what is computed a row isn't computed for each line or hunk again."""
    patch = "--- a\n+++ b\n" + "\n".join("@@ -1,2 +1,2 @@\n x\n-a\n+b" for _ in range(5000))
    begun = time.time()
    assert column(spark, F.concat_ws("/", D.diff_error(F.col("c0")), F.size(D.hunk_count_errors(F.col("c0"))), D.misplaced_deletions(F.col("c0")), D.reversal_error(F.col("c0"), F.col("c0"))), [patch]) == ["0/0/additions: 0"]
    code = "\n".join("x" * 80 for _ in range(20_000))
    assert column(spark, F.length(D.join_cut_lines(F.col("c0"))), [code]) == [80 * 20_000 + 9_999]
    assert time.time() - begun < 60


def test_answers(spark):
    edit = "### int f(int a)\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\ntext\n<<<<<<< SEARCH\nc\n=======\nc\n>>>>>>> REPLACE\n"
    fenced = "intro ### not a head\n```java\n### g()\n<<<<<<< SEARCH\na\n=======\nb\n>>>>>>> REPLACE\n```\n"
    query = "### Buggy functions\n```java\npublic  static\n int k(int a,\n  int b) { }\n```"
    rows = [(edit, query, None), (fenced, query, "edit"), ("```java\nprivate int m(int z) { }\n```\n```\nx\n```", query, "rewrite"), ("no fence {}", "none", "rewrite"), (None, query, None), (edit, query, "odd"), ("", query, "rewrite"), ("### h(int)\n```java\nvoid h(int q) { }\n```", None, None)]
    frame = spark.createDataFrame(rows, "a string, q string, k string").select(R.parse_answer(F.col("a"), F.col("q"), F.col("k")).alias("x"))
    got = [(x["kind"], x["ok"], x["error"], [tuple(e) for e in x["edits"]], [(r["signature"], r["error"]) for r in x["rewrites"]]) for (x,) in frame.collect()]
    assert got[0] == ("edit", True, None, [("int f(int a)", "a", "b", None), ("", "c", "c", "signature")], [])
    assert got[1] == ("edit", True, None, [("g()", "a", "b", None)], [])
    assert got[2] == ("rewrite", True, None, [], [("private int m(int z)", None), ("public static int k(int a, int b)", "braces")])
    assert got[3] == ("rewrite", True, None, [], [("", "signature")])
    assert got[4] == (None, False, "no answer", [], []) and got[5] == ("odd", False, "unknown kind: odd", [], []) and got[6] == ("rewrite", True, None, [], [])
    assert got[7] == ("rewrite", True, None, [], [("h(int)", None)])


def test_prompts(spark):
    kind = "slug string, comment string, buggy_code string, path string, start_line int, end_line int, method_name string, method_sig string"
    functions = [("B_1", " doc ", "x();\ny();", "/w/B_1_buggy/src/A.java", 7, 8, " f ", "f()"), ("B_1", None, "z();", "/w/B_1_buggy/src/A.java", 3, 3, "g", " g()"), ("B_1", "", "z();", "/elsewhere", 9, 9, "g", "g()"), ("B_2", None, None, None, None, None, None, None), (None, "a", "b", "c", 1, 1, "d", "e")]
    messages = spark.createDataFrame([("B_1", "E1", None), ("B_1", "E0", "t"), ("B_9", "x", "y")], "slug string, exception_info string, test_method string")
    got = {x["slug"]: x for x in prompts.bug_info(spark.createDataFrame(functions, kind), messages, numbered=True).withColumn("q", prompts.build_query("no_comment", "{BUGGY_COMMENT}|{ERROR_MESSAGE}|{FAILED_TEST}")).collect()}
    one = got["B_1"]
    assert set(got) == {"B_1", "B_2"} and one["func_num"] == 3 and one["method_names"] == ["g", "f"] and one["method_signatures"] == ["g()", "f()"]
    assert one["buggy_comment"] == "   This function has no comment.\n   doc\n" and one["error_message"] == "E0\nE1" and one["failed_test"] == "t"
    assert one["buggy_code"] == "/elsewhere\n```java\nz(); // Line 9\n```\n/src/A.java\n```java\nz(); // Line 3\n```\n/src/A.java\n```java\nx(); // Line 7\ny(); // Line 8\n```\n"
    assert [tuple(x) for x in one["locations"]] == [("g()", "/elsewhere", 9, 9), ("g()", "/src/A.java", 3, 3), ("f()", "/src/A.java", 7, 8)]
    assert one["q"] == "{BUGGY_COMMENT}|E0\nE1|t" and got["B_2"]["q"] == "{BUGGY_COMMENT}|This function has no exception info.|This function has no failed test."
    with pytest.raises(ValueError):
        prompts.build_query("other", "")


def test_places_in_groups_of_any_size(spark):
    r = random.Random(6)
    rows = [(r.choice([1, 1, 1, 2, None]), r.choice([None, r.randint(0, 40), 7]), i) for i in range(3000)]
    got = {x["i"]: x["place"] for x in ranks.placed(spark.createDataFrame(rows, "g int, v int, i int").repartition(5), ["g"], ["v", "i"]).collect()}
    want = {}
    for g in {x[0] for x in rows}:
        for place, x in enumerate(sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2])), 1):
            want[x[2]] = place
    assert got == want
    assert ranks.placed(spark.createDataFrame([], "g int, v int"), ["g"], ["v"]).count() == 0
