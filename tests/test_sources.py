"""Attempt folders and the vector store."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import functions as F

from routelens.operators.store import VectorStore
from routelens.sources import attempts


def test_attempt_folders(spark, tmp_path):
    for slug, n, files in [("Lang_1", "1", attempts.REQUIRED), ("Lang_1", "2", attempts.REQUIRED[:2]), ("Math_7", "10", attempts.REQUIRED), ("Math_8", "x", attempts.REQUIRED), ("notes", "1", attempts.REQUIRED)]:
        (tmp_path / slug / n).mkdir(parents=True)
        for f in files:
            (tmp_path / slug / n / f).write_text(json.dumps({"reward": slug == "Lang_1"}) if f.endswith("json") else f"{slug} {n}\n{f}")
    files = attempts.list_files(spark, str(tmp_path))
    assert {(x.slug, x.attempt, x.complete, tuple(x.missing)) for x in attempts.list_attempts(files).collect()} == {("Lang_1", 1, True, ()), ("Lang_1", 2, False, ("result.json",)), ("Math_7", 10, True, ())}
    assert {(x.slug, x.attempts) for x in attempts.list_bugs(files).collect()} == {("Lang_1", 1), ("Math_7", 1)} and attempts.is_valid(files)
    assert not attempts.is_valid(files.where("slug = 'none'"))
    got = {(x.slug, x.attempt): x for x in attempts.read_attempts(spark, str(tmp_path)).collect()}
    assert set(got) == {("Lang_1", 1), ("Math_7", 10)} and got["Math_7", 10].output == "Math_7 10\nmodel_output.txt"
    assert got["Lang_1", 1].reward and not got["Math_7", 10].reward


def test_attempts_of_any_name_and_reward(spark, tmp_path):
    rewards = {"My Chart_2": '{"reward": 1.0}', "a%20b_3": '{"reward": "true"}', "é_4": '{"reward": 1}', "x_5": '{"reward": 0}', "y_6": "broken", "z_7": "{}", "w_8": '{"reward": null}'}
    for slug, text in rewards.items():
        (tmp_path / slug / "1").mkdir(parents=True)
        for f in (*attempts.REQUIRED, "other.bin"):
            (tmp_path / slug / "1" / f).write_text(text if f.endswith("json") else f"{slug} {f}")
    got = {x.slug: x for x in attempts.read_attempts(spark, str(tmp_path)).collect()}
    assert {k: v.reward for k, v in got.items()} == {"My Chart_2": True, "a%20b_3": True, "é_4": True, "x_5": False, "y_6": None, "z_7": False, "w_8": False}
    assert all(v.output == f"{k} model_output.txt" and v.query == f"{k} query.txt" and v.result == rewards[k] for k, v in got.items())


def test_vector_store(spark, tmp_path):
    r = np.random.default_rng(1)
    centres = np.zeros((3, 32))
    centres[0, :2], centres[1, :2], centres[2, 2:4] = 10, -10, 10
    x = np.concatenate([c + 2 * r.standard_normal((20, 32)) for c in centres])
    rows = [(f"v{i:02d}", f"f{i // 20}", v.tolist(), {"place": str(i)}) for i, v in enumerate(x)]
    kind = "id string, folder string, embedding array<double>, metadata map<string,string>"
    store = VectorStore(spark, f"{tmp_path}/store")
    assert store.vectors().count() == 0 and store.similar([1.0], 3).count() == 0
    store.add(spark.createDataFrame([*rows, ("bad", "f0", [float("nan")] * 32, {}), ("none", "f0", None, {})], kind))
    store.add(spark.createDataFrame([("v00", "moved", x[1].tolist(), {})], kind))
    assert store.vectors().count() == 60 and store.get(["v00"]).first().folder == "moved" and store.get([]).count() == 0
    x[0] = x[1]
    for metric, dist in (("cosine", 1 - x @ x[5] / np.linalg.norm(x, axis=1) / np.linalg.norm(x[5])), ("l2", ((x - x[5]) ** 2).sum(1)), ("ip", -x @ x[5])):
        got = store.similar(x[5].tolist(), 7, metric).collect()
        want = np.lexsort((np.arange(60), dist.round(9)))[:7]
        assert [y.id for y in got] == [f"v{i:02d}" for i in want] and np.allclose([y.dist for y in got], dist[want])
    near = store.similar_to("v05", 19).collect()
    assert len(near) == 19 and all(int(y.id[1:]) < 20 and y.id != "v05" for y in near) and store.similar_to("gone").count() == 0
    again = store.rebuild(f"{tmp_path}/again")
    assert sorted(map(str, again.vectors().collect())) == sorted(map(str, store.vectors().collect())) and again.table.rows().count() == 60
    assert {(y.folder, y.vectors, y.dims) for y in again.statistics().collect()} == {("moved", 1, 32), ("f0", 19, 32), ("f1", 20, 32), ("f2", 20, 32)}


def test_hierarchy(spark, tmp_path):
    from routelens.sources import hierarchy

    one = lambda parent, size, ids: {"parent": parent, "cluster_id": 0, "size": size, "center": [1.0, 2.0], "project_distribution": {"Lang": 1}, "vectors": [{"id": i, "folder": f, "file": None, "tokens": 3} for i, f in ids]}
    text = {"total_vectors": 3, "dimension": 2, "hierarchy": {"level_0": {"c0": one(None, 3, [("a", "Lang_1"), ("b", None), ("c", "Math_2")])}, "level_10": {"c1": one("c0", 2, [("a", "Lang_1"), ("b", None)]), "gone": None}, "level_x": {"c": one(None, 1, [])}, "other": {}}}
    (tmp_path / "r.json").write_text(json.dumps(text, indent=1))
    (tmp_path / "broken.json").write_text("{")
    held = hierarchy.read_hierarchy(spark, str(tmp_path)).cache()
    assert hierarchy.available_levels(held) == [0, 10] and hierarchy.resolve_level(held) == 10 and hierarchy.resolve_level(held, 0) == 0
    for level, rows in ((5, held), (None, held.limit(0))):
        try:
            hierarchy.resolve_level(rows, level)
        except ValueError:
            continue
        raise AssertionError
    assert [tuple(x) for x in hierarchy.level_clusters(held, 10).collect()] == [("c1", [1.0, 2.0], 2)]
    assert sorted(map(tuple, hierarchy.members(held, 10).select("id", "cluster").collect())) == [("a", "c1"), ("b", "c1")]
    assert {tuple(x) for x in hierarchy.project_counts(held).where("level = 0").collect()} == {(0, "c0", "Lang", 1), (0, "c0", "unknown", 1), (0, "c0", "Math", 1)}
    assert {x["line"] for x in hierarchy.tree_lines(held.withColumn("level", F.when(F.col("level") == 10, 1).otherwise(0))).collect()} == {"c0: 3", "  c1: 2, 66.7 % of c0"}


def test_metadata_summaries_and_markdown(spark, tmp_path):
    from routelens.sources import sinks

    sinks.write_metadata(spark.createDataFrame([(1, 0), (2, 0), (3, 4)], "id int, cluster_id int"), f"{tmp_path}/m", "kmeans", metric="cosine", seed=42)
    assert json.loads(spark.read.text(f"{tmp_path}/m").first()[0]) == {"algorithm": "kmeans", "n_clusters": 2, "n_samples": 3, "metric": "cosine", "seed": 42}
    got = sinks.representative_summary(spark.createDataFrame([(0, 2, "b"), (0, 1, "c"), (5, 1, "a")], "cluster_id int, rank int, id string"))
    assert sorted(map(tuple, got.collect())) == [(0, 2, ["c", "b"]), (5, 1, ["a"])]
    table = spark.createDataFrame([(1, "a|b"), (2, None)], "n int, s string").orderBy("n")
    sinks.write_markdown(table, f"{tmp_path}/t", "Title")
    assert "\n".join(x[0] for x in spark.read.text(f"{tmp_path}/t").collect()) == "# Title\n\n| n | s |\n| - | - |\n| 1 | a\\|b |\n| 2 |  |"
    try:
        sinks.write_markdown(table, f"{tmp_path}/u", "Title", most=1)
    except ValueError:
        return
    raise AssertionError
