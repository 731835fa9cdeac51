"""Groups of equal texts under sharding: whole up to a shard, cut beyond."""

from __future__ import annotations

import collections
import random

from routelens.llm import sharding


def shards_of(spark, rows):
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    by_text, sizes = collections.defaultdict(set), collections.Counter()
    texts = dict(rows)
    for x in got:
        by_text[texts[x["doc_id"]]].add(x["shard"])
        sizes[x["shard"]] += x["size"]
    slots = collections.defaultdict(list)
    for x in got:
        slots[x["shard"]].append(x["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    return by_text, sizes


def test_groups_up_to_a_shard_stay_whole(spark):
    """Equal texts of a twentieth of all bytes go to one shard, and shards are level; a group of a third is cut."""
    r = random.Random(1)
    rest = ["".join(r.choices("abcdefgh ", k=200)) for _ in range(1900)]
    rows = list(enumerate(rest + ["x" * 199 + "y"] * 100))
    by_text, sizes = shards_of(spark, rows)
    assert all(len(s) == 1 for s in by_text.values()) and len(sizes) == 16
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16
    by_text, sizes = shards_of(spark, list(enumerate(rest[:1000] + ["z" * 200] * 500)))
    assert len(by_text["z" * 200]) > 4 and all(len(s) == 1 for t, s in by_text.items() if t != "z" * 200)
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16


def test_many_large_groups_are_cut_for_level_shards(spark):
    """25 groups of a 25th each can't be level whole."""
    by_text, sizes = shards_of(spark, [(i, "abc" * 20 + chr(97 + i % 25)) for i in range(5000)])
    assert max(sizes.values()) <= 1.02 * sum(sizes.values()) / 16 and min(sizes.values()) >= 0.98 * sum(sizes.values()) / 16
