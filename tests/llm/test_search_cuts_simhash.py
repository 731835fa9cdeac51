"""Operators 11 to 13 against brute force: ranked search, fill-in-middle, SimHash; edge cases of each."""

from __future__ import annotations

import hashlib
import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from routelens.llm import fill_middle, lexical, simhash

EDGE = [(None, "alpha beta gamma"), (0, None), (1, ""), (2, " \n\t"), (3, "one"), (4, "One"), (5, "a b c d"), (6, "a b c d"), (6, "a b c d"), (6, "other text of six"), (7, "naïve 😀 text\nsecond line "), (8, "has <P> inside of it"), (9, "lorem ipsum dolor " * 9000)]
DDL = "doc_id long, text string, n long, rank int, score double, f string, g string, key string"


def table(spark, rows):
    return spark.createDataFrame([(d, t, 7, 7, 7.0, "x", "y", "z") for d, t in rows], DDL)


def random_docs(seed, n=400, vocabulary=120, longest=90):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdefghÄé", k=r.randint(1, 4))) for _ in range(vocabulary)]
    weights = [1 / (i + 1) for i in range(vocabulary)]
    return [(i, "".join(w.title() if r.random() < 0.1 else w + r.choice([" ", ", ", "\n", "-"]) for w in r.choices(words, weights, k=r.randint(0, longest)))) for i in range(n)]


def ranked(docs, items, k):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    held = [(d, Counter(find(t))) for d, t in docs]
    held = [(d, c) for d, c in held if c]
    n, total, df = len(held), sum(sum(c.values()) for _, c in held), Counter(t for _, c in held for t in c)
    out = []
    for item, text in set(items):
        scores = []
        for d, c in held:
            m = 50 + 50 * sum(c.values()) * n // total
            scores.append((-sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(find(text)) if t in c), d is None, d or 0))
        out += [(item, i + 1, None if null else d, -s) for i, (s, null, d) in enumerate(sorted(x for x in scores if x[0])[:k])]
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x) for x in r))


@pytest.mark.parametrize("bounds", [{}, {"most_items": 8}, {"most_chars": 900}])
def test_ranked_search_by_brute_force(spark, bounds):
    docs, items = random_docs(1), [(i, t[:200]) for i, t in random_docs(9, 12)] + [(3, None), (4, ""), (5, "zzz unknown"), (6, "a ä b"), (6, "a ä b"), (6, "é")]
    docs += [docs[7], docs[7], (None, docs[8][1]), (1, docs[9][1])]
    got = lexical.ranked_search(table(spark, docs).repartition(3), spark.createDataFrame(items, "item_id long, text string"), k=10, **bounds).collect()
    assert order(map(tuple, got)) == order(ranked(docs, [x for x in items if x[1]], 10))


def test_ranked_search_edges(spark):
    items = spark.createDataFrame([(1, "lorem one a"), (None, "text")], "item_id long, text string")
    assert order(map(tuple, lexical.ranked_search(table(spark, EDGE), items).collect())) == order(ranked(EDGE, [(1, "lorem one a"), (None, "text")], 50))
    for docs, asked in ((table(spark, []), items), (table(spark, EDGE), items.limit(0)), (table(spark, EDGE[1:4]), items)):
        got = lexical.ranked_search(docs, asked)
        assert got.columns == ["item_id", "rank", "doc_id", "score"] and got.count() == 0


def test_impacts_stop_early_and_completely(spark):
    """A few documents that hold all rare words end the scan before the postings of common words are processed."""
    r, n, words = np.random.default_rng(3), 20_000, 40
    docs = [np.flatnonzero(r.random(words) < np.linspace(0.9, 0.01, words)) for _ in range(n)]
    for i in range(0, 600, 10):
        docs[i] = np.arange(words)
    at, term = np.concatenate(([0], np.cumsum([len(x) for x in docs]))), np.concatenate(docs)
    w = np.array([lexical.weight(n, int(x)) for x in np.bincount(term, minlength=words)])
    index = lexical.ImpactIndex(at, term, r.integers(1, 3, len(term)), np.array([len(x) for x in docs]), w, n, len(term))
    whole = np.bincount(np.repeat(np.arange(n), np.diff(at)), weights=index.impact, minlength=n).astype(np.int64)
    found, scores, done = index.top(np.arange(words), 10, np.empty(0, np.int64))
    assert done < len(term) // 2
    assert (whole[found] == scores).all() and set(np.lexsort((np.arange(n), -whole))[:10]) <= set(found.tolist())
    assert len(index.top(np.arange(words), 10, np.full(10, whole.max() + 1))[0]) == 0


def cut(doc, text):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text or "")
    text, n = text or "", len(units)
    h = [int(hashlib.sha256(f"42:{'null' if doc is None else doc}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return doc, n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < 80:
        return doc, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("chunk", [1, 7, 64, fill_middle.CHUNK])
def test_fill_in_middle_by_brute_force(spark, chunk):
    docs = [x for x in EDGE if chunk > 9 or len(x[1] or "") < 1000] + [(d + 100, t) for d, t in random_docs(5, 60)] + [(300 + i, " " * i + "x" * (i % 3) + "\t\n" * (i % 2)) for i in range(20)] + [(400 + i, "a<" + t + "<") for i, t in random_docs(6, 20)]
    got = fill_middle.fill_in_middle(table(spark, docs), chunk=chunk).withColumn("back", fill_middle.restored())
    rows = got.collect()
    assert order(tuple(r)[:6] for r in rows) == order(cut(*x) for x in docs)
    assert Counter(r["back"] for r in rows) == Counter(t or "" for _, t in docs)
    assert {"plain", "spm", "psm"} == {r["form"] for r in rows}


def test_chunk_functions_compose(spark):
    r = random.Random(4)
    for _ in range(200):
        text = "".join(r.choices("ab \n", k=r.randint(0, 30))).encode()
        places = sorted(r.choices(range(len(text) + 1), k=r.randint(0, 5)))
        parts = [np.frombuffer(text[a:b], np.uint8) for a, b in itertools.pairwise([0, *places, len(text)])]
        exits, counts = (np.array(x) for x in zip(*map(fill_middle.chunk_function, parts), strict=True))
        exits, counts = fill_middle.compose(exits, counts)
        whole = fill_middle.chunk_function(np.frombuffer(text, np.uint8))
        assert exits[-1].tolist() == whole[0].tolist() and counts[-1].tolist() == whole[1].tolist()
        assert counts[-1][fill_middle.START] == len(re.findall(rb"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text))


def test_fill_in_middle_empty_table(spark):
    got = fill_middle.fill_in_middle(table(spark, []))
    assert got.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"] and got.count() == 0


def fingerprint_of(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(x, 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def simhash_by_pairs(docs):
    prints = [fingerprint_of(t) for _, t in docs]
    top = list(range(len(docs)))

    def find(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in itertools.combinations(range(len(docs)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
            top[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [(d, f"{p:016x}", least.get(find(i))) for i, ((d, _), p) in enumerate(zip(docs, prints, strict=True))]


def near_docs(seed, groups=25):
    r, out = random.Random(seed), []
    for _ in range(groups):
        base = [f"w{r.randrange(500)}" for _ in range(r.randint(40, 300))]
        for _ in range(r.randint(1, 12)):
            t = list(base)
            for _ in range(r.randint(0, 2)):
                t[r.randrange(len(t))] = f"w{r.randrange(500)}"
            out.append(" ".join(t))
    return list(enumerate(out))


def test_simhash_by_brute_force(spark):
    docs = near_docs(8) + [(None, near_docs(8)[3][1]), (2, near_docs(8)[-1][1]), (None, "all alone here with no id")]
    want = simhash_by_pairs(docs)
    assert len({c for _, _, c in want}) < len(docs) - 20
    assert order(map(tuple, simhash.simhash_components(table(spark, docs)).collect())) == order(want)


def test_simhash_edges(spark):
    assert order(map(tuple, simhash.simhash_components(table(spark, EDGE)).collect())) == order(simhash_by_pairs(EDGE))
    assert simhash.simhash_components(table(spark, [])).count() == 0


def test_dense_shards_are_dealt_again(spark):
    """Fingerprints that share 46 bits: every shard of the first step overflows, and no link is lost."""
    r = random.Random(5)
    values = sorted({0xABCDEF0123450000 | r.randrange(1 << 9) << 7 | r.randrange(4) for _ in range(900)} | {r.getrandbits(64) for _ in range(50)})
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    shards, width = spark.createDataFrame([(v, 0, v) for v in signed], "f long, g long, v long"), 64
    while width > 8:
        shards, width = simhash._deal(shards, width), width // 2
        groups = {}
        for row in shards.collect():
            groups.setdefault(row["g"], set()).add(row["f"])
        met = {p for members in groups.values() for p in itertools.combinations(sorted(members), 2)}
        assert {p for p in met if distance(*p) <= 2} == {p for p in itertools.combinations(sorted(signed), 2) if distance(*p) <= 2}
    assert max(map(len, groups.values())) <= 256


def test_bk_tree_finds_all_within_the_radius():
    r = random.Random(6)
    for bits in (8, 16, 64):
        tree, held = simhash.BKTree(), {r.getrandbits(bits) for _ in range(300)}
        for v in held:
            tree.add(v)
        for q in [r.getrandbits(bits) for _ in range(50)] + list(held)[:20]:
            for radius in (0, 2, 5):
                assert sorted(tree.within(q, radius)) == sorted(v for v in held if (v ^ q).bit_count() <= radius)
