"""Lexical search and vector search against brute force."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from appcensus.llm import lexical_search, maxscore, topk
from tests.llm import cases

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(FOLD))


def ranking(docs, items, top):
    """Counter of (item_id, rank, doc_id, score)."""
    bags = [(doc_id, terms(text)) for doc_id, text in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(len(b) for _, b in bags)
    df = Counter(t for _, b in bags for t in set(b))
    out = Counter()
    for item_id, text in set(items):
        found = []
        for doc_id, bag in bags:
            tf, score = Counter(bag), 0
            m = 75 + (25 * len(bag) * n_docs) // n_terms if n_terms else 0
            for t in terms(text):
                if tf[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    score += w * ((1_000_000_000 * tf[t]) // (1000 * tf[t] + 12 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        for k, (score, _, _, doc_id) in enumerate(sorted(found, key=lambda f: f[:3])[:top]):
            out[item_id, k + 1, doc_id, -score] += 1
    return out


def corpus():
    rng = random.Random(4)
    docs = [(r[0], r[1]) for r in cases.rows()]
    docs += [(100 + k, cases.prose(rng, rng.choice([3, 20, 200, 900]))) for k in range(150)]
    docs += [(400 + k, "Stone7 river7, stone7!") for k in range(40)] + [(300, "stone7 River7 x")] * 30
    return docs


ITEMS = [
    (1, "stone7 river7 the-stone7"), (2, "password HUNTER2 é É 漢字"), (3, None), (4, ""), (5, "nowhere"),
    (6, " ".join(f"river{k} the" for k in range(50))), (7, "the"), (7, "river3 window4"), (None, "river1"),
    (8, "meadow4 candle9 é"), (8, "meadow4 candle9 é"), (9, "straße x11"),
]


@pytest.mark.parametrize("top,rows,block", [(20, 16, 10_000), (3, 4096, 3)])
def test_ranking(spark, monkeypatch, top, rows, block):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", rows)
    monkeypatch.setattr(lexical_search, "BLOCK_ITEMS", block)
    monkeypatch.setattr(lexical_search, "CHUNK", 50)
    docs = spark.createDataFrame(corpus(), "doc_id long, text string").repartition(5)
    for name in ("length", "class", "terms", "item", "score", "a.b"):
        docs = docs.withColumn(name, F.lit("x"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string").withColumn("length", F.lit(1))
    got = Counter(map(tuple, lexical_search.search(docs, items, top).collect()))
    assert got == ranking(corpus(), ITEMS, top)


def test_ranking_of_empty_tables(spark):
    docs = spark.createDataFrame(corpus(), "doc_id long, text string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    blank = spark.createDataFrame([(1, ""), (2, None), (3, "-- !")], "doc_id long, text string")
    assert lexical_search.search(docs.limit(0), items).count() == 0
    assert lexical_search.search(docs, items.limit(0)).count() == 0
    assert lexical_search.search(blank, items).count() == 0


def test_terms_in_pieces(monkeypatch):
    text = corpus()[7][1] + "É" * 300 + " ÀB-c"
    monkeypatch.setattr(lexical_search, "CHUNK", 64)
    found = [t.decode() for piece in lexical_search.terms_of(text.encode()) for t in piece]
    assert found == terms(text)


def test_bounds_prune_and_lose_nothing():
    """Buckets go by length and documents by coordinates, and never one that reaches the floor."""
    rng = np.random.default_rng(5)
    weight = rng.integers(1, 9000, 40)
    names = [np.sort(rng.choice(40, rng.integers(1, 12), replace=False)).astype(np.int32) for _ in range(600)]
    impacts = [rng.integers(1, 400_000, len(x)) for x in names]
    lengths = [math.sqrt(sum((i * math.sqrt(weight[t])) ** 2 for t, i in zip(x, v))) for x, v in zip(names, impacts)]
    order = np.argsort(lengths)[::-1]
    columns = [list(range(600)), [lengths[k] for k in order], [0] * 600, [names[k].tolist() for k in order],
               [impacts[k].tolist() for k in order]]
    batch = lexical_search._arrow(lexical_search._IMPACT, columns)
    buckets = [lexical_search._Bucket(batch.slice(k, 100), weight) for k in range(0, 600, 100)]
    assert all(a.longest >= b.longest for a, b in zip(buckets, buckets[1:]))
    skipped = dropped = 0
    for _ in range(30):
        query = lexical_search._Query(rng.choice(40, 9, replace=False), rng.integers(1, 4, 9), weight)
        every = np.concatenate([b.scores(query, np.arange(100)) for b in buckets])
        floor = int(np.sort(every)[-5])
        for k, b in enumerate(buckets):
            reach = set(np.flatnonzero(every[100 * k : 100 * k + 100] >= floor).tolist())
            if query.length * b.longest < floor:
                skipped += 1
                assert not reach
            else:
                left = set(b.candidates(query, floor).tolist())
                dropped += 100 - len(left)
                assert reach <= left
    assert skipped and dropped > 1000


# Vectors


def nearest(rows, top, every):
    def value(v):
        return [math.floor(1024 * x) for x in v]

    good = [(i, value(v)) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for a, (query_id, q) in enumerate(good):
        if query_id is None or query_id % every:
            continue
        found = []
        for b, (vec_id, v) in enumerate(good):
            if a != b:
                score = sum(x * y for x, y in zip(q, v))
                found.append((-min(max(score, -(1 << 63)), (1 << 63) - 1), vec_id is None, vec_id or 0, vec_id))
        for k, (score, _, _, vec_id) in enumerate(sorted(found, key=lambda f: f[:3])[:top]):
            out[query_id, k + 1, vec_id, -score] += 1
    return out


def float32(v):
    return None if v is None else [None if x is None else float(np.float32(x)) for x in v]


def vectors(seed=1):
    rng = np.random.default_rng(seed)
    rows = [(k, rng.normal(0, 0.2, 16).tolist()) for k in range(400)]
    rows += [(1000 + k, (rng.normal(0, 1, 16) * (rng.random(16) < 0.2)).tolist()) for k in range(200)]
    rows += [(2000 + k, rows[7][1]) for k in range(60)] + [(100, rows[100][1])] * 3  # copies, repeated rows
    rows += [(3000, None), (3100, []), (3200, [0.5, None]), (3300, [float("nan")]), (3400, [float("-inf")])]
    rows += [(3500, [0.25]), (3501, [-1.0] * 20), (None, rows[3][1]), (None, [2.0] * 16), (-100, [0.0] * 16)]
    return [(i, float32(v)) for i, v in rows]


@pytest.mark.parametrize("top,shard,block", [(10, 4096, 4 << 20), (3, 50, 64)])
def test_nearest(spark, monkeypatch, top, shard, block):
    monkeypatch.setattr(maxscore, "SHARD_ROWS", shard)
    monkeypatch.setattr(maxscore, "BLOCK_COMPONENTS", block)
    df = spark.createDataFrame(vectors(), "vec_id long, embedding array<float>").repartition(4)
    for name in ("row", "vector", "asks", "query", "score", "a.b"):
        df = df.withColumn(name, F.lit("x"))
    got = Counter(map(tuple, maxscore.search(df, df["vec_id"] % 100 == 0, top).collect()))
    assert got == nearest(vectors(), top, 100)


def test_nearest_of_huge_components(spark):
    rows = [(k, float32([(-1) ** k * 2.0 ** (6 * k), 3.5, -(2.0**k)])) for k in range(8)] + [(200, [3e38, 1.0])]
    df = spark.createDataFrame([(k, v) for k, v in rows[:-1]], "vec_id long, embedding array<float>")
    got = Counter(map(tuple, maxscore.search(df, F.lit(True)).collect()))
    assert got == nearest(rows[:-1], 10, 1)
    # Components beyond a 64-bit integer stop at its range.
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert maxscore.search(df, df["vec_id"] == 200).filter("score > 0").count() == 4


def test_nearest_of_small_tables(spark):
    df = spark.createDataFrame([(0, [1.0])], "vec_id long, embedding array<float>")
    assert maxscore.search(df, df["vec_id"] % 100 == 0).count() == 0
    assert maxscore.search(df.limit(0), df["vec_id"] % 100 == 0).count() == 0
    two = df.union(spark.createDataFrame([(None, [])], "vec_id long, embedding array<float>"))
    assert [tuple(r) for r in maxscore.search(two, two["vec_id"] == 0).collect()] == [(0, 1, None, 0)]


def test_essential_lists_decide(monkeypatch):
    """Vectors that stand in lists of small bounds only are never touched."""
    rng = np.random.default_rng(3)
    values = np.zeros((12, 500), np.int64)
    values[0, :20] = rng.integers(500, 900, 20)
    values[1:, :] = rng.integers(-4, 5, (11, 500)) * (rng.random((11, 500)) < 0.4)
    shard = maxscore._Shard(np.arange(500), np.arange(500).astype(object), values, 100)
    query = np.full(12, 10)
    scores = query @ values
    best, touched = topk.Best(5, int(np.sort(scores)[-5])), []
    monkeypatch.setattr(best, "add", lambda s, ids: touched.extend(zip(ids.tolist(), s.tolist())))
    shard.search(-1, query, best)
    assert {x for x, _ in touched} <= set(range(20))
    assert {(x, s) for x, s in enumerate(scores.tolist()) if s >= best.floor} <= set(touched)


def test_best():
    rng = np.random.default_rng(2)
    for _ in range(50):
        scores, ids = rng.integers(-5, 5, 60), rng.permutation(60).astype(object)
        ids[rng.random(60) < 0.1] = None
        best = topk.Best(7)
        for k in range(0, 60, 9):
            best.add(scores[k : k + 9], ids[k : k + 9])
        order = sorted(zip(scores.tolist(), ids.tolist()), key=lambda r: (-r[0], r[1] is None, r[1] or 0))
        assert [(s, x) for x, s in best.rows()] == order[:7] and best.floor == order[6][0]
