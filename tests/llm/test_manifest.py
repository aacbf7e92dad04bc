"""The Merkle manifest against one made in plain loops."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from appcensus.llm import merkle_manifest as M
from appcensus.llm.tables import new_path
from tests.llm import cases

FOLD = str.maketrans(M.UPPER, M.LOWER)


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, text):
    doc_id, _, lang, source, n_chars = row
    fields = [None if v is None else str(v) for v in (doc_id, source, lang, n_chars, text)]
    return digest(*["-" if v is None else f"{len(v.encode())}:{v}" for v in fields])


def climb(nodes, place):
    """The top of ``nodes`` and the siblings of each run on the way up from ``place``."""
    path = []
    while len(nodes) > 1:
        run = nodes[place // 8 * 8 : place // 8 * 8 + 8]
        path.append((run[: place % 8], run[place % 8 + 1 :]))
        nodes = [digest(*nodes[k : k + 8]) for k in range(0, len(nodes), 8)]
        place //= 8
    return nodes[0], path


def manifest(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row, row[1]), row))
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    leaves = {x: sorted(trees[x], key=lambda t: t[:3]) for x in langs}
    tops = [climb([t[2] for t in leaves[x]], 0)[0] for x in langs]
    out = Counter()
    for k, lang in enumerate(langs):
        for place, (_, _, leaf, row) in enumerate(leaves[lang]):
            subroot, low = climb([t[2] for t in leaves[lang]], place)
            root, high = climb(tops, k)
            shown = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0 and row[1] is not None
            node = leaf_of(row, row[1].translate(FOLD)) if shown else leaf
            for before, after in low + high:
                node = digest(*before, node, *after)
            proof = digest(*[s for before, after in low + high for s in before + after])
            out[row[0], leaf, subroot, root, proof, node, node == root] += 1
    return out


def query(spark, df):
    changed = F.crc32(df["doc_id"].cast("string").cast("binary")) % 3 == 0
    return M.verify(df, F.translate(df["text"], M.UPPER, M.LOWER), changed, new_path(spark, "merkle"))


def test_every_row_is_proved(spark):
    got = Counter(tuple(r) for r in query(spark, cases.frame(spark, clashes=True)).collect())
    assert got == manifest(cases.rows())
    assert {r[-1] for r in got} == {True, False}


def test_heights_of_trees_differ(spark):
    rows = [(k, f"Text {k}", "a", "s", k) for k in range(600)] + [(7, "lone", "", None, None)]
    rows += [(k, None, f"l{k % 30}", "s", None) for k in range(90)]
    rows += [(5, "Again", "z", "s", 1)] * 200  # one row, many leaves
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(5)
    assert Counter(tuple(r) for r in query(spark, df).collect()) == manifest(rows)


def test_small_tables(spark):
    assert query(spark, cases.empty(spark)).count() == 0
    one = [(1, "Only", "en", "a", 4)]
    got = query(spark, spark.createDataFrame(one, cases.SCHEMA)).collect()
    assert Counter(map(tuple, got)) == manifest(one)
    assert got[0].root == got[0].leaf and got[0].proof_sha256 == digest()


def test_some_requests(spark):
    rows = [(k, f"t{k}", "ab"[k % 2], "s", k) for k in range(300)]
    store = M.Manifest(spark, new_path(spark, "merkle"))
    fields = [F.col(name) for name in M.FIELDS]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    store.build(df.select("doc_id", M.tree_of(F.col("lang")).alias("tree"), M.leaf_digest(fields).alias("leaf")))
    asked = spark.createDataFrame([("=a", 0), ("=a", 149), ("=b", 64), ("=b", 64), ("=b", 150), ("=c", 0)], "tree string, rank long")
    again = M.Manifest(spark, store.path)  # the stored tables are enough
    got = Counter(
        (r.tree, r.rank, "|".join(run.before + "-" + run.after for run in r.path)) for r in again.prove(asked).collect()
    )
    nodes = {x: [leaf_of(r, r[1]) for r in rows if r[2] == x] for x in "ab"}
    tops = [climb(nodes[x], 0)[0] for x in "ab"]

    def path(lang, place):
        steps = climb(nodes[lang], place)[1] + climb(tops, "ab".index(lang))[1]
        return f"={lang}", place, "|".join("".join(b) + "-" + "".join(a) for b, a in steps)

    assert got == Counter([path("a", 0), path("a", 149), path("b", 64), path("b", 64)])
    assert again.root()[1] == climb(tops, 0)[0]


@pytest.mark.parametrize("height", [1, 2, 3])
def test_records_are_content_addressed(spark, height):
    rows = [(k, f"t{k}", "a", "s", k) for k in range(100)] + [(9, "t9", "b", "s", 9)] * 640
    store = M.Manifest(spark, new_path(spark, "merkle"))
    fields = [F.col(name) for name in M.FIELDS]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    store.build(df.select("doc_id", M.tree_of(F.col("lang")).alias("tree"), M.leaf_digest(fields).alias("leaf")))
    records = store.records("lang", height).collect()
    assert all(r.digest == digest(*r.children) for r in records)
    assert len({r.digest for r in records}) == len(records)
    # 640 equal leaves need one record below their top level, where two of its runs differ in length.
    assert len(records) == {1: 13 + 1, 2: 2 + 1, 3: 1 + 2}[height]
