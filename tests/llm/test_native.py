"""Quality rules, exact dedup, mixing and tool calls against brute force and SQL."""

import hashlib
import json
import os
import re
from collections import Counter

import pytest

import __spark_entry__ as contract
from appcensus.llm import exact_dedup, mixing, quality_rules, tool_calls
from appcensus.llm.registry import ORACLE, QUERIES
from appcensus.llm.tables import new_path
from tests.llm import cases

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DATA = contract.FLAGSHIP_DATA


def repeated(words):
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    return len({k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)})


def test_quality_statistics(spark):
    texts = [r[1] for r in cases.rows()] + [
        "a b c d e a b c d e a b c d e f", "x x x x x x x", "l1\nl1\n\n \nl1\nl2", "#a $b % && | <> *",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in quality_rules.quality_report(df).collect():
        text = texts[r.doc_id] or ""
        words = WORD.findall(text)
        lines = [x for x in text.split("\n") if WORD.search(x)]
        assert r.n_words == len(words)
        assert r.word_chars == sum(map(len, words))
        assert r.n_symbols == sum(c in "#*$%&|<>" for c in text)
        assert r.n_dup_lines == len(lines) - len(set(lines))
        assert r.n_repeat_words == repeated(words)
        assert r.base_failed == (len(words) < 10 or 100 * repeated(words) > 20 * len(words))
        assert not (r.kept and r.base_failed)


def test_quality_keeps_columns_and_empty_tables(spark):
    df = cases.frame(spark, clashes=True)
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 2, 3, 4, 8, 9}
    assert quality_rules.quality_report(cases.empty(spark)).count() == 0
    assert quality_rules.quality_report(df, rules=()).filter("kept = base_failed").count() == 0


def test_exact_dedup(spark):
    df = cases.frame(spark, clashes=True)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    got = exact_dedup.deduplicate(df, index).collect()
    groups = {}
    for doc_id, text, *_ in cases.rows():
        key = hashlib.sha256((text or "").translate(FOLD).encode()).hexdigest()
        groups.setdefault(key, []).append(doc_id)
    assert len(got) == len(cases.rows())
    for r in got:
        ids = groups[r.text_sha256]
        known = [i for i in ids if i is not None]
        assert r.group_size == len(ids) and r.keep_id == (max(known) if known else None)
        assert r.kept == (r.doc_id == r.keep_id)
    assert index.rows().count() == len(groups)
    # The index remembers, in another handle as well, and a batch tried again adds nothing.
    again = exact_dedup.DigestIndex(spark, index.path, 4)
    assert exact_dedup.deduplicate(df, again).filter("kept").count() == 0
    assert again.rows().count() == len(groups)
    plan = again.unseen(again.rows().select("digest"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def index_side(index):
    """Operators that read the index in an anti-join with other digests."""
    other = index.spark.createDataFrame([("x",)], "digest string").repartition(3)
    plan = index.unseen(other)._jdf.queryExecution().executedPlan().toString()
    lines = plan.split("\n")
    scan = next(k for k, line in enumerate(lines) if "digest_index" in line and "Scan" in line)
    join = next(k for k, line in enumerate(lines) if "SortMergeJoin" in line)
    # The right side of the join is printed after the left one.
    right = [line for line in lines[join + 1 : scan + 1] if line.lstrip(" :").startswith(("+-", "*"))]
    depth = lines[join].index("SortMergeJoin") + 3
    start = max(k for k in range(join + 1, scan + 1) if lines[k][depth - 3 : depth] == "+- ")
    return "\n".join(lines[start : scan + 1]) if right else ""


def test_index_is_used_and_merged(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MERGE_BATCHES", 3)
    monkeypatch.setattr(exact_dedup, "BUCKET_DIGESTS", 20)
    path = new_path(spark, "index-first") + "/same-1"
    index, twin = exact_dedup.DigestIndex(spark, path, 2), exact_dedup.DigestIndex(spark, path[:-2] + "x-1", 2)
    assert index.name != twin.name
    texts = [f"t{k % 70}" for k in range(200)]
    seen = Counter()
    for k in range(0, 200, 25):
        rows = [(k + j, text) for j, text in enumerate(texts[k : k + 25])]
        got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id long, text string"), index, batch=f"b{k}")
        assert {r.text_sha256 for r in got.collect() if r.kept} == {
            hashlib.sha256(t.encode()).hexdigest() for _, t in rows if t not in seen
        }
        seen.update(t for _, t in rows)
    assert index.version > 1 and index.buckets == 4  # 70 digests, 20 to a bucket
    big = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 2)
    exact_dedup.deduplicate(spark.createDataFrame([(k, f"b{k}") for k in range(90)], "doc_id long, text string"), big)
    assert big.buckets == 8 and big.rows().count() == 90
    index.merge()
    assert len(index._every().inputFiles()) <= index.buckets
    again = exact_dedup.DigestIndex(spark, path, 2)
    assert (again.version, again.buckets) == (index.version, 4) and twin.rows().count() == 0
    sizes = {r.digest: r.group_size for r in again.groups().collect()}
    assert sizes == {hashlib.sha256(t.encode()).hexdigest(): n for t, n in seen.items()}
    side = index_side(again)
    assert "Scan parquet" in side and "Sort " not in side and "Exchange" not in side


def test_whole_table_goes_through_the_index(spark, monkeypatch):
    df = cases.frame(spark, clashes=True)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    rejected, real = [], exact_dedup.DigestIndex.new_to

    def spy(self, groups, batch):
        found = real(self, groups, batch)
        rejected.append(groups.count() - found.count())
        return found

    monkeypatch.setattr(exact_dedup.DigestIndex, "new_to", spy)
    got = Counter(map(tuple, exact_dedup.deduplicate_table(df, index).collect()))
    other = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    assert got == Counter(map(tuple, exact_dedup.deduplicate(df, other).collect()))
    rows = [(k, f"t{k % 40}") for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    got = exact_dedup.deduplicate_table(df, index).collect()
    assert rejected[-1] > 30  # the second half finds its digests in the index
    assert {r.doc_id for r in got if r.kept} == set(range(60, 100)) and all(
        r.group_size == (3 if r.doc_id % 40 < 20 else 2) and r.keep_id >= 60 for r in got
    )
    assert {r.batch for r in index.rows().collect()} == {"later ids"}


def test_exact_dedup_keeps_rows(spark):
    df = cases.frame(spark, clashes=True)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    kept = exact_dedup.keep_new(df, index)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    assert ids[3] == 1 and 1 not in ids and 2 not in ids and ids[13] == 2 and ids[10] == 1
    fresh = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    assert exact_dedup.deduplicate(cases.empty(spark), fresh).count() == 0


def test_exact_dedup_batch_tried_again(spark):
    def kept(rows, batch):
        df = spark.createDataFrame(rows, "doc_id long, text string")
        return {r.doc_id for r in exact_dedup.deduplicate(df, index, batch=batch).filter("kept").collect()}

    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    one, two = [(1, "a"), (2, "A"), (3, "b"), (None, "c")], [(4, "b"), (5, "d"), (None, "C"), (6, "D")]
    first = [kept(one, "one") for _ in range(2)]
    assert first == [{2, 3, None}] * 2
    assert [kept(two, "two") for _ in range(2)] == [{6}] * 2
    assert kept(one, "two") == kept(one, None) == kept(two, None) == set()
    assert kept(one, "one") == first[0] and index.rows().count() == 4


def test_exact_dedup_keeps_one_row(spark):
    rows = [(7, "Same text", "en", "a", 1)] * 40 + [(7, "same TEXT", "en", "b", 2)]
    rows += [(None, "no id", "en", k, 3) for k in "abc"] + [(None, "NO id", None, None, None)] * 2
    rows += [(8, "other", "en", "a", 4)] * 2 + [(7, "unlike", "en", "a", 5), (9, None, "en", "a", 6)]
    df = spark.createDataFrame(rows, cases.SCHEMA).repartition(3)
    index = exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4)
    kept = exact_dedup.keep_one(df, index)
    assert kept.columns == df.columns
    got = Counter((r.doc_id, (r.text or "").lower()) for r in kept.collect())
    assert got == Counter([(7, "same text"), (None, "no id"), (8, "other"), (7, "unlike"), (9, "")])
    again = exact_dedup.keep_one(df, exact_dedup.DigestIndex(spark, new_path(spark, "index"), 4))
    assert sorted(map(str, kept.collect())) == sorted(map(str, again.collect()))


@pytest.mark.parametrize("bits", [2, 10])
def test_mixing(spark, bits):
    df = cases.frame(spark, clashes=True)
    got = mixing.mix(df, level_bits=bits).collect()
    size = Counter()
    for _, text, _, source, _ in cases.rows():
        size[source] += len(WORD.findall(text or ""))
    order = sorted((s for s in size if s is not None)) + [None] * (None in size)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(size.values()), set(order)
    while True:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] >= 2 * size[s]}
        if not full:
            target |= share
            break
        for s in full:
            target[s] = 2.0 * size[s]
        left -= sum(2 * size[s] for s in full)
        free -= full
        if not free:
            break
    assert len(got) == len(cases.rows())
    largest, taken = Counter(), Counter()
    for _, text, _, source, _ in cases.rows():
        largest[source] = max(largest[source], len(WORD.findall(text or "")))
    # Sources are told apart by their size here.
    named = {n: source for source, n in size.items()}
    assert len(named) == len(size)
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        assert r.target == pytest.approx(target[named[r.source_size]])
        taken[named[r.source_size]] += r.taken
    for source in size:
        assert abs(taken[source] - target[source]) <= largest[source]
    again = mixing.mix(df.repartition(5), level_bits=bits).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_mixing_meets_targets_without_ids(spark):
    rows = [(k, f"w{k} " * (k % 20 + 1), "en", "a", k) for k in range(100)]
    rows += [(None, f"n{k} " * (k % 20 + 1), "en", "a", k) for k in range(150)]  # no id
    rows += [(None, "same words here", "en", "a", 1)] * 50  # one row, many times
    rows += [(7, f"x{k}", "en", "b", 1) for k in range(90)] + [(k, "y " * 9, "en", "c", k) for k in range(40)]
    df = spark.createDataFrame(rows, cases.SCHEMA)
    got = mixing.mix(df).collect()
    taken, target = Counter(), {}
    for r in got:
        taken[r.source_size] += r.taken
        target[r.source_size] = r.target
        assert r.taken <= 2 * r.size
    assert len(target) == 3 and all(abs(taken[s] - target[s]) <= 20 for s in target)
    mixed = Counter((r.doc_id, r.text) for r in mixing.mixed(df).collect())
    words = Counter()
    for (_, text), n in mixed.items():
        words[len(WORD.findall(text))] += n * len(WORD.findall(text))
    expected = Counter()
    for r in got:
        expected[r.size] += r.taken
    assert words == +expected
    again = mixing.mix(df).collect()
    assert sorted(map(str, got)) == sorted(map(str, again))


def test_sources_without_bound(spark):
    rows = [(k, "w " * (k % 7 + 1), "en", f"s{k % 900:04d}", k) for k in range(2_000)]
    got = mixing.mix(spark.createDataFrame(rows, cases.SCHEMA)).collect()
    size = Counter()
    for k, _, _, source, _ in rows:
        size[source] += k % 7 + 1
    weights = {s: (3, 1, 2)[n % 3] for n, s in enumerate(sorted(size))}
    low, high = 0.0, 1e9
    for _ in range(200):  # the level that all sources below their cap share
        level = (low + high) / 2
        spent = sum(min(2 * size[s], level * weights[s]) for s in size)
        low, high = (level, high) if spent < 1.5 * sum(size.values()) else (low, level)
    for r in got:
        source = f"s{r.doc_id % 900:04d}"
        assert r.target == pytest.approx(min(2 * size[source], low * weights[source]))


def test_mixed_rows(spark):
    df = cases.frame(spark, clashes=True)
    out = mixing.mixed(df)
    assert out.columns == df.columns
    counts = Counter(r.doc_id for r in out.collect())
    assert set(counts.values()) <= {1, 2, 4}  # two rows share an id or have none
    assert mixing.mix(cases.empty(spark)).count() == 0
    assert mixing.mixed(cases.empty(spark)).count() == 0


def calls(spark, rows):
    return spark.createDataFrame(
        rows, "conv_id long, turn long, call_id string, parent_id string, name string, arguments string"
    )


def test_tool_calls(spark):
    good = '{"size": 3, "unit": "char"}'
    chain = [(1, t, f"k{t}", f"k{t - 1}" if t else None, "measure", good) for t in range(40)]
    odd = [
        (2, 1, "a", "b", "measure", good), (2, 2, "b", "a", "measure", good),  # a cycle
        (2, 3, "c", "nowhere", "measure", good),
        (2, 4, "bad", None, "measure", "{"), (2, 4, "none", None, "measure", None),
        (2, 4, "list", None, "measure", "[1]"), (2, 4, "what", None, "other", "{}"),
        (2, 5, "all", None, "measure", '{"unit": "mile", "size": "x", "z": 1}'),
        (2, 6, "far", None, "answer", '{"text": "t", "n_words": 151}'),
        (2, 7, "twice", None, "measure", good), (2, 8, "twice", None, "measure", good),
        (2, 9, None, None, "measure", good), (2, 10, None, None, "measure", good),
    ]
    results = spark.createDataFrame(
        [(1, 1, "k0", 'say "hi"\n'), (1, 2, "k0", "later"), (2, 9, "c", None), (2, 9, "lost", "r"),
         (3, 1, None, "no id"), (None, 1, "k0", "no conversation")],
        "conv_id long, turn long, call_id string, content string",
    )
    got = {
        (r.conv_id, r.call_id): r
        for r in tool_calls.link(calls(spark, chain + odd), results, tool_calls.TOOLS).collect()
    }
    assert [got[1, f"k{t}"].level for t in range(40)] == list(range(40))
    assert got[1, "k0"].status == "ok" and got[1, "k0"].n_results == 2
    record = json.loads(got[1, "k0"].record)
    assert record["result"] == 'say "hi"\n' and list(record) == sorted(record)
    assert '"arguments":{"size":3,"unit":"char"}' in got[1, "k0"].record
    assert got[1, "k1"].status == "no_result"
    assert got[2, "a"].status == got[2, "b"].status == "cycle" and got[2, "a"].level is None
    assert (got[2, "c"].status, got[2, "c"].level) == ("ok", 0)
    assert json.loads(got[2, "c"].record)["result"] is None
    errors = {k: got[2, k].errors for k in ("bad", "none", "list", "what", "all", "far")}
    assert errors == {
        "bad": "not_json", "none": "not_json", "list": "not_object", "what": "unknown_tool",
        "all": "choice:unit,type:size,unknown:z", "far": "range:n_words",
    }
    assert got[2, "twice"].n_calls == 2
    assert got[2, None].status == "no_id" and got[2, None].n_calls == 2
    assert got[3, None].status == "no_id" and got[2, "lost"].status == "orphan_result"
    assert got[None, "k0"].status == "orphan_result"
    none = tool_calls.link(calls(spark, []), results.limit(0), tool_calls.TOOLS)
    assert none.count() == 0


def test_every_tool_call_is_a_row(spark):
    def sized(n):
        return '{"size": %d, "unit": "char"}' % n

    asked = [
        (1, 0, "a", None, "measure", sized(1)), (1, 1, "b", "a", "measure", sized(2)),
        (1, 2, "b", "b", "measure", "{"), (1, 2, "b", "gone", "measure", sized(3)),
        (1, 3, None, "b", "measure", sized(4)), (1, 4, None, None, "other", "{}"),
        (None, 0, "a", None, "measure", sized(5)), (None, 1, "b", "a", "measure", sized(6)),
        (2, 0, "x", "x", "measure", sized(7)), (2, 1, "x", "x", "measure", sized(8)),
    ] + [(3, 0, None, None, "measure", sized(9))] * 20 + [(3, 1, "s", None, "measure", sized(9))] * 20
    answered = [
        (1, 1, "b", "first"), (1, 2, "b", "second"), (1, 3, None, "loose"), (1, 3, None, "more"),
        (None, 1, "b", "free"), (2, 1, "lost", "l1"), (2, 2, "lost", "l2"), (3, 2, "s", "s"),
    ] + [(3, 3, "s", "s")] * 5
    results = spark.createDataFrame(answered, "conv_id long, turn long, call_id string, content string")
    got = Counter()
    for r in tool_calls.link(calls(spark, asked), results, tool_calls.TOOLS).collect():
        record = json.loads(r.record)
        size = (record["arguments"] or {}).get("size")
        assert record["status"] == r.status and record["level"] == r.level
        got[r.conv_id, r.call_id, r.status, r.level, size, record["result"], r.errors, r.n_calls, r.n_results] += 1
    assert got == Counter({
        (1, "a", "no_result", 0, 1, None, "", 1, 0): 1,
        (1, "b", "ok", 1, 2, "first", "", 3, 2): 1,
        (1, "b", "duplicate_id", 2, None, None, "not_json", 3, 2): 1,
        (1, "b", "duplicate_id", 0, 3, None, "", 3, 2): 1,
        (1, "b", "duplicate_id", None, None, "second", "", 3, 2): 1,
        (1, None, "no_id", 2, 4, None, "", 2, 2): 1,
        (1, None, "no_id", 0, None, None, "unknown_tool", 2, 2): 1,
        (1, None, "no_id", None, None, "loose", "", 2, 2): 1,
        (1, None, "no_id", None, None, "more", "", 2, 2): 1,
        (None, "a", "no_result", 0, 5, None, "", 1, 0): 1,
        (None, "b", "ok", 1, 6, "free", "", 1, 1): 1,
        (2, "x", "cycle", None, 7, None, "", 2, 0): 1,
        (2, "x", "duplicate_id", None, 8, None, "", 2, 0): 1,
        (2, "lost", "orphan_result", None, None, "l1", "", 0, 2): 1,
        (2, "lost", "orphan_result", None, None, "l2", "", 0, 2): 1,
        (3, None, "no_id", 0, 9, None, "", 20, 0): 20,
        (3, "s", "ok", 0, 9, "s", "", 20, 6): 1,
        (3, "s", "duplicate_id", 0, 9, None, "", 20, 6): 19,
        (3, "s", "duplicate_id", None, None, "s", "", 20, 6): 5,
    })


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "conversations", "benchmark", "embeddings"):
        connection.sql(f"create view {table} as select * from '{DATA}/{table}.parquet'")
    expected = connection.sql(ORACLE[name])
    got = QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns)
    mine = sorted(str(tuple(r[c] for c in columns)) for r in got.collect())
    at = [expected.columns.index(c) for c in columns]
    assert mine == sorted(str(tuple(r[k] for k in at)) for r in expected.fetchall())
