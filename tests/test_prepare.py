import random

import pytest
from pyspark.sql import functions as F

from appcensus.operators.dedupe import deduplicate
from appcensus.operators.filters import select_source
from appcensus.operators.running import numbered, running
from appcensus.operators.shadow import drop_shadowed
from appcensus.plans.prepare import in_report_order, prepare, prepare_stats
from tests.rows import entry, fleet


def names(df):
    return [(r.name, r.version, r.source) for r in df.collect()]


def test_dedupe_prefers_detail_then_path_then_first(spark):
    rows = [
        entry("App", 1, registry_path="b", install_location="C:\\A\\"),
        entry(" APP ", 2, registry_path="c", install_location="c:\\a", uninstall_string="u"),
        entry("Tie", 3, registry_path="z"),
        entry("tie", 4, registry_path="a"),
        entry("Same", 5, registry_path="p", scope="first"),
        entry("same", 6, registry_path="p", scope="second"),
        entry("App", 7, version="2.0"),
        entry("App", 8, host="h2"),
    ]
    got = {
        (r.host, r.name.strip().lower(), r.version): (r.registry_path, r.scope, r.ord)
        for r in deduplicate(fleet(spark, rows)).collect()
    }
    assert got == {
        # The position is that of the first row seen, not of the one kept.
        ("h1", "app", "1.0"): ("c", "machine", 1),
        ("h1", "tie", "1.0"): ("a", "machine", 3),
        ("h1", "same", "1.0"): ("p", "first", 5),
        ("h1", "app", "2.0"): ("path-0007", "machine", 7),
        ("h2", "app", "1.0"): ("path-0008", "machine", 8),
    }


def shadowed_by_loop(rows):
    kept = []
    for row in rows:
        if row["source"] == "appx":
            same = [
                other for other in rows
                if other["source"] == "registry" and other["name"].strip()
                and other["name"].strip().lower() == row["name"].strip().lower()
                and other["host"] == row["host"]
            ]
            pub = (row["publisher"] or "").strip().lower()
            pubs = [(o["publisher"] or "").strip().lower() for o in same]
            if same and (not pub or "" in pubs or pub in pubs):
                continue
        kept.append(row["ord"])
    return sorted(kept)


def test_shadowing_same_as_loop(spark):
    rng = random.Random(3)
    rows = [
        entry(
            rng.choice(["A", " a", "B", "C", " "]), i, host=rng.choice(["h1", "h2"]),
            publisher=rng.choice(["P", "p ", "Q", None, " "]),
            source=rng.choice(["registry", "appx", "appx", "other"]),
        )
        for i in range(40)
    ]
    got = sorted(r.ord for r in drop_shadowed(fleet(spark, rows)).collect())
    assert got == shadowed_by_loop(rows)


MIXED = [
    entry("Keep App", 0, publisher="Contoso"),
    entry("Dual Packaged App", 1, publisher="Fabrikam", version="5.1.0"),
    entry("Dual Packaged App", 2, publisher="Fabrikam", version="5.1.0.0", source="appx"),
    entry("Windows Terminal", 3, publisher="M", source="appx"),
    entry("Runtime", 4, source="appx", system_component=True),
]


def test_mixed_sources(spark):
    rows = fleet(spark, MIXED)
    assert [(n, s) for n, _, s in names(in_report_order(prepare(rows)))] == [
        ("Dual Packaged App", "registry"), ("Keep App", "registry"), ("Windows Terminal", "appx"),
    ]
    stats = prepare_stats(rows).first()
    assert stats[2:] == (5, 1, 1, 0, 3)
    chosen = prepare(select_source(rows, "appx"))
    assert {n for n, *_ in names(chosen)} == {"Dual Packaged App", "Windows Terminal"}
    with pytest.raises(ValueError):
        select_source(rows, "nope")


def test_filters_and_counters(spark):
    rows = fleet(
        spark,
        [
            entry("App", 0), entry("app", 1), entry("Sys", 2, system_component=True),
            entry("KB123", 3), entry("KB9", 4, system_component=True), entry("  ", 5),
            entry("Other", 6, publisher="Findme"), entry("x", 7, version="FINDME 2"),
        ],
    )
    empty = spark.createDataFrame([("h1", "s1"), ("h9", "s1")], "host string, snapshot_id string")
    stats = {r.host: tuple(r)[2:] for r in prepare_stats(rows, empty).collect()}
    assert stats == {"h1": (8, 1, 2, 1, 3), "h9": (0, 0, 0, 0, 0)}
    with_system = prepare_stats(rows, include_system_components=True).first()
    assert with_system[2:] == (8, 1, 0, 2, 4)
    assert {n for n, *_ in names(prepare(rows, search=" findME "))} == {"Other", "x"}
    assert prepare(rows, search="  ").count() == 3
    everything = prepare(rows, include_system_components=True, include_updates=True)
    assert everything.count() == 6


def test_hidden_row_still_shadows(spark):
    rows = fleet(
        spark, [entry("App", 0, system_component=True), entry("App", 1, source="appx", version="2")]
    )
    assert prepare(rows).count() == 0


def test_report_order(spark):
    rows = fleet(
        spark,
        [entry("b", 0, registry_path="2"), entry("A", 1), entry("B", 2, registry_path="1", version="3"),
         entry("Éa", 3), entry("zz", 4)],
    )
    assert [n for n, *_ in names(in_report_order(prepare(rows)))] == ["A", "B", "b", "zz", "Éa"]


def test_sliced_groups_equal_whole_groups(spark):
    rng = random.Random(1)
    # A hot group, a group without a name, and values that are missing.
    data = [
        (
            None if i % 11 == 0 else "hot" if rng.random() < 0.7 else f"g{i % 9}",
            i,
            rng.randrange(50) if i % 3 else None,
            -i if i > 200 else None,
        )
        for i in range(400)
    ]
    df = spark.createDataFrame(data, "g string, o long, v long, w long").repartition(3)
    totals = {"total": ("sum", F.col("v")), "top": ("max", F.col("w"))}
    expected, sums, tops = [], {}, {}
    for g, o, v, w in data:
        if v is not None:
            sums[g] = sums.get(g, 0) + v
        if w is not None:
            tops[g] = max(tops.get(g, w), w)
        expected.append((g, o, v, w, sums.get(g), tops.get(g)))
    for slices in (None, F.floor(F.col("o") / 7)):
        got = map(tuple, running(df, ["g"], ["o"], totals, slices).collect())
        assert sorted(got, key=str) == sorted(expected, key=str)
    assert numbered(df, ["g"], ["o"], "n").filter("g = 'hot'").agg(F.max("n")).first()[0] == sum(
        1 for g, *_ in data if g == "hot"
    )


def test_plans_join_by_keys_and_scan_once(spark, tmp_path):
    fleet(spark, MIXED).write.parquet(str(tmp_path / "rows"))
    df = prepare(spark.read.parquet(str(tmp_path / "rows")))
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    assert plan.count("FileScan") == 1


def test_one_read_before_any_reuse(spark, tmp_path):
    fleet(spark, MIXED).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    for df in (prepare(rows), prepare_stats(rows)):
        assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1


def test_rows_without_position_or_host_survive(spark):
    rows = [entry("App", None), entry("App", 1, version="2"), entry("Other", 2, host=None)]
    df = fleet(spark, rows)
    assert sorted(n for n, *_ in names(prepare(df))) == ["App", "App", "Other"]
    counts = {r.host: (r.raw_entry_count, r.deduplicated_count) for r in prepare_stats(df).collect()}
    assert sum(raw for raw, _ in counts.values()) == 3
    assert all(gone == 0 for _, gone in counts.values())
    assert None in counts and "" not in counts


def test_dedupe_shuffles_no_field_twice(spark):
    """The order of the copies and their fields are one value."""
    rows = fleet(spark, [entry("App", 1), entry("app", 2, registry_path="a")])
    plan = deduplicate(rows)._jdf.queryExecution().executedPlan().toString()
    assert "min_by" not in plan and "min(" in plan
    assert [r.registry_path for r in deduplicate(rows).collect()] == ["a"]
