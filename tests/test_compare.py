import random

from pyspark.sql import functions as F

from appcensus.operators import diff as D
from appcensus.plans import history as H
from tests.rows import entry, fleet

FIELDS = D.COMPARED_FIELDS


# The values the random rows are made of, and what tells applications apart, by hand.
NAMES = {"App": "app", "app": "app", "Tool ": "tool", "Kit": "kit"}
PUBLISHERS = {"P": "p", "p": "p", None: ""}
PLACES = {None: "", "C:\\X": "c:\\x", "C:\\x\\": "c:\\x"}
PACKAGES = {"appx:F": "appx:f", "appx:G": "appx:g"}


def label(row):
    """The application a random row is of; packages are known by their path."""
    if row["source"] == "appx" and row["registry_path"] in PACKAGES:
        return PACKAGES[row["registry_path"]], "", row["architecture"]
    return NAMES[row["name"]], PUBLISHERS[row["publisher"]], PLACES[row["install_location"]]


def index(rows):
    """The row with most of its optional values given stands for its application."""
    best = {}
    missing = lambda r: sum(r[f] is None for f in ("version", "publisher", "install_location", "estimated_size_kb"))
    for row in sorted(rows, key=lambda r: (missing(r), r["registry_path"], r["ord"])):
        best.setdefault(label(row), row)
    return best


def expected_diff(old_rows, new_rows):
    old, new = index(old_rows), index(new_rows)
    out = {}
    for key in set(old) | set(new):
        if key not in old:
            out[key] = ("added", ())
        elif key not in new:
            out[key] = ("removed", ())
        else:
            changed = tuple(f for f in FIELDS if old[key][f] != new[key][f])
            out[key] = ("changed" if changed else "unchanged", changed)
    return out


def got_diff(df):
    return {
        (r.identity_1, r.identity_2, r.identity_3): (r.status, tuple(c.field for c in r.changes or ()))
        for r in df.collect()
    }


def random_rows(rng, size, host="h1", snapshot="s1"):
    return [
        entry(
            rng.choice(["App", "app", "Tool ", "Kit"]), i, host=host, snapshot_id=snapshot,
            version=rng.choice(["1", "2", None]), publisher=rng.choice(["P", "p", None]),
            install_location=rng.choice([None, "C:\\X", "C:\\x\\"]),
            estimated_size_kb=rng.choice([None, 0, 5]),
            source=rng.choice(["registry", "appx"]),
            registry_path=rng.choice(["appx:F", "appx:G", f"k{i % 3}"]),
            architecture=rng.choice(["64-bit", "32-bit"]),
        )
        for i in range(size)
    ]


def test_compare_same_as_loop(spark):
    rng = random.Random(9)
    old, new = random_rows(rng, 25), random_rows(rng, 25)
    df = D.compare(fleet(spark, old), fleet(spark, new))
    expected = expected_diff(old, new)
    assert got_diff(df) == expected
    assert {s for s, _ in expected.values()} >= {"added", "changed"}
    counts = D.diff_summary(df, []).first().asDict()
    assert counts == {s: sum(v[0] == s for v in expected.values()) for s in D.STATUSES}


def test_known_pair(spark):
    old = [entry("Keep", 0), entry("Upgrade", 1), entry("Gone", 2, version="4"), entry("日本", 3)]
    new = [
        entry("Keep", 0, registry_path="elsewhere", source="other"),
        entry("Upgrade", 1, version="2.0", install_date="2026-01-01", estimated_size_kb=5),
        entry("New Tool", 2), entry("日本", 3),
    ]
    df = D.compare(fleet(spark, old), fleet(spark, new), ["host"])
    assert D.diff_summary(df, ["host"]).first()[1:] == (1, 1, 1, 2)
    changes = D.exploded_changes(df, ["host"]).select("field", "old", "new").collect()
    assert [tuple(c) for c in changes] == [
        ("version", "1.0", "2.0"), ("install_date", None, "2026-01-01"), ("estimated_size_kb", None, "5"),
    ]
    assert [r.name for r in D.added(df, ["host"]).collect()] == ["New Tool"]
    assert [r.name for r in D.removed(df, ["host"]).collect()] == ["Gone"]


def test_consecutive_pairs_and_empty_snapshots(spark):
    rng = random.Random(4)
    rows = {s: random_rows(rng, 8, snapshot=s) for s in ("s1", "s2", "s4")}
    other = random_rows(rng, 5, host="h2", snapshot="s1")
    everything = fleet(spark, [r for part in rows.values() for r in part] + other)
    snapshots = spark.createDataFrame(
        [("h1", f"s{n}", n) for n in (1, 2, 3, 4)] + [("h2", "s1", 1)],
        "host string, snapshot_id string, n int",
    ).withColumn("scan_ts", F.timestamp_seconds("n")).drop("n")
    df = H.consecutive_diff(everything, snapshots=snapshots)
    rows["s3"] = []
    for old, new in (("s1", "s2"), ("s2", "s3"), ("s3", "s4")):
        pair = df.filter((F.col("old_snapshot_id") == old) & (F.col("snapshot_id") == new))
        assert got_diff(pair) == expected_diff(rows[old], rows[new])
    assert df.filter("host = 'h2'").isEmpty()
    pairs = H.previous_snapshots(snapshots)
    assert sorted(map(tuple, pairs.collect())) == [
        ("h1", "s1", "s2"), ("h1", "s2", "s3"), ("h1", "s3", "s4"),
    ]
    latest = H.latest_inventory(everything, snapshots)
    assert {(r.host, r.snapshot_id) for r in latest.collect()} == {("h1", "s4"), ("h2", "s1")}


def test_statuses_are_those_of_the_diff(spark):
    rng = random.Random(11)
    old = random_rows(rng, 30) + random_rows(rng, 9, host="h2")
    new = random_rows(rng, 30) + random_rows(rng, 9, host="h2")
    # Nulls, blanks and texts that run together when they are only joined.
    old += [entry("N", 90, version="1", publisher=None), entry("J", 91, version="1:2", release_type="3")]
    new += [entry("N", 90, version="", publisher=None), entry("J", 91, version="1", release_type="2:3")]
    old, new = old + [entry("Same", 92)], new + [entry("Same", 92)]
    full = D.compare(fleet(spark, old), fleet(spark, new), ["host"])
    short = D.compare_statuses(fleet(spark, old), fleet(spark, new), ["host"])
    kept = full.select(*short.columns)
    assert sorted(map(str, short.collect())) == sorted(map(str, kept.collect()))
    assert {r.status for r in short.collect()} == set(D.STATUSES)

    rows = fleet(spark, random_rows(rng, 30, snapshot="s1") + random_rows(rng, 30, snapshot="s2"))
    rows = rows.withColumn("scan_ts", F.to_timestamp(F.replace("snapshot_id", F.lit("s"), F.lit("200"))))
    short = H.consecutive_statuses(rows)
    kept = H.consecutive_diff(rows).select(*short.columns)
    assert sorted(map(str, short.collect())) == sorted(map(str, kept.collect()))
    moved = H.side_statuses(D.narrowed(rows.withColumn("is_new", F.lit(True)), ["host", "is_new"]), ["host"])
    shuffled = moved._jdf.queryExecution().executedPlan().toString()
    assert "quiet_uninstall_string" not in shuffled.split("Exchange")[0]


def test_diff_takes_one_shuffle(spark, tmp_path):
    fleet(spark, [entry("A", 0)]).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    plan = D.compare(rows, rows, ["host"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
