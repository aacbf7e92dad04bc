"""Pairs of snapshots over days."""

import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from appcensus.operators.commits import CommitLog
from appcensus.plans.archive import History
from appcensus.plans.history import previous_snapshots
from appcensus.plans.sinks import write_history
from tests.rows import entry, fleet


def test_previous_snapshots(spark):
    rng = random.Random(8)
    begin = datetime(2026, 1, 1)
    rows = [("hot", f"s{k}", begin + timedelta(hours=rng.randrange(24 * 9))) for k in range(150)]
    rows += [(f"h{k % 7}", f"s{k}", begin + timedelta(days=rng.randrange(400))) for k in range(60)]
    rows += [(None, "a", begin), (None, "b", begin), ("late", "x", None), ("late", "y", begin), ("late", "z", None)]
    expected = Counter()
    for host in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == host), key=lambda r: (r[2] is not None, r[2] or begin, r[1]))
        expected.update((host, old[1], new[1]) for old, new in zip(mine, mine[1:]))
    df = spark.createDataFrame(rows, "host string, snapshot_id string, scan_ts timestamp").repartition(3)
    assert Counter(map(tuple, previous_snapshots(df).collect())) == expected


def test_a_hot_host_is_many_groups(spark):
    df = spark.createDataFrame([], "host string, snapshot_id string, scan_ts timestamp")
    plan = previous_snapshots(df)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window [" in line]
    # Scans are ordered within a host and day; over a whole host only one row per day is.
    assert len(windows) == 2 and sum("_day" in line.split("], [")[1] for line in windows) == 1


# The merged history


def scan(spark, host, snapshot_id, time, names):
    rows = fleet(spark, [entry(n, i, host=host, snapshot_id=snapshot_id) for i, n in enumerate(names)])
    return rows.withColumn("scan_ts", F.lit(time).cast("timestamp"))


def kept(spark, path):
    return Counter((r.host, r.snapshot_id, r.name) for r in History(spark, path).rows().collect())


def files_read(df):
    return df.inputFiles()


def test_two_scans_of_a_day_stay(spark, tmp_path):
    path = str(tmp_path / "history")
    assert History(spark, path).rows().count() == 0
    write_history(scan(spark, "a", "s1", "2026-01-01 01:00:00", ["X", "Y"]), path)
    write_history(scan(spark, "a", "s5", "2026-01-01 05:00:00", ["X"]), path)
    write_history(scan(spark, "b", "s1", "2026-01-01 01:00:00", ["X"]), path)
    write_history(scan(spark, None, None, None, ["N"]), path)
    every = Counter([("a", "s1", "X"), ("a", "s1", "Y"), ("a", "s5", "X"), ("b", "s1", "X"), (None, None, "N")])
    assert kept(spark, path) == every
    # What comes again replaces itself, also where it has fewer rows, or none.
    write_history(scan(spark, None, None, None, ["N"]), path)
    write_history(scan(spark, "a", "s1", "2026-01-01 01:00:00", ["Z"]), path)
    every = every - Counter([("a", "s1", "X"), ("a", "s1", "Y")]) + Counter([("a", "s1", "Z")])
    assert kept(spark, path) == every
    none = scan(spark, "a", "s5", "2026-01-01 05:00:00", ["X"])
    write_history(none.limit(0), path, none.select("host", "snapshot_id", "scan_ts"))
    assert kept(spark, path) == every - Counter([("a", "s5", "X")])


def test_files_of_a_day_are_bounded(spark, tmp_path):
    path = str(tmp_path / "history")
    rows = fleet(spark, [entry("X", k, host="hot" if k % 3 else f"h{k}", snapshot_id=f"s{k}") for k in range(300)])
    rows = rows.withColumn("scan_ts", F.lit("2026-01-01 01:00:00").cast("timestamp")).repartition(7)
    store = History(spark, path, buckets=4)
    for part in (0, 1, 2, 1):
        store.merge(rows.filter(F.col("ord") % 3 == part))
    assert kept(spark, path) == Counter((r.host, r.snapshot_id, "X") for r in rows.collect())
    again = History(spark, path, buckets=99)  # the store knows its buckets
    assert again.buckets == 4
    again.clean()
    assert len(files_read(spark.read.parquet(f"{path}/rows"))) == 4
    assert kept(spark, path) == Counter((r.host, r.snapshot_id, "X") for r in rows.collect())
    sizes = spark.read.parquet(f"{path}/rows").groupBy("bucket").count().collect()
    assert max(r["count"] for r in sizes) < 150  # the hot host is in all buckets


def test_a_merge_that_dies_changes_nothing(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "history")
    write_history(scan(spark, "a", "s1", "2026-01-01 01:00:00", ["X"]), path)

    def die(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(CommitLog, "commit", die)
        with pytest.raises(RuntimeError):
            write_history(scan(spark, "a", "s1", "2026-01-01 01:00:00", ["Y"]), path)
    assert kept(spark, path) == Counter([("a", "s1", "X")])


def test_replaced_folders_are_not_read(spark, tmp_path):
    path = str(tmp_path / "history")
    for k in range(2):
        write_history(scan(spark, "a", "s1", "2026-01-01 01:00:00", ["X"]), path)
    plan = History(spark, path).rows()._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan


def test_history_query_prepares_its_rows_once(spark, monkeypatch):
    from workload import queries

    rows = [(entry(f"App {year}", year), datetime(year, 1, 1)) for year in (1993, 1994, 1996, 1999)]
    frame = fleet(spark, [row for row, _ in rows])
    times = spark.createDataFrame([(row["ord"], time) for row, time in rows], "ord bigint, scan_ts timestamp")
    frame = frame.join(times, "ord")
    merged = []
    merge = History.merge
    monkeypatch.setattr(queries.views, "fleet", lambda spark, sf: frame)
    monkeypatch.setattr(History, "merge", lambda self, part: (merged.append(part), merge(self, part)))
    assert queries.history_merge(spark, "none").count() == 4
    assert len(merged) == 3
    for part in merged:
        plan = part._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate" not in plan and "Join" not in plan
