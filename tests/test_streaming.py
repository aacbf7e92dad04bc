import json

import pytest
from pyspark.sql import functions as F

from appcensus.operators.commits import CommitLog
from appcensus.plans.history import consecutive_diff, snapshots_of
from appcensus.plans.prepare import prepare
from appcensus.sources.files import read_texts
from appcensus.sources.snapshots import (
    parse_snapshots,
    snapshot_entries,
    snapshot_status,
    snapshot_table,
    unique_snapshots,
)
from appcensus.streaming import intake
from appcensus.streaming.intake import (
    current_diffs,
    latest_rows,
    rejected_files,
    run_intake,
    stored_diffs,
    stored_rows,
    stored_snapshots,
    take_in,
)


def write(folder, name, host, day, apps):
    rows = [{"name": n, "version": v, "publisher": "P"} for n, v in apps]
    body = {
        "schema_version": "1.2",
        "scan": {"hostname": host, "started_at": f"2026-01-{day:02d}T00:00:00Z"},
        "software": rows,
    }
    (folder / name).write_text(json.dumps(body), encoding="utf-8")


def statuses(df):
    return sorted(
        tuple(r)
        for r in df.select("host", "old_snapshot_id", "snapshot_id", "name", "status").collect()
    )


LATE = [
    ("a", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "X", "removed"),
    ("a", "2026-01-01T00:00:00Z", "2026-01-02T00:00:00Z", "Y", "changed"),
    ("a", "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z", "X", "added"),
    ("a", "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z", "Y", "removed"),
    ("a", "2026-01-02T00:00:00Z", "2026-01-03T00:00:00Z", "Z", "added"),
]


def batch_diffs(spark, inbox):
    """What a batch job over all files gives."""
    table = unique_snapshots(snapshot_table(parse_snapshots(read_texts(spark, str(inbox)))))
    rows = prepare(snapshot_entries(table))
    return consecutive_diff(rows, snapshots=table.select("host", "snapshot_id", "scan_ts"))


def test_intake_equals_batch(spark, tmp_path):
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()

    def run():
        run_intake(spark, str(inbox), store, str(tmp_path / "offsets"))

    write(inbox, "a1.json", "a", 1, [("X", "1"), ("Y", "1")])
    write(inbox, "b1.json", "b", 1, [("X", "1")])
    (inbox / "broken.json").write_text("{", encoding="utf-8")
    run()
    write(inbox, "a3.json", "a", 3, [("X", "2"), ("Z", "1")])
    write(inbox, "b2.json", "b", 2, [])
    write(inbox, "again.json", "a", 1, [("other", "1")])
    run()
    assert stored_snapshots(spark, store).count() == 4
    assert sorted(r.status for r in rejected_files(spark, store).collect()) == ["bad", "repeated"]
    assert statuses(current_diffs(spark, store)) == statuses(batch_diffs(spark, inbox))
    assert {s[-1] for s in statuses(batch_diffs(spark, inbox))} == {"added", "removed", "changed"}

    # A late snapshot meets its own predecessor and does not become the latest.
    write(inbox, "a2.json", "a", 2, [("Y", "5")])
    run()
    late = stored_diffs(spark, store).filter("batch = 3")
    assert statuses(late) == LATE
    assert statuses(current_diffs(spark, store)) == statuses(batch_diffs(spark, inbox))
    assert {(r.host, r.name) for r in latest_rows(spark, store).collect()} == {("a", "X"), ("a", "Z")}

    # A replayed batch changes nothing.
    before = sorted(map(str, stored_rows(spark, store).collect()))
    replay = read_texts(spark, str(inbox)).filter(F.col("path").contains("a2.json"))
    take_in(replay, store)
    assert sorted(map(str, stored_rows(spark, store).collect())) == before
    assert statuses(stored_diffs(spark, store).filter("batch = 3")) == LATE
    assert CommitLog(spark, store).last() == 3

    # A new checkpoint sends all files again: nothing is lost, and nothing comes twice.
    write(inbox, "b3.json", "b", 3, [("W", "1")])
    run_intake(spark, str(inbox), store, str(tmp_path / "offsets2"))
    assert {r.path.rpartition("/")[2] for r in stored_snapshots(spark, store).collect()} == {
        "a1.json", "a2.json", "a3.json", "b1.json", "b2.json", "b3.json"
    }
    assert stored_rows(spark, store).count() == len(before) + 1
    assert sorted(r.status for r in rejected_files(spark, store).collect()) == ["bad", "repeated"]
    assert statuses(current_diffs(spark, store)) == statuses(batch_diffs(spark, inbox))


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    store, days = str(tmp_path / "store"), []
    for day in (1, 2):
        inbox = tmp_path / f"inbox{day}"
        inbox.mkdir()
        write(inbox, "a.json", "a", day, [("X", str(day))])
        run_intake(spark, str(inbox), store, str(tmp_path / f"offsets{day}"))
        days.append(f"2026-01-0{day}T00:00:00Z")
        assert {r.snapshot_id for r in stored_rows(spark, store).collect()} == set(days)
    assert statuses(current_diffs(spark, store)) == [("a", *days, "X", "changed")]


def test_a_batch_that_dies_shows_nothing(spark, tmp_path, monkeypatch):
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    write(inbox, "a1.json", "a", 1, [("X", "1")])
    take_in(read_texts(spark, str(inbox)), store)
    write(inbox, "a2.json", "a", 2, [("X", "2")])
    texts = read_texts(spark, str(inbox)).filter(F.col("path").contains("a2.json"))

    def die(*args, **options):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(intake, "consecutive_diff", die)
        with pytest.raises(RuntimeError):
            take_in(texts, store)
    with monkeypatch.context() as broken:
        broken.setattr(CommitLog, "commit", die)
        with pytest.raises(RuntimeError):
            take_in(texts, store)
    # All five tables of the batch are there, and none of it counts.
    assert spark.read.parquet(f"{store}/rows").count() == 3
    assert stored_snapshots(spark, store).count() == stored_rows(spark, store).count() == 1
    assert current_diffs(spark, store).count() == rejected_files(spark, store).count() == 0
    take_in(texts, store)
    assert stored_rows(spark, store).count() == 2 and current_diffs(spark, store).count() == 1


def test_commits_of_two_writers(spark, tmp_path):
    log = CommitLog(spark, str(tmp_path))
    assert log.last() == 0 and log.listed().count() == 0 and not log.has("x")
    log.commit(1, "x", "c1")
    with pytest.raises(Exception, match="already exists"):
        log.commit(1, "y", "c2")
    assert log.last() == 1 and log.has("x") and not log.has("y")
    assert [r.folder for r in log.listed().collect()] == ["c1"]


def test_repeated_snapshot_in_one_batch(spark, tmp_path):
    inbox, store = tmp_path / "inbox", str(tmp_path / "store")
    inbox.mkdir()
    write(inbox, "b.json", "a", 1, [("X", "1")])
    write(inbox, "a.json", "a", 1, [("Y", "1")])
    texts = read_texts(spark, str(inbox))
    status = {r.path.rpartition("/")[2]: r.status for r in snapshot_status(parse_snapshots(texts)).collect()}
    assert status == {"a.json": "ok", "b.json": "repeated"}
    take_in(texts, store)
    assert [r.name for r in stored_rows(spark, store).collect()] == ["Y"]
    rejected = rejected_files(spark, store).collect()
    assert [(r.path.rpartition("/")[2], r.status) for r in rejected] == [("b.json", "repeated")]
    assert batch_diffs(spark, inbox).count() == 0


def test_snapshots_of_counts_rows_only(spark, tmp_path):
    write(tmp_path, "a.json", "a", 1, [("X", "1")])
    write(tmp_path, "b.json", "b", 1, [])
    table = snapshot_table(parse_snapshots(read_texts(spark, str(tmp_path))))
    assert table.count() == 2
    assert snapshots_of(snapshot_entries(table)).count() == 1
