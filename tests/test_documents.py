import json
from datetime import datetime

from pyspark.sql import functions as F

from appcensus.operators.diff import compare
from appcensus.plans import documents as P
from appcensus.plans.archive import History
from appcensus.plans import sinks
from appcensus.plans.prepare import prepare
from appcensus.schema import ENTRY_COLUMNS, SCAN_SCHEMA
from tests.rows import entry, fleet

GROUP = ["host", "snapshot_id"]


def joined(pieces, group, glue=""):
    texts = {}
    for row in P.in_order(pieces, group).collect():
        texts.setdefault(tuple(row[g] for g in group), []).append(row.piece)
    return {key: glue.join(parts) for key, parts in texts.items()}


def snapshots(spark):
    rows = [("h1", "s1"), ("h2", "s1")]
    return spark.createDataFrame(rows, "host string, snapshot_id string").selectExpr(
        "*", "timestamp'2026-07-17 06:00:00' started_at", "timestamp'2026-07-17 06:00:01' completed_at",
        "'Windows-10' platform",
    )


ROWS = [
    entry("beta \"x\"", 0, estimated_size_kb=1280, install_date="2026-01-01"),
    entry("Alpha 日本", 1, install_location="C:\\Apps\\", version=None),
    entry("alpha 日本", 2, version="2"),
]


def test_reports(spark):
    rows = fleet(spark, ROWS)
    labels = spark.createDataFrame(
        [("h1", "s1", ["one", "two"])], "host string, snapshot_id string, collector_sources array<string>"
    )
    scans = P.scan_metadata(rows, snapshots(spark), labels)
    compact = joined(P.report_pieces(prepare(rows), scans), GROUP)
    pretty = joined(P.report_pieces(prepare(rows), scans, pretty=True), GROUP)
    arrays = joined(P.report_pieces(prepare(rows), scans, array_only=True), GROUP)
    pretty_arrays = joined(P.report_pieces(prepare(rows), scans, True, True), GROUP)
    for key, text in compact.items():
        body = json.loads(text)
        # The text is what the standard library writes for the same value.
        assert text == json.dumps(body, separators=(",", ":"), ensure_ascii=False)
        assert pretty[key] == json.dumps(body, indent=2, ensure_ascii=False)
        assert arrays[key] == json.dumps(body["software"], separators=(",", ":"), ensure_ascii=False)
        assert pretty_arrays[key] == json.dumps(body["software"], indent=2, ensure_ascii=False)
        assert list(body) == ["schema_version", "scan", "software"]
        assert list(body["scan"]) == SCAN_SCHEMA.fieldNames()
    full = json.loads(compact["h1", "s1"])
    assert [r["name"] for r in full["software"]] == ["Alpha 日本", "alpha 日本", 'beta "x"']
    assert list(full["software"][0]) == list(ENTRY_COLUMNS)
    assert full["scan"]["duration_ms"] == 1000 and full["scan"]["result_count"] == 3
    assert full["scan"]["collector_sources"] == ["one", "two"]
    empty = json.loads(compact["h2", "s1"])
    assert empty["software"] == [] and empty["scan"]["raw_entry_count"] == 0


OLD = [entry("Keep", 0), entry("Up", 1, version="1"), entry("Gone", 2, publisher=None),
       entry("Sys", 3)]
NEW = [entry("Keep", 0), entry("Up", 1, version="2", install_location=None, estimated_size_kb=7),
       entry("Fresh", 2, version=None), entry("New", 4), entry("Sys", 3, system_component=True)]


def test_diff_documents(spark):
    df = compare(fleet(spark, OLD), fleet(spark, NEW), ["host"])
    body = json.loads(joined(P.diff_pieces(df, ["host"]), ["host"])["h1",])
    assert body["summary"] == {"added": 2, "removed": 1, "changed": 2, "unchanged": 1}
    assert [r["name"] for r in body["added"]] == ["Fresh", "New"]
    assert [r["name"] for r in body["removed"]] == ["Gone"]
    system, up = body["changed"]
    assert (up["old_version"], up["new_version"]) == ("1", "2")
    assert up["changes"] == [
        {"field": "version", "old": "1", "new": "2"},
        {"field": "estimated_size_kb", "old": None, "new": 7},
    ]
    assert system["changes"] == [{"field": "system_component", "old": False, "new": True}]
    assert list(up) == ["name", "old_version", "new_version", "changes", "old", "new"]
    text = joined(P.diff_lines(df, ["host"]), ["host"], "\n")["h1",]
    assert text == "\n".join([
        "Inventory Diff Summary", "======================",
        "Added:      2", "Removed:    1", "Changed:    2", "Unchanged:  1", "",
        "Added", "-----", "  + Fresh (?) — Acme", "  + New (1.0) — Acme", "",
        "Removed", "-------", "  - Gone (1.0) — ?", "",
        "Changed", "-------", "  ~ Sys: 1.0 → 1.0", "      system_component: False → True",
        "  ~ Up: 1 → 2", "      version: '1' → '2'", "      estimated_size_kb: None → 7",
    ])


def test_diff_of_equal_and_empty_snapshots(spark):
    same = compare(fleet(spark, OLD), fleet(spark, OLD), ["host"])
    text = joined(P.diff_lines(same, ["host"]), ["host"], "\n")["h1",]
    assert text.endswith("Unchanged:  4\n\n(no differences)")
    pairs = spark.createDataFrame([("h1",), ("h7",)], "host string")
    bodies = joined(P.diff_pieces(same, ["host"], pairs), ["host"])
    assert json.loads(bodies["h7",]) == {
        "summary": {"added": 0, "removed": 0, "changed": 0, "unchanged": 0},
        "added": [], "removed": [], "changed": [],
    }


def matches(spark):
    rows = [
        entry("B app", 0) | {"position": 1, "package_id": "V.B", "package_version": None},
        entry("C|app", 1) | {"position": 2, "package_id": None, "package_version": None},
        entry("D app", 2) | {"position": 3, "package_id": "V.D", "package_version": "9"},
        entry("only", 3, host="h2") | {"position": 1, "package_id": None, "package_version": None},
        entry("all", 4, host="h3") | {"position": 1, "package_id": "V.A", "package_version": "1"},
    ]
    columns = ["host", "snapshot_id", "name", "version", "publisher", "install_location", "position",
               "package_id", "package_version"]
    kinds = "host string, snapshot_id string, name string, version string, publisher string," \
        " install_location string, position long, package_id string, package_version string"
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], kinds)


def test_import_documents(spark):
    stamp = F.lit("2026-09-24 05:00:00").cast("timestamp")
    plain = joined(P.import_pieces(matches(spark), stamp), GROUP)
    body = json.loads(plain["h1", "s1"])
    assert list(body) == ["$schema", "CreationDate", "Sources"]
    assert body["CreationDate"] == "2026-09-24T05:00:00.000-00:00"
    assert body["Sources"][0]["SourceDetails"]["Name"] == "winget"
    assert body["Sources"][0]["Packages"] == [
        {"PackageIdentifier": "V.B"}, {"PackageIdentifier": "V.D"},
    ]
    assert json.loads(plain["h2", "s1"])["Sources"] == []
    pinned = joined(P.import_pieces(matches(spark), stamp, True, "1.9"), GROUP)
    body = json.loads(pinned["h1", "s1"])
    assert body["WinGetVersion"] == "1.9"
    assert [p["Version"] for p in body["Sources"][0]["Packages"]] == ["1.0", "9"]


def test_checklists(spark):
    texts = joined(P.checklist_lines(matches(spark)), GROUP, "\n")
    lines = texts["h1", "s1"].split("\n")
    assert lines[2] == "Matched to winget: **2** - Unmatched: **1**"
    assert lines[-1] == "| [ ] | C\\|app | 1.0 | Acme |  |"
    assert texts["h3", "s1"].endswith("_All inventory rows matched an importable winget package._")


def test_table_lines(spark):
    rows = prepare(fleet(spark, ROWS))
    texts = joined(P.table_lines(rows, snapshots(spark)), GROUP, "\n")
    lines = texts["h1", "s1"].split("\n")
    assert lines[0].split() == ["Name", "Version", "Publisher", "Scope", "Architecture", "Install",
                                "Date", "Size", "Source"]
    assert lines[1].startswith("-" * 36 + "  " + "-" * 14) and len(lines) == 5
    assert "1.2 MB" in lines[4] and lines[4].endswith("registry")
    assert texts["h2", "s1"].split("\n")[2:] == ["(no matching software entries)"]


def test_indented_documents(spark):
    old = fleet(spark, [entry("Keep", 0), entry("Gone \"q\"", 1), entry("Up", 2, version="1")])
    new = fleet(spark, [entry("Keep", 0), entry("Up", 2, version="2", publisher=None)])
    for a, b in ((old, new), (new, new), (new, old)):
        diff = compare(a, b, ["host"])
        compact = joined(P.diff_pieces(diff, ["host"]), ["host"])
        pretty = joined(P.diff_pieces(diff, ["host"], pretty=True), ["host"])
        for key, text in compact.items():
            assert pretty[key] == json.dumps(json.loads(text), indent=2, ensure_ascii=False)

    matches = spark.createDataFrame(
        [("h1", "s1", 1, "A", "1", "I.A", "2"), ("h1", "s1", 2, "B", "3", "I.B", ""),
         ("h1", "s1", 3, "C", "", "I.C", ""), ("h2", "s1", 1, "D", "1", None, None)],
        "host string, snapshot_id string, position long, name string, version string,"
        " package_id string, package_version string",
    )
    stamp = F.lit("2026-07-17 06:00:00").cast("timestamp")
    for options in ({}, {"include_versions": True, "tool_version": "1.9"}):
        compact = joined(P.import_pieces(matches, stamp, **options), GROUP)
        pretty = joined(P.import_pieces(matches, stamp, pretty=True, **options), GROUP)
        assert len(compact) == 2
        for key, text in compact.items():
            assert pretty[key] == json.dumps(json.loads(text), indent=2, ensure_ascii=False)
    packages = json.loads(compact["h1", "s1"])["Sources"][0]["Packages"]
    assert [p.get("Version") for p in packages] == ["2", "3", None]


def test_sinks(spark, tmp_path):
    rows = fleet(spark, ROWS)
    prepared = prepare(rows)
    scans = P.scan_metadata(rows, snapshots(spark))
    out = tmp_path / "reports"
    sinks.write_documents(P.report_pieces(prepared, scans), GROUP, str(out), parts=3)
    folder = out / "of_host=is h1" / "of_snapshot_id=is s1"
    text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
    assert len(json.loads(text)["software"]) == 3

    sinks.write_csv(prepared, str(tmp_path / "csv"))
    lines = [line for p in sorted((tmp_path / "csv").glob("part-*"))
             for line in p.read_text(encoding="utf-8").splitlines()]
    assert lines[0] == ",".join([*GROUP, *ENTRY_COLUMNS])
    assert any(line.startswith('h1,s1,"beta ""x""",1.0,Acme,2026-01-01,,1280,') for line in lines)
    assert all(line.endswith(",False,registry") for line in lines if "," in line and "name" not in line)

    sinks.write_rows_json(prepared, str(tmp_path / "json"))
    stored = [json.loads(line) for p in (tmp_path / "json").glob("part-*")
              for line in p.read_text(encoding="utf-8").splitlines()]
    assert len(stored) == 3 and all(set(ENTRY_COLUMNS) <= set(r) for r in stored)

    sinks.write_csv_per_snapshot(prepared, str(tmp_path / "csvs"))
    files = list((tmp_path / "csvs" / "of_host=is h1" / "of_snapshot_id=is s1").glob("part-*"))
    assert files and files[0].read_text(encoding="utf-8").startswith(",".join(ENTRY_COLUMNS) + "\n")

    # A history that is written twice holds every row once.
    dated = prepare(rows.withColumn("scan_ts", F.lit("2026-07-17 06:00:00").cast("timestamp")))
    for _ in range(2):
        sinks.write_history(dated, str(tmp_path / "history"))
    assert History(spark, str(tmp_path / "history")).rows().count() == prepared.count()


def test_documents_of_all_hosts_stay_apart(spark, tmp_path):
    hosts = ["日本", "中国", "a b", "a_b", "a/b", "", None, "null", "is null"]
    rows = fleet(spark, [entry(f"App {i}", i, host=host) for i, host in enumerate(hosts)])
    pieces = P.report_pieces(prepare(rows), P.scan_metadata(rows, spark.createDataFrame(
        [(h, "s1", datetime(2026, 7, 17), datetime(2026, 7, 17), "win") for h in hosts if h is not None],
        "host string, snapshot_id string, started_at timestamp, completed_at timestamp, platform string",
    )))
    pieces = pieces.filter("host is not null")
    out = tmp_path / "reports"
    sinks.write_documents(pieces, GROUP, str(out), parts=3)
    found = set()
    for folder in out.glob("of_host=*/of_snapshot_id=*"):
        text = "".join(p.read_text(encoding="utf-8") for p in sorted(folder.glob("part-*")))
        document = json.loads(text)
        found.add((document["scan"]["hostname"], document["software"][0]["name"]))
    assert found == {(host, f"App {i}") for i, host in enumerate(hosts) if host is not None}
    sinks.write_document_rows(pieces, GROUP, str(tmp_path / "few"), parts=2)
    stored = spark.read.parquet(str(tmp_path / "few"))
    assert stored.count() == pieces.count() and len(stored.inputFiles()) <= 2
