import json

import pytest
from pyspark.sql import functions as F

from appcensus.sources import catalog as C
from appcensus.sources import packaged as P
from appcensus.sources import registry as R
from appcensus.sources.catalog_files import (
    catalog_file_packages,
    catalog_file_status,
    read_catalog_items,
)
from appcensus.sources.collect import collect, collector_sources
from appcensus.sources.files import CaptureError, quarantine, read_texts, require_all
from appcensus.sources.listing_files import (
    listing_file_packages,
    listing_file_status,
    read_listing_lines,
)
from appcensus.sources.snapshots import parse_snapshots, snapshot_entries, snapshot_status, snapshot_table
from appcensus.sources.variants import is_array, is_object


def texts(spark, files):
    return spark.createDataFrame(list(files.items()), "path string, text string")


def report(rows, version="1.2", **scan):
    return json.dumps({"schema_version": version, "scan": scan, "software": rows})


def test_snapshot_files(spark, tmp_path):
    row = {
        "name": " Keep App ",
        "version": 3,
        "estimated_size_kb": "1_000",
        "system_component": "Yes",
        "source": "APPX",
    }
    (tmp_path / "a.json").write_text(
        "\ufeff" + report([row, 5, {"name": "B", "estimated_size_kb": -7, "system_component": 2}],
                          hostname="pc1", started_at="2026-07-17T06:00:00Z"),
        encoding="utf-8",
    )
    (tmp_path / "b.json").write_text(json.dumps([{"name": "アプリ"}]), encoding="utf-8")
    parsed = parse_snapshots(read_texts(spark, str(tmp_path)))
    require_all(parsed)
    rows = {r.name: r for r in snapshot_entries(snapshot_table(parsed)).collect()}
    assert set(rows) == {"Keep App", "B", "アプリ"}
    keep = rows["Keep App"]
    assert (keep.host, keep.snapshot_id) == ("pc1", "2026-07-17T06:00:00Z")
    assert keep.scan_ts.year == 2026
    assert (keep.version, keep.estimated_size_kb, keep.system_component) == ("3", 1000, True)
    assert (keep.source, keep.scope, keep.registry_path, keep.ord) == ("appx", "unknown", "", 0)
    assert rows["B"].estimated_size_kb == -7 and rows["B"].system_component
    assert rows["B"].ord == 2
    assert rows["アプリ"].host.endswith("b.json")
    assert rows["アプリ"].source == "registry" and not rows["アプリ"].system_component


@pytest.mark.parametrize(
    "value,expected",
    [(12.7, 12), (" 12 ", 12), (True, 1), ("", None), (None, None), (0, 0), ("-3", -3)],
)
def test_snapshot_sizes(spark, value, expected):
    parsed = parse_snapshots(
        texts(spark, {"f": report([{"name": "A", "estimated_size_kb": value}])})
    )
    assert snapshot_entries(snapshot_table(parsed)).first().estimated_size_kb == expected


def test_bad_snapshots_are_set_aside_whole(spark):
    good = {"name": "A"}
    files = {
        "ok": report([good]),
        "empty": "[]",
        "json": "{nope",
        "json and more": report([good]) + " x",
        "json twice": "[] []",
        "json in two": "[],[]",
        "json early end": "[],0] [",
        "text": '"hello"',
        "no version": json.dumps({"software": [good]}),
        "version": report([good], version="9"),
        "number version": json.dumps({"schema_version": 1.2, "software": [good]}),
        "no list": json.dumps({"schema_version": "1.2", "software": {}}),
        "no name": report([good, {"version": "1"}]),
        "blank name": report([good, {"name": "  "}]),
        "number name": report([{"name": 5}]),
        "size": report([good, {"name": "B", "estimated_size_kb": "12.7"}]),
        "blank size": report([{"name": "B", "estimated_size_kb": " "}]),
        "list size": report([{"name": "B", "estimated_size_kb": [1]}]),
    }
    parsed = parse_snapshots(texts(spark, files))
    status = {r.path: r.status for r in parsed.collect()}
    assert {path for path, s in status.items() if s == "ok"} == {"ok", "empty"}
    assert quarantine(parsed).count() == len(files) - 2
    assert snapshot_entries(snapshot_table(parsed)).count() == 1
    assert snapshot_table(parsed).count() == 2
    with pytest.raises(CaptureError, match="blank name: a row has no name"):
        require_all(parsed)


PACKAGE = {
    "name": "Vendor.Terminal",
    "family": "Vendor.Terminal_8we",
    "full_name": "Vendor.Terminal_1.24",
    "display_name": "Terminal",
    "publisher_display_name": "Vendor Corporation",
    "publisher": "CN=Vendor, O=Vendor Org, C=US",
    "version": "1.24.0.0",
    "architecture": "X64",
    "install_location": "C:\\Apps\\Terminal",
    "installed_date": "2026-07-23T18:36:36.1877983+08:00",
    "is_framework": False,
    "is_resource": False,
    "is_bundle": False,
    "signature_kind": "Store",
}


def package_rows(spark, text):
    df = spark.createDataFrame([("h", "s", text)], "host string, snapshot_id string, text string")
    return P.package_entries(P.packages_of(P.parse_listings(df))).orderBy("ord").collect()


def test_packages(spark):
    variants = [
        PACKAGE,
        7,
        {**PACKAGE, "display_name": "ms-resource:App", "publisher_display_name": " "},
        {**PACKAGE, "is_resource": "yes"},
        {**PACKAGE, "name": None, "family": None},
        {**PACKAGE, "name": "", "display_name": "Only Family", "is_framework": True},
        {**PACKAGE, "display_name": None, "family": "", "signature_kind": "SYSTEM"},
        {**PACKAGE, "installed_date": "1601-01-01T00:00:00", "is_framework": 2, "architecture": "?"},
    ]
    rows = package_rows(spark, json.dumps(variants))
    assert [r.name for r in rows] == [
        "Terminal", "Vendor.Terminal", "Only Family", "Vendor.Terminal", "Terminal",
    ]
    assert rows[0].install_date == "2026-07-23" and rows[0].architecture == "64-bit"
    assert rows[0].registry_path == "appx:Vendor.Terminal_8we" and rows[0].source == "appx"
    assert rows[1].publisher == "Vendor Org"
    assert [r.system_component for r in rows] == [False, False, True, True, False]
    assert rows[3].registry_path == "appx:Vendor.Terminal"
    assert rows[4].install_date is None and rows[4].architecture == "unknown"


def test_package_listing_shapes(spark):
    assert len(package_rows(spark, " \ufeff" + json.dumps(PACKAGE))) == 1
    assert package_rows(spark, "  ") == []
    df = spark.createDataFrame(
        [("h", "s", "12"), ("h", "t", "{")], "host string, snapshot_id string, text string"
    )
    assert {r.status for r in P.parse_listings(df).collect()} == {"bad"}


def registry_values(spark):
    values = {"DisplayName": " App ", "InstallDate": "20260717", "EstimatedSize": "850",
              "SystemComponent": "2", "Publisher": " "}
    rows = [("h", "s", 1, "App", 0, k, v) for k, v in values.items()]
    rows.append(("h", "s", 0, "NoName", 0, "Publisher", "X"))
    return spark.createDataFrame(
        rows,
        "host string, snapshot_id string, view int, sub_name string, key_ord long,"
        " value_name string, value string",
    )


def test_registry_keys(spark):
    rows = R.registry_entries(R.gather_values(registry_values(spark))).collect()
    assert len(rows) == 1
    row = rows[0]
    assert (row.name, row.publisher, row.install_date) == ("App", None, "2026-07-17")
    assert (row.estimated_size_kb, row.system_component) == (850, True)
    assert (row.scope, row.architecture, row.source) == ("machine", "32-bit", "registry")
    assert row.registry_path == (
        "HKEY_LOCAL_MACHINE\\SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall\\App"
    )


def test_collect(spark):
    good = spark.createDataFrame(
        [("h", "s", json.dumps([PACKAGE])), ("bad", "s", "{")],
        "host string, snapshot_id string, text string",
    )
    rows = collect(registry_values(spark), good).orderBy("ord").collect()
    assert [(r.name, r.source) for r in rows] == [("App", "registry"), ("Terminal", "appx")]
    assert collect(registry_values(spark), good, "registry").count() == 1
    with pytest.raises(CaptureError):
        collect(None, good, "appx")
    with pytest.raises(ValueError, match="unknown source"):
        collect(None, good, "else")
    labels = {r.host: r.collector_sources for r in
              collector_sources(registry_values(spark), good).collect()}
    assert labels == {"h": [R.view_labels()[0], R.view_labels()[1], P.SOURCE_LABEL]}


def test_catalog_json(spark):
    rows = [
        {"name": " A ", "id": "V.A", "version": 2, "source": "winget"},
        {"name": "B", "id": "", "package_id": "V.B", "version": " "},
    ]
    files = {
        "list": json.dumps(rows),
        "object": json.dumps({"packages": rows[:1]}),
        "no id": json.dumps([{"name": "A"}]),
        "scalar row": json.dumps([1]),
        "zero name": json.dumps([{"name": 0, "id": "x"}]),
        "other": json.dumps({"a": 1}),
    }
    parsed = C.parse_catalogs(texts(spark, files))
    assert {r.path for r in parsed.collect() if r.status == "ok"} == {"list", "object"}
    got = [tuple(r) for r in C.catalog_packages(parsed).orderBy("path", "ord").collect()]
    assert got == [
        ("list", "A", "V.A", "2", "winget", 0),
        ("list", "B", "V.B", None, "", 1),
        ("object", "A", "V.A", "2", "winget", 0),
    ]


def test_text_listing(spark):
    head = "Name".ljust(12) + "Id".ljust(16) + "Version".ljust(10) + "Available".ljust(12) + "Source"
    def line(*cells):
        return "".join(c.ljust(w) for c, w in zip(cells, (12, 16, 10, 12, 8)))
    listing = "\r\n".join([
        "progress",
        head,
        "-" * 50,
        line("Keep App", "Con.Keep", "1.0.0", "", "winget"),
        line("Canva", "ARP\\User\\abc", "1.2.3", "", ""),
        "  noise",
        "\x08\x08 spin",
        line("", "No.Name", "1", "", "winget"),
        line("アプリ", "V.App", "", "9.4.0", "")[:-9] + "other x",
        line("Cap", "B.Cap", "9.3.0", "9.4.0", "")[:-9] + "MSSTORE",
    ])
    short = "Name  Id    Version\nA     V.A   1.0\n"
    parsed = C.parse_listing_texts(texts(spark, {"a": listing, "b": short, "c": "no header"}))
    got = {}
    for r in C.listing_packages(parsed).collect():
        got[r.path, r.name] = (r.package_id, r.version, r.source)
    assert got == {
        ("a", "Keep App"): ("Con.Keep", "1.0.0", "winget"),
        ("a", "Canva"): ("ARP\\User\\abc", "1.2.3", ""),
        ("a", "アプリ"): ("V.App", None, "ther x"),
        ("a", "Cap"): ("B.Cap", "9.3.0", "MSSTORE"),
        ("b", "A"): ("V.A", "1.0", ""),
    }
    assert {r.path for r in quarantine(parsed).collect()} == {"c"}


def test_listing_files_read_by_range_equal_whole_ones(spark, tmp_path):
    head = "Name".ljust(14) + "Id".ljust(10) + "Version".ljust(9) + "Source"
    def rows(count):
        for n in range(count):
            yield f"App {n}".ljust(14) + f"V.{n}".ljust(10) + f"{n}.0".ljust(9) + "winget"
            yield ["", "  noise", "---", "\x08 spin", head][n % 5]
    many = list(rows(3000))
    files = {
        "large": "\r\n".join(["Loading", "  ", head, "-" * 40, *many]),
        "late": "\n".join(["noise " * 8] * 2000 + [head] + many[:50]),
        "breaks": "\x0b".join([head, *many[:40]]) + "\u2028" + "\n\n".join(many[40:60]),
        "rules": "\n".join([head, "", "-- --", "-----", *many[:4]]),
        "none": "\n".join(many[1:9:2][:3]),
        "only": head,
        "blank": "\n \n",
        "empty": "",
    }
    for name, text in files.items():
        (tmp_path / name).write_bytes(text.encode())
    folder = str(tmp_path)
    sizes = {"spark.sql.files.maxPartitionBytes": "8192", "spark.sql.files.openCostInBytes": "0"}
    old = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        lines = read_listing_lines(spark, folder)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    assert lines.filter(F.col("path").endswith("large")).select("_block").distinct().count() > 10
    whole = C.parse_listing_texts(read_texts(spark, folder))
    expected = sorted(map(str, C.listing_packages(whole).collect()))
    assert len(expected) > 3000
    assert sorted(map(str, listing_file_packages(lines).collect())) == expected
    status = listing_file_status(spark, folder, lines)
    columns = ("path", "status", "reason")
    assert sorted(map(str, status.collect())) == sorted(map(str, whole.select(*columns).collect()))
    assert status.count() == len(files) - 1  # Spark lists no file without a byte


def test_catalog_files_read_by_range_equal_whole_ones(spark, tmp_path):
    def package(n):
        more = [{}, {"note": 'a } \\" { ] [ "'}, {"tags": [{"k": [1, {}]}, []]}, {"o": {"p": {}}}, {"version": n}]
        return {"name": f"App {n} é", "id": f"V.{n}", **more[n % 5]}
    some = [package(n) for n in range(60)]
    files = {
        "large": json.dumps([package(n) for n in range(2500)], indent=1),
        "tight": json.dumps(some, separators=(",", ":"), ensure_ascii=False) + "\n",
        "object": json.dumps({"meta": {"a": {"b": []}}, "packages": some, "end": {"x": "}"}}),
        "mark": "\ufeff" + json.dumps({"packages": some}),
        "cut object": json.dumps({"packages": some})[:-1],
        "cut mark": "\ufeff" + json.dumps({"packages": some})[:-1],
        "cut list": json.dumps(some)[:-1],
        "cut item": json.dumps(some)[:-2],
        "cut text": json.dumps(some)[:-8],
        "number": json.dumps([*some[:9], 3, *some[9:]]),
        "first number": json.dumps([3, *some]),
        "list": json.dumps([*some[:9], [some[0]], *some[9:]]),
        "no id": json.dumps([*some, {"name": "x"}]),
        "two commas": json.dumps(some[:2])[:-1] + ",," + json.dumps(some[2:4])[1:],
        "no comma": json.dumps(some[:2])[:-1] + json.dumps(some[2:4])[1:],
        "after": json.dumps(some) + " x",
        "twice": json.dumps(some) * 2,
        "escape": '[{"name":"a\\}","id":"b.c"}]',
        "none": "[]", "no packages": '{"packages":[]}', "scalar": "5", "other": '{"none":{}}', "blank": " ",
    }
    for name, text in files.items():
        (tmp_path / name.replace(" ", "_")).write_bytes(text.encode())
    folder = str(tmp_path)
    sizes = {"spark.sql.files.maxPartitionBytes": "16384", "spark.sql.files.openCostInBytes": "0"}
    old = {name: spark.conf.get(name) for name in sizes}
    for name, value in sizes.items():
        spark.conf.set(name, value)
    try:
        items = read_catalog_items(spark, folder)
    finally:
        for name, value in old.items():
            spark.conf.set(name, value)
    whole = C.parse_catalogs(read_texts(spark, folder))
    expected = {r.path.rpartition("/")[2]: r.status for r in whole.collect()}
    assert {r.path.rpartition("/")[2]: r.status for r in catalog_file_status(items).collect()} == expected
    assert expected["object"] == expected["mark"] == expected["none"] == "ok"
    rows = sorted(map(str, C.catalog_packages(whole).collect()))
    assert sorted(map(str, catalog_file_packages(items).collect())) == rows and len(rows) == 2680


def test_catalog_id_of_blanks_is_bad(spark):
    frame = spark.createDataFrame(
        [
            ("a", '[{"name": "A", "id": "  ", "package_id": "P.A"}]'),
            ("b", '[{"name": "B", "id": "", "package_id": "P.B"}]'),
            ("c", '[{"name": "C", "package_id": "P.C"}]'),
            ("d", '[{"name": "D", "id": null, "package_id": "P.D"}]'),
        ],
        "path string, text string",
    )
    status = {r.path: r.status for r in C.parse_catalogs(frame).collect()}
    assert status == {"a": "bad", "b": "ok", "c": "ok", "d": "ok"}


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_status_of_snapshots_parses_files_once(spark):
    files = texts(spark, {
        "a": report([{"name": "A"}], hostname="h", started_at="t"), "b": report([], hostname="h", started_at="t"),
        "c": "[]", "d": "{",
    })
    out = snapshot_status(parse_snapshots(files))
    assert "parse_json" not in _plan(out)
    assert {(r.path, r.status, r.reason) for r in out.collect()} == {
        ("a", "ok", None), ("b", "repeated", "the same snapshot is in a"), ("c", "ok", None), ("d", "bad", "invalid JSON"),
    }


def test_kinds_of_values_without_their_schema(spark):
    given = ["{}", '{"b":[1]}', "[]", '[{"a":1}]', "null", "1", '"{}"', None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(given)], "i int, t string").repartition(1)
    value = F.try_parse_json("t")
    out = rows.select("i", is_object(value).alias("o"), is_array(value).alias("a"))
    assert "schema_of_variant" not in _plan(out)
    assert [(r.o, r.a) for r in out.orderBy("i").collect()] == [
        (True, False), (True, False), (False, True), (False, True), *[(False, False)] * 4,
    ]


def test_registry_values_are_gathered_by_number_first(spark):
    rows = [("h", "s", view, "k", n, "DisplayName", f"{view} {n}") for view in (0, 1) for n in (1, 2)]
    rows.append((None, "s", 0, "k", 1, "Publisher", None))
    captured = spark.createDataFrame(
        rows, "host string, snapshot_id string, view int, sub_name string, key_ord bigint, value_name string, value string"
    )
    keys = R.gather_values(captured.repartition(2))
    assert keys.columns == ["host", "snapshot_id", "view", "sub_name", "key_ord", *R.VALUE_NAMES]
    assert {(r.host, r.view, r.key_ord, r.DisplayName) for r in keys.collect()} == {
        *[("h", view, n, f"{view} {n}") for view in (0, 1) for n in (1, 2)], (None, 0, 1, None),
    }
    assert "Aggregate [key_ord" in _plan(keys)
