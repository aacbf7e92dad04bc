import pytest
from pyspark.sql import functions as F

from appcensus.functions import keys as K
from appcensus.functions import text as X
from appcensus.functions import values as V
from tests.rows import entry, fleet, scalar


def check(spark, function, pairs, kind="string"):
    assert scalar(spark, function, [given for given, _ in pairs], kind) == [e for _, e in pairs]


def test_clean(spark):
    pairs = [(" a ", "a"), ("\u3000\x1f b\xa0", "b"), ("\t\n", None), ("", None), (None, None)]
    check(spark, X.clean, pairs)


def test_decoded(spark):
    pairs = [(bytearray(b" ok "), " ok "), (bytearray(b"a\xff"), "a\ufffd"), (None, None)]
    check(spark, X.decoded, pairs, "binary")


def test_captured_values(spark):
    def held(expressions, whole):
        rows = spark.range(1).select(*[F.expr(f"cast({e} as variant)").alias(f"c{i}") for i, e in enumerate(expressions)])
        kept = rows.select(*[V.captured_text(F.col(c), "variant", F.lit(whole)).alias(c) for c in rows.columns])
        return list(kept.first())

    values = ["' a '", "X'61FF'", "12.7D", "-0.5D", "cast(5 as bigint)", "true", "false", "double('NaN')", "null"]
    assert held(values, True) == [" a ", "a\ufffd", "12", "0", "5", "1", "0", "NaN", None]
    assert held(values, False) == [" a ", "a\ufffd", "12.7", "-0.5", "5", "True", "False", "NaN", None]
    whole = [(12.7, "12"), (-1.0, "-1"), (None, None)]
    check(spark, lambda c: V.captured_text(c, "double", F.lit(True)), whole, "double")
    assert scalar(
        spark, lambda c: V.size_kb(V.captured_text(c, "double", F.lit(True))), [12.7, -1.0, -0.5, None], "double"
    ) == [12, None, 0, None]
    check(spark, lambda c: V.captured_text(c, "boolean", F.lit(False)), [(True, "True"), (None, None)], "boolean")
    check(spark, lambda c: V.captured_text(c, "binary", F.lit(True)), [(bytearray(b"7"), "7")], "binary")


def test_install_date(spark):
    check(
        spark,
        V.install_date,
        [
            ("20260717", "2026-07-17"),
            ("2026-07-17", "2026-07-17"),
            ("7/17/2026", "2026-07-17"),
            ("2026/7/1", "2026-07-01"),
            ("1-7-2026", "2026-07-01"),
            # Eight digits are year, month, day whatever stands between.
            ("07/17/2026", None),
            ("17-07-2026", None),
            ("2026-7-17", None),
            ("20261301", None),
            ("20260230", None),
            ("19791231", None),
            ("19800101", "1980-01-01"),
            ("123", None),
            ("not-a-date", None),
            ("", None),
            (None, None),
        ],
    )


def test_size(spark):
    check(
        spark,
        V.size_kb,
        [("850", 850), (" 1024 ", 1024), ("1_000", 1000), ("+5", 5), ("12.7", None), ("abc", None),
         ("-5", None), ("_1", None), ("1__0", None), (None, None)],
    )


def test_system_flag(spark):
    check(
        spark,
        V.system_flag,
        [("1", True), ("0", False), ("2", True), ("-1", True), ("YES", True), (" true ", True),
         ("no", False), ("", False), (None, False), ("99999999999999999999", True)],
    )


def test_subject_publisher(spark):
    check(
        spark,
        V.subject_publisher,
        [
            ("CN=Microsoft Windows, O=Microsoft Corporation, C=US", "Microsoft Corporation"),
            ("CN=Contoso Dev", "Contoso Dev"),
            ('O="Quoted, Inc", CN=x', "Quoted"),
            ("O= , CN=Fallback", "Fallback"),
            ("L=Nowhere", None),
            (None, None),
        ],
    )


def test_architecture(spark):
    check(
        spark,
        V.architecture,
        [("X64", "64-bit"), ("x86", "32-bit"), ("X86OnArm64", "32-bit"), ("Arm64", "arm64"),
         (" ARM ", "arm"), ("Neutral", "neutral"), ("mips", "unknown"), (None, "unknown")],
    )


def test_human_size(spark):
    check(
        spark,
        V.human_size,
        [(None, ""), (0, "0 KB"), (512, "512 KB"), (1024, "1 MB"), (1280, "1.2 MB"), (1331, "1.3 MB"),
         (102400, "100 MB"), (870400, "850 MB"), (104960, "102 MB"), (1468006, "1.4 GB"),
         (1048576, "1 GB"), (104857600 + 524288, "100 GB")],
        "bigint",
    )


def test_update_flag(spark):
    names = ["KB1234567", "kb12", "Security Update for X", "Update for X", "Update Helper Utility",
             "A Hotfix B", "Hotfixes", " KB1"]
    assert scalar(spark, lambda c: V.update_flag(c, F.lit(None).cast("string")), names) == [
        True, True, True, True, False, True, False, False,
    ]
    assert scalar(spark, lambda c: V.update_flag(F.lit("App"), c), [" Hotfix ", "Feature", None]) == [
        True, False, False,
    ]


def test_match_key(spark):
    check(
        spark,
        K.match_key,
        [("CapCut 9.3.0", "capcut"), ("  Keep   App  ", "keep app"), ("notepad2", "notepad"),
         ("usb driver 3.1", "usb dri"), ("foo 1.2.3.4.5", "foo 1."), ("7", "7"),
         ("Python 3.12.1 (64-bit)", "python 3.12.1 (64-bit)"), ("App - v2.0+45", "app"), (" ", ""),
         (None, "")],
    )


@pytest.mark.parametrize(
    "ident,source,expected",
    [("A.B", "", True), ("A", "winget", True), ("A", "MSStore ", True), ("A", "", False),
     ("ARP\\x.y", "winget", False), ("msix\\x", "winget", False), ("Arp\\x.y", "", False),
     ("Arp\\x", "winget", True), (" ", "winget", False), (None, "winget", False)],
)
def test_importable(spark, ident, source, expected):
    df = spark.createDataFrame([(ident, source)], "i string, s string")
    assert df.select(K.importable(F.col("i"), F.col("s"))).first()[0] is expected


def test_cells(spark):
    assert scalar(spark, lambda c: X.cell(c, 4), ["abcd", "abcde", "a", None]) == [
        "abcd", "abc…", "a   ", "    ",
    ]
    assert scalar(spark, X.markdown_cell, ["a|b\nc", None]) == ["a\\|b c", ""]


def test_quoted(spark):
    values = ["plain", "it's", 'say "x"', "it's \"x\"", "C:\\x", "tab\t", None]
    assert scalar(spark, X.quoted, values) == [repr(v) for v in values]


def test_json_value(spark):
    assert scalar(spark, X.json_value, ['a"b\\', "日本", None]) == ['"a\\"b\\\\"', '"日本"', "null"]


def test_times(spark):
    df = spark.sql(
        "select timestamp'2026-07-17 06:00:00.987' a, timestamp'2026-07-17 06:00:01.5' b"
    )
    row = df.select(
        V.utc_text(F.col("a")), V.utc_text_ms(F.col("a")), V.elapsed_ms(F.col("a"), F.col("b")),
        V.elapsed_ms(F.col("b"), F.col("a")),
    ).first()
    assert tuple(row) == ("2026-07-17T06:00:00Z", "2026-07-17T06:00:00.987-00:00", 513, 0)


def test_completeness(spark):
    rows = [
        entry("A", 1, version=None, publisher=" "),
        entry("B", 2, install_date="x", estimated_size_kb=0, uninstall_string="u"),
    ]
    got = fleet(spark, rows).orderBy("ord").select(K.completeness()).collect()
    assert [r[0] for r in got] == [0, 5]


def test_identity(spark):
    rows = [
        entry(" App ", 1, publisher="Pub", install_location="C:\\X\\/"),
        entry("App", 2, source="appx", registry_path="APPX:Fam", architecture="32-bit"),
        entry("App", 3, source="appx", registry_path="other", publisher=None),
    ]
    got = fleet(spark, rows).orderBy("ord").select(*K.identity_keys()).collect()
    assert [tuple(r) for r in got] == [
        ("app", "pub", "c:\\x"), ("appx:fam", "", "32-bit"), ("app", "", ""),
    ]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_dates_run_each_step_once(spark):
    raw = spark.createDataFrame([("1-2-2026",), ("\t2026/7/17\n",), ("2026-7-5",), ("x20x260717",), ("7/17/1979",)], "v string")
    out = raw.repartition(1).select(V.install_date(F.col("v")).alias("day"))
    assert [r.day for r in out.collect()].count(None) == 2
    assert {r.day for r in out.collect()} == {"2026-02-01", "2026-07-17", None}
    assert _plan(out).count("regexp_replace") == 4


def test_texts_without_white_space_at_their_ends_are_passed_on(spark):
    values = ["a b", " a", "a　", "é", "", None, "\x7fa", "a\x85", "KB"]
    assert scalar(spark, X.strip, values) == ["a b", "a", "a", "é", "", None, "\x7fa", "a", "KB"]
    rows = spark.createDataFrame([("a",)], "v string").repartition(1)
    assert "ascii" in _plan(rows.select(X.strip(F.col("v")))).lower()


def test_sizes_are_read_once(spark):
    values = ["-0", "-0_0", "-1", "+1_0", "1__0", "99999999999999999999"]
    assert scalar(spark, V.size_kb, values) == [0, 0, None, 10, None, None]
    rows = spark.createDataFrame([("1",)], "v string").repartition(1)
    assert _plan(rows.select(V.size_kb(F.col("v")).alias("kb"))).count("RLIKE") == 1


def test_dates_of_ascii_alone_take_one_step(spark):
    """A text that is not all ASCII counts digits of any script, the others go through one pattern."""
    values = ["1/2/2026", "2026/1/2", "1-2-2026", "01/02/2015", "2026年07月17日", "２0260717", "20260717７", "a2b0c2d6e0f7g1h7i", "1/2-2026"]
    days = ["2026-01-02", "2026-01-02", "2026-02-01", None, "2026-07-17", None, None, "2026-07-17", None]
    assert scalar(spark, V.install_date, values) == days
    rows = spark.createDataFrame([("1",)], "v string").repartition(1)
    assert "octet_length" in _plan(rows.select(V.install_date(F.col("v")).alias("day")))
