import os
import random

import pytest

from appcensus.operators.containment import containment
from appcensus.operators import matching
from appcensus.operators.durable import shared_folder
from appcensus.operators.matching import match_catalog, match_summary
from tests.rows import entry, fleet

# Names and the text they are matched by, written by hand.
KEYS = {
    "{}": "{}",
    "{} 1.0": "{}",
    "{} v2": "{}",
    "{} 3": "{}",
    "{}  4.1": "{}",
    "{}-5": "{}",
}


def key_of(name):
    return KEY_OF[name]


def one_by_one(rows, packages):
    """The choice as a plain loop over one snapshot."""
    names = {}
    for package in packages:
        names.setdefault(key_of(package["name"]), []).append(package)
    used, result = set(), {}
    for row in sorted(rows, key=lambda r: (r["name"].lower(), r["registry_path"], r["ord"])):
        key = key_of(row["name"])
        order = [key] if key in names else []
        near = [
            other
            for other in names
            if key and other != key and min(len(key), len(other)) >= 4 and (key in other or other in key)
        ]
        order += sorted(near, key=lambda other: -min(len(key), len(other)))
        free = (p for other in order for p in names[other] if p["package_id"] not in used)
        found = next(free, None)
        if found:
            used.add(found["package_id"])
        result[row["ord"]] = found and (found["package_id"], found["name"], found["version"])
    return result


def catalog(spark, packages):
    return spark.createDataFrame(
        [(p["name"], p["package_id"], p["version"], p["source"], i) for i, p in enumerate(packages)],
        "name string, package_id string, version string, source string, ord long",
    )


def package(name, ident, version=None, source="winget"):
    return {"name": name, "package_id": ident, "version": version, "source": source}


WORDS = ["java", "javas", "java se", "va s", "java se kit", "kit", "kits", "toolkit", "tool", "a", "ava"]


KEY_OF = {form.format(word): key.format(word) for word in WORDS for form, key in KEYS.items()}


@pytest.mark.parametrize("seed,shared", [(1, False), (2, True), (3, True), (4, True)])
def test_same_as_one_by_one(spark, seed, shared):
    rng = random.Random(seed)
    packages = [
        package(
            rng.choice(WORDS) + rng.choice(["", " 1.0", " v2"]),
            f"A.{rng.randrange(14) if shared else i}",
            str(i),
        )
        for i in range(22)
    ]
    rows, expected = [], {}
    for host in range(4):
        mine = [
            entry(
                rng.choice(WORDS) + rng.choice(["", " 3", "  4.1", "-5"]),
                ord=i,
                host=f"h{host}",
                registry_path=f"p{rng.randrange(4)}",
            )
            for i in range(14)
        ]
        rows += mine
        for ordinal, found in one_by_one(mine, packages).items():
            expected[(f"h{host}", ordinal)] = found
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    got = {
        (r.host, r.ord): r.package_id and (r.package_id, r.package_name, r.package_version)
        for r in out
    }
    assert len(out) == len(rows)
    assert got == expected


def test_catalog_per_host(spark):
    rows = [entry("Keep App", 1, host="a"), entry("Keep App", 2, host="b")]
    packages = spark.createDataFrame(
        [("a", "Keep App 1.0", "C.Keep", "1", "winget", 1), ("b", "Other", "O.Other", "1", "", 1)],
        "host string, name string, package_id string, version string, source string, ord long",
    )
    out = match_catalog(fleet(spark, rows), packages, by=("host",)).collect()
    assert {(r.host, r.package_id, r.match_kind) for r in out} == {
        ("a", "C.Keep", "exact"),
        ("b", None, None),
    }


def test_known_fixture(spark):
    packages = [
        package("Keep App", "Contoso.KeepApp", "1.0.0"),
        package("Upgrade App 2.0.0", "Contoso.UpgradeApp", "2.0.0"),
        package("Canva", "ARP\\User\\X64\\3d0", "1.124.1", ""),
        package("Visual Studio Code", "Microsoft.VisualStudioCode", "1.90.0"),
    ]
    rows = [entry(n, i) for i, n in enumerate(["Keep App", "Upgrade App", "New Tool", "Canva"])]
    out = match_catalog(fleet(spark, rows), catalog(spark, packages))
    assert {r.name: r.package_id for r in out.collect()} == {
        "Keep App": "Contoso.KeepApp",
        "Upgrade App": "Contoso.UpgradeApp",
        "New Tool": None,
        "Canva": None,
    }
    assert match_summary(out).first()[2:] == (2, 2)


def test_containment_is_complete(spark):
    rng = random.Random(5)
    words = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 9))) for _ in range(150)}
    longer = {"".join(rng.choice("ab ") for _ in range(rng.randrange(1, 30))) for _ in range(80)}
    short = spark.createDataFrame([(w,) for w in words], "key string")
    long = spark.createDataFrame([(w,) for w in longer], "key string")
    got = {tuple(r) for r in containment(short, long, []).collect()}
    assert got == {(s, l) for s in words for l in longer if len(s) >= 4 and s != l and s in l}


def test_matching_plan_has_no_nested_loops(spark):
    df = fleet(spark, [entry("Java", 1)]).select("name").withColumnRenamed("name", "key")
    plan = containment(df, df, [])._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_rounds_do_not_grow_with_shared_ids(spark, monkeypatch):
    rounds = []
    answers = matching._answers
    monkeypatch.setattr(matching, "_answers", lambda *a: rounds.append(1) or answers(*a))
    counts = []
    for k in (2, 5):
        rounds.clear()
        packages = [package(f"app{i}", f"I.{i}") for i in range(k)]
        packages += [package(f"other{i}", f"I.{i}") for i in range(k)]
        rows = [entry(f"{word}{i}", i, registry_path=word) for i in range(k) for word in ("app", "other")]
        out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
        assert {r.name for r in out if r.package_id} == {f"app{i}" for i in range(k)}
        counts.append(len(rounds))
    assert counts[0] == counts[1] <= 3


def test_only_the_result_stays_on_disk(spark):
    packages = [package("Keep App", "Contoso.KeepApp", "1.0.0")]
    folder = shared_folder(spark).removeprefix("file:")
    before = {name for name in os.listdir(folder) if name.startswith("table-")}
    out = match_catalog(fleet(spark, [entry("Keep App", 1)]), catalog(spark, packages))
    after = {name for name in os.listdir(folder) if name.startswith("table-")}
    assert len(after - before) == 1
    assert out.count() == 1


def test_enough_packages_need_no_pairs(spark, monkeypatch):
    """Names with enough packages are not compared with other names."""
    monkeypatch.setattr(matching, "wishes", lambda *a: pytest.fail("pairs of names"))
    packages = [package("tool" + " x" * k, f"I.{k}") for k in range(60)]
    rows = [entry("tool" + " x" * k, k, host=f"h{h}") for k in range(60) for h in range(3)]
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    assert {(r.host, r.name, r.package_id, r.match_kind) for r in out} == {
        (f"h{h}", "tool" + " x" * k, f"I.{k}", "exact") for k in range(60) for h in range(3)
    }


def test_only_names_with_takers_left_are_looked_up(spark, monkeypatch):
    asked = []
    real = matching.wishes
    monkeypatch.setattr(matching, "wishes", lambda wanted, *a: asked.append(wanted.count()) or real(wanted, *a))
    packages = [package(f"tool {chr(97 + k % 26)}{k}x", f"I.{k}") for k in range(2000)]
    rows = [entry(f"tool {chr(97 + k % 26)}{k}x", k) for k in range(1, 2000)]
    rows += [entry("a tool", 3000), entry("tool", 3001), entry("tool", 3002, registry_path="z")]
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    # "tool" is in all names: the second one takes a package from the application it belongs to.
    assert {r.ord: r.package_id for r in out if r.ord >= 3000} == {3000: None, 3001: "I.0", 3002: "I.1"}
    assert asked == [2, 1]
    assert all(r.package_id == (f"I.{r.ord}" if r.ord > 1 else None) for r in out if r.ord < 2000)


def nested(k):
    """Names that contain each other, two applications and a package of each."""
    packages = [package("tool" + "x" * i, f"I.{i}") for i in range(k)]
    rows = [entry("tool" + "x" * i, 2 * i + j, registry_path=f"p{j}") for i in range(k) for j in (0, 1)]
    return rows, packages


def test_nested_names(spark):
    rows, packages = nested(6)
    KEY_OF.update({row["name"]: row["name"] for row in rows})
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    expected = one_by_one(rows, packages)
    assert {r.ord: r.package_id and (r.package_id, r.package_name, r.package_version) for r in out} == expected


def test_next_free_package(spark):
    """The way past held packages, against a plain walk, in as many levels as the runs need."""
    rng = random.Random(3)
    n, by = 700, []
    slots = [("w", slot, f"P{slot}") for slot in range(1, n)]
    held = {(h, slot): rng.randrange(1, 90) for h in "ab" for slot in range(1, n) if rng.random() < 0.97}
    held |= {("a", slot): 1 for slot in range(100, 400)}
    refused = [(h, "s", "w", p, rng.randrange(1, n - 1)) for h in "ab" for p in range(50, 120)]
    got = matching._next_free(
        spark.createDataFrame(refused, "host string, snapshot_id string, wish_key string, position long, slot long"),
        spark.createDataFrame(
            [(h, "s", f"P{slot}", p) for (h, slot), p in held.items()],
            "host string, snapshot_id string, package_id string, _earliest long",
        ),
        spark.createDataFrame(slots, "wish_key string, slot long, package_id string"),
        by,
    )

    def walk(host, position, slot):
        slot += 1
        while held.get((host, slot), position) < position:
            slot += 1
        return slot

    assert {(r.host, r.position): r.low for r in got.collect()} == {
        (h, p): walk(h, p, slot) for h, _, _, p, slot in refused
    }


def displaced(k, shared):
    """Each application takes the package of the next one; the first has two takers."""
    packages = [package(f"app{i:02}x", f"I.{i}") for i in range(k)]
    if shared:
        packages = [package(f"app{i:02}x", f"I.{j}") for i in range(k) for j in (i, i + 1)]
    rows = [entry(f"app{i:02}x", i) for i in range(k)] + [entry("app00x", k, registry_path="z")]
    rows += [entry("app", k + 1 + i, registry_path=f"p{i}") for i in range(3)]
    return rows, packages


@pytest.mark.parametrize("shared", [False, True])
@pytest.mark.parametrize("folded", [True, False])
def test_displaced_applications(spark, monkeypatch, shared, folded):
    """Chains of displaced applications take no round for each link; larger snapshots go on in rounds."""
    rounds = []
    answers = matching._answers
    monkeypatch.setattr(matching, "_answers", lambda *a: rounds.append(1) or answers(*a))
    if not folded:
        monkeypatch.setattr(matching, "FOLDED_ROWS", 0)
    rows, packages = displaced(6 if folded else 4, shared)
    KEY_OF.update({row["name"]: row["name"] for row in rows})
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    expected = one_by_one(rows, packages)
    assert {r.ord: r.package_id and (r.package_id, r.package_name, r.package_version) for r in out} == expected
    assert not folded or len(rounds) <= 1


def test_lists_that_were_cut_too_short_are_read_further(spark, monkeypatch):
    monkeypatch.setattr(matching, "_SPARE", 0)
    monkeypatch.setattr(matching, "_FURTHER", 2)
    packages = [package(name, f"I.{i}") for name in ("first", "second") for i in range(9)]
    rows = [entry("first", i, registry_path=f"p{i}") for i in range(8)] + [entry("second", 9), entry("second", 10)]
    KEY_OF.update({row["name"]: row["name"] for row in rows})
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    expected = one_by_one(rows, packages)
    assert {r.ord: r.package_id and (r.package_id, r.package_name, r.package_version) for r in out} == expected


def test_too_large_snapshots_go_on_in_rounds(spark, monkeypatch):
    """Of two snapshots one is dealt out whole, the other one is above the bound."""
    monkeypatch.setattr(matching, "FOLDED_ROWS", 60)
    rows, packages = displaced(3, True)
    rows = [{**row, "host": "small"} for row in rows[:2]] + [{**row, "host": "large"} for row in rows]
    KEY_OF.update({row["name"]: row["name"] for row in rows})
    out = match_catalog(fleet(spark, rows), catalog(spark, packages)).collect()
    for host in ("small", "large"):
        expected = one_by_one([row for row in rows if row["host"] == host], packages)
        got = {r.ord: r.package_id and (r.package_id, r.package_name, r.package_version) for r in out if r.host == host}
        assert got == expected
