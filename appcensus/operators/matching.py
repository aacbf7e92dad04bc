"""One-to-one matching of applications to the packages of a catalog.

Within a snapshot, applications choose in report order.  Each takes the first unused
package of its best package name: the same name, else the names that contain it or
are contained in it, the longest common part first and then in catalog order.

The choice is made for all snapshots at once.  First the applications of a name get the
packages of the same name.  Where these are enough for every name of a snapshot, this is the
result, and no two names are compared.  Only names with more takers than packages are looked
for in other names, and only the snapshots that have such takers go on, in rounds: the takers
left over are spread along the list of the names their own allows, by the number of packages
each holds; a name that more applications ask for than it has packages keeps the first ones, and
the others move on to their next name, which is looked up when it is first needed.  Nobody who
was turned down could have got the package later, so the rounds end in the one result that the
application-by-application choice gives.

A package id may be listed under several names.  Applications that ask for such a name
propose for its packages one by one: an id keeps its earliest taker, and all others move
on at once, past the packages that earlier applications hold, by links that double their reach
from level to level.  Snapshots where nobody was turned down are done and leave the rounds.

Chains of applications that push each other on would take a round for each link.  So snapshots
with shared ids, and those that the first round leaves open, are dealt out whole: each goes
through its applications in order once, over the first packages of their lists, and again with
more of them where these do not reach.  Only snapshots of more than ``FOLDED_ROWS`` go on in rounds.
"""

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from appcensus.functions.keys import importable, match_key
from appcensus.operators.containment import containment
from appcensus.operators.durable import durable, temporary_tables
from appcensus.operators.running import along, numbered, running
from appcensus.schema import GROUP

_SNAPSHOT = list(GROUP)

_TOGETHER = 8
"""Results of so many rounds are put into one table, so that the plan does not grow."""

FOLDED_ROWS = 400_000
"""Applications and packages of a snapshot that one task takes at once."""

_SPARE, _FURTHER = 8, 8
"""Packages looked at beside those for each taker, and how many times more after a list was too short."""


def importable_packages(packages: DataFrame) -> DataFrame:
    return packages.filter(importable(F.col("package_id"), F.col("source")))


def offers(packages: DataFrame, by: list[str]) -> DataFrame:
    """Packages by match key, numbered in catalog order; an id counts once per key."""
    keyed = importable_packages(packages).withColumn("offer_key", match_key(F.col("name")))
    once = (
        keyed.filter(F.col("offer_key") != "")
        .groupBy(*by, "offer_key", "package_id")
        .agg(
            F.min("ord").alias("offer_ord"),
            F.min_by(F.struct("name", "version", "source"), "ord").alias("_row"),
        )
        .select(
            *by,
            "offer_key",
            "package_id",
            "offer_ord",
            F.col("_row.name").alias("package_name"),
            F.col("_row.version").alias("package_version"),
            F.col("_row.source").alias("package_source"),
        )
    )
    return numbered(once, [*by, "offer_key"], ["offer_ord"], "place", along("offer_ord"))


def offered_names(catalog: DataFrame, by: list[str]) -> DataFrame:
    """The names of the catalog: place, number of packages, and whether one is listed elsewhere."""
    listings = catalog.select(*by, "offer_key", "package_id")
    twice = listings.groupBy(*by, "package_id").count().filter(F.col("count") > 1).drop("count")
    shared = listings.join(twice, [*by, "package_id"], "left_semi").select(*by, "offer_key").distinct()
    return (
        catalog.groupBy(*by, "offer_key")
        .agg(F.min("offer_ord").alias("first_ord"), F.count("*").alias("capacity"))
        .join(shared.withColumn("shared", F.lit(True)), [*by, "offer_key"], "left")
        .fillna(False, subset=["shared"])
    )


def wishes(wanted: DataFrame, names: DataFrame, by: list[str]) -> DataFrame:
    """The package names each application name may use, best first.

    ``first`` and ``last`` number the packages along the list of one application
    name.  The table is about distinct names; hosts do not multiply it.
    """
    keys = names.select(*by, F.col("offer_key").alias("key"))
    exact = wanted.join(keys, [*by, "key"], "left_semi").select(
        *by, F.col("key").alias("wish_key"), F.col("key").alias("offer_key"), F.lit(0).alias("kind")
    )
    inside = containment(wanted, keys, by).select(
        *by,
        F.col("short_key").alias("wish_key"),
        F.col("long_key").alias("offer_key"),
        F.lit(1).alias("kind"),
    )
    around = containment(keys, wanted, by).select(
        *by,
        F.col("long_key").alias("wish_key"),
        F.col("short_key").alias("offer_key"),
        F.lit(1).alias("kind"),
    )
    listed = (
        exact.unionByName(inside)
        .unionByName(around)
        .join(names, [*by, "offer_key"])
        .withColumn("common", -F.least(F.length("wish_key"), F.length("offer_key")))
    )
    order = ["kind", "common", "first_ord"]
    totals = {"last": ("sum", F.col("capacity"))}
    pieces = F.struct("kind", "common", along("first_ord"))
    listed = running(durable(listed), [*by, "wish_key"], order, totals, pieces)
    return listed.withColumn("first", F.col("last") - F.col("capacity") + 1).select(
        *by, "wish_key", "offer_key", "kind", "first", "last", "capacity", "shared"
    )


def _covering_wish(seekers: DataFrame, lists: DataFrame, by: list[str]) -> DataFrame:
    """For each list position sought, the name that holds it."""
    marks = lists.select(*by, "wish_key", F.col("first").alias("slot"), F.lit(0).alias("_sought"))
    sought = seekers.select(*by, "wish_key", "slot").distinct().withColumn("_sought", F.lit(1))
    begun = F.when(F.col("_sought") == 0, F.col("slot"))
    placed = running(
        marks.unionByName(sought),
        [*by, "wish_key"],
        ["slot", "_sought"],
        {"first": ("max", begun)},
        along("slot"),
    ).filter(F.col("_sought") == 1)
    return placed.join(lists, [*by, "wish_key", "first"]).filter(
        F.col("slot") <= F.col("last")
    ).select(*by, "wish_key", "slot", "offer_key", "kind", "first", "last", "capacity", "shared")


def _columns(by: list[str]) -> list[str]:
    return [*_SNAPSHOT, *[column for column in by if column not in _SNAPSHOT]]


def _spread(state: DataFrame, by: list[str]) -> DataFrame:
    """``slot``: the place in their list that applications of one name ask for, one each."""
    mates = [*_columns(by), "wish_key"]
    ranked = numbered(state, mates, ["position"], "_rank", along("position"))
    shifts = {"_shift": ("max", F.col("low") - F.col("_rank"))}
    spread = running(durable(ranked), mates, ["position"], shifts, along("position"))
    slot = F.col("_rank") + F.col("_shift")
    return spread.withColumn("slot", slot).drop("_rank", "_shift", "low")


def _held_runs(held: DataFrame, at: list[str]) -> list[DataFrame]:
    """``at, slot, latest`` per level: the latest holder of 2 ** level packages in a row, all held."""
    levels = []
    level = held
    while not level.isEmpty():
        levels.append(level)
        further = level.select(
            *at, (F.col("slot") - F.lit(1 << (len(levels) - 1))).alias("slot"), F.col("latest").alias("_more")
        )
        level = durable(
            level.join(further, [*at, "slot"]).withColumn("latest", F.greatest("latest", "_more")).drop("_more")
        )
    return levels


def _next_free(refused: DataFrame, holders: DataFrame, slots: DataFrame, by) -> DataFrame:
    """``low`` of refused proposals: the first package after theirs that no earlier
    application holds.  Holders only ever change to earlier ones."""
    at = [*_columns(by), "wish_key"]
    refused = durable(refused.select(*at, "position", (F.col("slot") + 1).alias("slot")))
    asked = refused.select(*at).distinct()
    held = (
        slots.join(asked, [*by, "wish_key"])
        .join(holders, [*_columns(by), "package_id"])
        .select(*at, "slot", F.col("_earliest").alias("latest"))
    )
    runs = _held_runs(durable(held), at)
    for level in range(len(runs) - 1, -1, -1):
        met = refused.join(runs[level], [*at, "slot"], "left")
        step = F.when(F.col("latest") < F.col("position"), F.lit(1 << level)).otherwise(0)
        refused = met.withColumn("slot", F.col("slot") + step).drop("latest")
    return refused.withColumnRenamed("slot", "low")


def _answers(
    placed: DataFrame, listings: DataFrame, slots: DataFrame | None, by: list[str]
) -> DataFrame:
    """``place, package_id`` of each proposal, whether it is refused, and where to go on."""
    columns = _columns(by)
    rivals = [*columns, "offer_key"]
    by_name = numbered(
        placed.filter(~F.col("shared")), rivals, ["position"], "place", along("position")
    )
    by_name = by_name.withColumn("refused", F.col("place") > F.col("capacity")).withColumn(
        "low", F.when(F.col("refused"), F.col("last") + 1).otherwise(F.col("first"))
    )
    by_name = by_name.join(listings, [*by, "offer_key", "place"], "left")
    names = [*columns, "wish_key", "position", "offer_key", "kind", "place", "package_id"]
    by_name = by_name.select(*names, "refused", "low")
    if slots is None:
        return by_name

    one_by_one = durable(
        placed.filter("shared")
        .withColumn("place", F.col("slot") - F.col("first") + 1)
        .join(listings, [*by, "offer_key", "place"])
    )
    taken = [*columns, "package_id"]
    holders = one_by_one.groupBy(*taken).agg(F.min("position").alias("_earliest"))
    one_by_one = one_by_one.join(holders, taken).withColumn(
        "refused", F.col("position") > F.col("_earliest")
    )
    moved = _next_free(one_by_one.filter("refused"), holders, slots, by)
    one_by_one = one_by_one.join(moved, [*columns, "wish_key", "position"], "left")
    one_by_one = one_by_one.withColumn("low", F.coalesce("low", "slot"))
    return by_name.unionByName(one_by_one.select(*names, "refused", "low"))


def _slots(lists: DataFrame, listings: DataFrame, by: list[str]) -> DataFrame | None:
    """The packages along the lists, of names that share packages; none where no name does."""
    shared = lists.filter("shared")
    if shared.isEmpty():
        return None
    return durable(
        shared.select(*by, "wish_key", "offer_key", "first", F.explode(F.sequence("first", "last")).alias("slot"))
        .withColumn("place", F.col("slot") - F.col("first") + 1)
        .join(listings, [*by, "offer_key", "place"])
        .select(*by, "wish_key", "slot", "package_id")
    )


def _take_in_turn(takers: pa.Table, offered: pa.Table) -> pa.Table:
    """The packages of one snapshot in the order of its takers, or the taker whose list was too short."""
    lists: dict[str, list[tuple[int, str]]] = {}
    offered = offered.sort_by("slot")
    names, slots, idents = (offered[c].to_pylist() for c in ("wish_key", "slot", "package_id"))
    for name, slot, ident in zip(names, slots, idents):
        lists.setdefault(name, []).append((slot, ident))
    takers = takers.sort_by("position")
    used, at, rows, taken, short = set(), dict.fromkeys(lists, 0), [], [], False
    for row, (name, whole) in enumerate(zip(takers["wish_key"].to_pylist(), takers["_whole"].to_pylist())):
        mine, place = lists.get(name, []), at.get(name, 0)
        # What is used stays used: nobody of this name looks at it again.
        while place < len(mine) and mine[place][1] in used:
            place += 1
        at[name] = place
        if place < len(mine):
            rows.append(row)
            taken.append(mine[place][0])
            used.add(mine[place][1])
        elif not whole:
            rows, taken, short = [row], [None], True
            break
    out = takers.drop_columns("_whole").take(pa.array(rows, pa.int64()))
    out = out.append_column("slot", pa.array(taken, pa.int64()))
    return out.append_column("short", pa.array([short] * len(rows), pa.bool_()))


def _in_turn(
    takers: DataFrame, lists: "_Lists", listings: DataFrame, by: list[str]
) -> tuple[list[DataFrame], DataFrame]:
    """The choice in snapshots that a task can hold, and the snapshots that are larger.

    A taker passes only packages that earlier ones hold, so the first packages of its list
    are enough; how many is found by trying with more where they were too few.
    """
    columns = _columns(by)
    name = [*by, "wish_key"]
    results, large, further = [], takers.select(*columns).limit(0), 1
    while True:
        known = lists.every()
        looked_up = lists.asked.select(*by, F.col("key").alias("wish_key"), F.lit(True).alias("_known"))
        wanted = (
            takers.groupBy(*columns, "wish_key")
            .agg(F.count("*").alias("_takers"))
            .join(known.groupBy(*name).agg(F.max("last").alias("_all")), name, "left")
            .join(looked_up, name, "left")
            .fillna({"_all": 0, "_known": False})
            .withColumn("_reach", F.least("_all", further * (F.col("_takers") + _SPARE)))
            .withColumn("_whole", F.col("_known") & (F.col("_reach") == F.col("_all")))
        )
        wanted = durable(wanted.drop("_all", "_known"))
        rows = wanted.groupBy(*columns).agg(F.sum(F.col("_takers") + F.col("_reach")).alias("_rows"))
        over = rows.filter(F.col("_rows") > FOLDED_ROWS).select(*columns)
        if not over.isEmpty():
            large = durable(large.unionByName(over))
            wanted = wanted.join(over, columns, "left_anti")
        offered = (
            wanted.join(known.select(*name, "offer_key", "kind", "first", "last"), name)
            .filter(F.col("first") <= F.col("_reach"))
            .withColumn("slot", F.explode(F.sequence("first", F.least("last", "_reach"))))
            .withColumn("place", F.col("slot") - F.col("first") + 1)
            .join(listings, [*by, "offer_key", "place"])
        )
        offered = durable(
            offered.select(*columns, "wish_key", "slot", "offer_key", "kind", "place", "package_id")
        )
        turns = takers.join(wanted, [*columns, "wish_key"]).select(*columns, "position", "wish_key", "_whole")
        schema = StructType([StructField(f.name, f.dataType) for f in turns.schema if f.name != "_whole"])
        schema = schema.add("slot", LongType()).add("short", BooleanType())
        packages = offered.select(*columns, "wish_key", "slot", "package_id")
        chosen = durable(
            turns.groupBy(*columns).cogroup(packages.groupBy(*columns)).applyInArrow(_take_in_turn, schema)
        )
        taken = chosen.filter(~F.col("short")).join(offered, [*columns, "wish_key", "slot"])
        results.append(taken.select(*columns, *_CHOICE))
        again = chosen.filter("short").select(*columns)
        if again.isEmpty():
            return results, large
        takers = durable(takers.join(again, columns, "left_semi"))
        lists.need(takers.select(*by, F.col("wish_key").alias("key")).distinct())
        further *= _FURTHER


class _Lists:
    """The names that application names may use, looked up when they are first needed."""

    def __init__(self, names: DataFrame, by: list[str]):
        self.names, self.by = names, by
        self.known: DataFrame | None = None
        self.asked: DataFrame | None = None

    def need(self, keys: DataFrame) -> bool:
        """Look up ``key`` values that are not known yet; were there any?"""
        if self.asked is not None:
            keys = keys.join(self.asked, [*self.by, "key"], "left_anti")
        if keys.isEmpty():
            return False
        keys = durable(keys)
        found = durable(wishes(keys, self.names, self.by))
        self.asked = keys if self.asked is None else self.asked.unionByName(keys)
        self.known = found if self.known is None else self.known.unionByName(found)
        return True

    def every(self) -> DataFrame:
        """Lists of all names; those not looked up hold their own name."""
        alone = self.names.withColumnRenamed("offer_key", "key").join(
            self.asked, [*self.by, "key"], "left_anti"
        )
        alone = alone.select(
            *self.by, F.col("key").alias("wish_key"), F.col("key").alias("offer_key"),
            F.lit(0).alias("kind"), F.lit(1).cast("bigint").alias("first"),
            F.col("capacity").alias("last"), "capacity", "shared",
        )
        return self.known.unionByName(alone)


def _turned_down(answers: DataFrame, by: list[str]) -> DataFrame:
    return answers.filter("refused").select(*by, F.col("wish_key").alias("key")).distinct()


_CHOICE = ("position", "offer_key", "kind", "place", "package_id")


def _settle(asked: DataFrame, names: DataFrame, listings: DataFrame, by: list[str]) -> DataFrame:
    """The choice of every application that gets a package.

    ``asked``: the applications with ``_rank`` among those of their name, and the ``capacity`` of
    the package name that is the same (null: none).
    """
    columns = _columns(by)
    own = F.col("_rank") <= F.col("capacity")
    first = asked.select(
        *columns, "wish_key", "position", F.col("_rank").alias("slot"), "capacity",
        F.coalesce("shared", F.lit(False)).alias("shared"), (~F.coalesce(own, F.lit(False))).alias("refused"),
    )
    at_home = first.filter(~F.col("refused")).select(
        *columns, "wish_key", "position", "slot", F.col("wish_key").alias("offer_key"),
        F.lit(0).alias("kind"), F.lit(1).cast("bigint").alias("first"), F.col("capacity").alias("last"),
        "capacity", "shared",
    )
    alone = at_home.withColumn("place", F.col("slot")).join(listings, [*by, "offer_key", "place"])
    alone = alone.select(*columns, *_CHOICE)
    lists = _Lists(names, by)
    shares = not asked.filter("shared").isEmpty()
    if not lists.need(_turned_down(first, by)) and not shares:
        return alone

    # Snapshots with takers that have another name to go to, or with a name that shares packages.
    walking = first.filter("shared").select(*columns)
    if lists.known is not None:
        others = lists.known.filter("kind = 1").select(*by, "wish_key").distinct()
        walking = walking.union(
            first.filter("refused").join(others, [*by, "wish_key"], "left_semi").select(*columns)
        )
    walking = walking.distinct()
    results = [alone.join(walking, columns, "left_anti")]
    home = at_home.join(walking, columns, "left_semi")
    if lists.known is None:
        lists.known, lists.asked = _no_lists(names, by)
    away = first.filter("refused").join(walking, columns, "left_semi").select(
        *columns, "wish_key", "position", "slot"
    )
    away = away.join(_covering_wish(away, lists.known, by), [*by, "wish_key", "slot"])
    placed = home.unionByName(away.select(*home.columns))
    takers = first.join(walking, columns, "left_semi").select(*columns, "position", "wish_key")
    looked_up, slots, dealt = True, None, False
    if shares or _shared(lists):
        chosen, large = _in_turn(durable(takers), lists, listings, by)
        results += chosen
        if large.isEmpty():
            return _union(results)
        placed, dealt = placed.join(large, columns, "left_semi"), True
    while True:
        if looked_up and (shares or _shared(lists)):
            slots = _slots(lists.every(), listings, by)
        answers = durable(_answers(placed, listings, slots, by))
        again = answers.filter("refused").select(*columns).distinct()
        settled = again.isEmpty()
        done = answers if settled else answers.join(again, columns, "left_anti")
        results.append(done.select(*columns, *_CHOICE))
        if len(results) > _TOGETHER:
            results = [durable(_union(results))]
        if settled:
            return _union(results)
        looked_up = lists.need(_turned_down(answers, by))
        if not dealt:
            takers = durable(takers.join(again, columns, "left_semi"))
            chosen, again = _in_turn(takers, lists, listings, by)
            results, looked_up, dealt = results + chosen, True, True
            if again.isEmpty():
                return _union(results)
        state = answers.join(again, columns, "left_semi").select(*columns, "wish_key", "position", "low")
        spread = durable(_spread(state, by))
        placed = spread.join(_covering_wish(spread, lists.every(), by), [*by, "wish_key", "slot"])


def _shared(lists: _Lists) -> bool:
    return not lists.known.filter("shared").isEmpty()


def _no_lists(names: DataFrame, by: list[str]) -> tuple[DataFrame, DataFrame]:
    none = names.limit(0).withColumnRenamed("offer_key", "key")
    known = none.select(
        *by, F.col("key").alias("wish_key"), F.col("key").alias("offer_key"), F.lit(0).alias("kind"),
        F.col("capacity").alias("first"), F.col("capacity").alias("last"), "capacity", "shared",
    )
    return known, none.select(*by, "key")


def _union(parts: list[DataFrame]) -> DataFrame:
    out, *more = parts
    for part in more:
        out = out.unionByName(part)
    return out


def match_catalog(entries: DataFrame, packages: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Match prepared entries to packages, each package id once per snapshot.

    ``packages`` has ``name, package_id, version, source, ord`` and the ``by`` columns:
    none for one catalog shared by the fleet, ``("host",)`` for a catalog per host.
    The result has every entry with ``position`` (its place in the report),
    ``match_kind`` and ``package_*`` columns, which are null where nothing matched.  It is
    one table in the shared folder; the tables on the way to it are deleted.
    """
    with temporary_tables(entries.sparkSession):
        return durable(_match(entries, packages, list(by)), keep=True)


def _match(entries: DataFrame, packages: DataFrame, by: list[str]) -> DataFrame:
    entries = durable(entries)
    keyed = entries.select(
        *_SNAPSHOT, F.lower("name").alias("_lower"), "registry_path", "ord",
        match_key(F.col("name")).alias("wish_key"),
    )
    ranked = numbered(keyed, _SNAPSHOT, ["_lower", "registry_path", "ord"], "position").drop("_lower")
    catalog = durable(offers(packages, by))
    names = durable(offered_names(catalog, by))
    mates = [*_columns(by), "wish_key"]
    ranked = durable(numbered(ranked, mates, ["position"], "_rank", along("position")))
    asked = ranked.filter(F.col("wish_key") != "").select(*mates, "position", "_rank").join(
        names.drop("first_ord").withColumnRenamed("offer_key", "wish_key"), [*by, "wish_key"], "left"
    )
    listings = catalog.select(*by, "offer_key", "place", "package_id")
    matched = _settle(asked, names, listings, by)
    details = matched.join(
        catalog.select(
            *by, "offer_key", "place", "package_name", "package_version", "package_source"
        ),
        [*by, "offer_key", "place"],
    ).select(
        *_SNAPSHOT,
        "position",
        F.when(F.col("kind") == 0, "exact").otherwise("containment").alias("match_kind"),
        "package_id",
        "package_name",
        "package_version",
        "package_source",
    )
    placed = ranked.drop("wish_key", "_rank").join(details, [*_SNAPSHOT, "position"], "left")
    row = [*_SNAPSHOT, "registry_path", "ord"]
    keyed = placed.select(
        *[F.col(name).alias(f"_{name}") for name in row], *[c for c in placed.columns if c not in row]
    )
    same = F.lit(True)
    for name in row:
        same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
    return entries.join(keyed, same).drop(*[f"_{name}" for name in row])


def match_summary(matches: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    found = F.col("package_id").isNotNull()
    counts = matches.groupBy(*GROUP).agg(
        F.count_if(found).alias("matched"), F.count_if(~found).alias("unmatched")
    )
    if snapshots is not None:
        counts = snapshots.select(*GROUP).distinct().join(counts, _SNAPSHOT, "left").fillna(0)
    return counts
