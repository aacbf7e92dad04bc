"""What changed between two snapshots."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions.keys import IDENTITY_KEYS, identity_keys
from appcensus.operators.dedupe import entry_struct, preference
from appcensus.schema import ENTRY_COLUMNS

# The fields compared between two rows of one application, in order.
COMPARED_FIELDS = (
    "name",
    "version",
    "publisher",
    "install_date",
    "install_location",
    "estimated_size_kb",
    "scope",
    "architecture",
    "uninstall_string",
    "quiet_uninstall_string",
    "release_type",
    "system_component",
)

ADDED, REMOVED, CHANGED, UNCHANGED = "added", "removed", "changed", "unchanged"
STATUSES = (ADDED, REMOVED, CHANGED, UNCHANGED)


def field_changes(old: Column, new: Column) -> Column:
    """The compared fields that differ, nulls included, as text."""
    pairs = [
        F.struct(
            F.lit(field).alias("field"),
            old[field].cast("string").alias("old"),
            new[field].cast("string").alias("new"),
        )
        for field in COMPARED_FIELDS
    ]
    return F.filter(F.array(*pairs), lambda pair: ~pair["old"].eqNullSafe(pair["new"]))


def compared_digest() -> Column:
    """128 bits of the compared fields.  A null differs from any text, and no two lists run together."""
    texts = [F.col(field).cast("string") for field in COMPARED_FIELDS]
    parts = [F.coalesce(F.concat(F.length(t), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.md5(F.concat(*parts)))


def _described(rows: DataFrame, kept: list[str], entry: Column) -> DataFrame:
    """What ``_met`` needs of rows: the columns ``kept``, the application, ``entry``, its rank."""
    return rows.select(
        *kept, *identity_keys(), entry.alias("_entry"), preference().alias("_preference")
    )


def narrowed(rows: DataFrame, kept: list[str]) -> DataFrame:
    """Rows as ``side_statuses`` takes them: of the fields only a digest, name and version."""
    return _described(rows, kept, F.struct(compared_digest().alias("digest"), "name", "version"))


def _met(rows: DataFrame, pair: list[str]) -> DataFrame:
    """``old`` and ``new`` of every application: the entry of the preferred row of each side.

    One aggregate on pair and identity: one shuffle of pre-aggregated rows takes the place of
    two indexes and a full outer join.
    """
    new_side = F.col("is_new")
    row = F.col("_entry")
    return (
        rows.groupBy(*pair, *IDENTITY_KEYS)
        .agg(
            F.min_by(F.when(~new_side, row), F.when(~new_side, F.col("_preference"))).alias("old"),
            F.min_by(F.when(new_side, row), F.when(new_side, F.col("_preference"))).alias("new"),
        )
    )


def _status(is_changed: Column) -> Column:
    return (
        F.when(F.col("old").isNull(), ADDED)
        .when(F.col("new").isNull(), REMOVED)
        .when(is_changed, CHANGED)
        .otherwise(UNCHANGED)
    )


def _heading(pair: list[str]) -> list[Column]:
    old, new = F.col("old"), F.col("new")
    return [
        *[F.col(name) for name in (*pair, *IDENTITY_KEYS, "status")],
        F.coalesce(new["name"], old["name"]).alias("name"),
        old["version"].alias("old_version"),
        new["version"].alias("new_version"),
    ]


def diff_sides(rows: DataFrame, pair: list[str]) -> DataFrame:
    """Classify applications of snapshot pairs.

    ``rows`` holds the entries of both sides, with ``is_new`` telling the side and
    ``pair`` naming the two snapshots compared.
    """
    old, new = F.col("old"), F.col("new")
    changes = F.when(old.isNotNull() & new.isNotNull(), field_changes(old, new))
    return (
        _met(_described(rows, [*pair, "is_new"], entry_struct()), pair)
        .withColumn("changes", changes)
        .withColumn("status", _status(F.size("changes") > 0))
        .select(*_heading(pair), "changes", "old", "new")
    )


def side_statuses(rows: DataFrame, pair: list[str]) -> DataFrame:
    """The first columns of ``diff_sides`` out of ``narrowed`` rows of both sides.

    For callers that need no rows and no fields: a digest decides what has changed.
    """
    changed = F.col("old.digest") != F.col("new.digest")
    return _met(rows, pair).withColumn("status", _status(changed)).select(*_heading(pair))


def _both(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.withColumn("is_new", F.lit(False)).unionByName(new.withColumn("is_new", F.lit(True)))


def compare(old: DataFrame, new: DataFrame, pair: list[str] | None = None) -> DataFrame:
    """Diff two tables of entries, per value of the ``pair`` columns (such as the host)."""
    columns = [*(pair or []), *ENTRY_COLUMNS, "ord"]
    return diff_sides(_both(old.select(*columns), new.select(*columns)), list(pair or []))


def compare_statuses(old: DataFrame, new: DataFrame, pair: list[str] | None = None) -> DataFrame:
    """``compare`` without fields and rows."""
    keys = list(pair or [])
    return side_statuses(_both(narrowed(old, keys), narrowed(new, keys)), keys)


def added(diff: DataFrame, pair: list[str]) -> DataFrame:
    return diff.filter(F.col("status") == ADDED).select(*pair, *IDENTITY_KEYS, "new.*")


def removed(diff: DataFrame, pair: list[str]) -> DataFrame:
    return diff.filter(F.col("status") == REMOVED).select(*pair, *IDENTITY_KEYS, "old.*")


def exploded_changes(diff: DataFrame, pair: list[str]) -> DataFrame:
    """One row per changed field."""
    return diff.filter(F.col("status") == CHANGED).select(
        *pair, *IDENTITY_KEYS, "name", F.inline("changes")
    )


def diff_summary(diff: DataFrame, pair: list[str], pairs: DataFrame | None = None) -> DataFrame:
    """Counts per pair.  Give ``pairs`` to also see pairs of two empty snapshots."""
    counts = [F.count_if(F.col("status") == status).alias(status) for status in STATUSES]
    if not pair:
        return diff.agg(*counts)
    summary = diff.groupBy(*pair).agg(*counts)
    if pairs is not None:
        summary = pairs.select(*pair).distinct().join(summary, pair, "left").fillna(0, list(STATUSES))
    return summary
