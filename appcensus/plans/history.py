"""Snapshots of the same host over time."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from appcensus.operators.diff import diff_sides, narrowed, side_statuses
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD

PAIR = ["host", "old_snapshot_id", "snapshot_id"]

_NO_DAY = "0001-01-01"
"""The day of scans without a time: before all others, as null is."""


def snapshots_of(entries: DataFrame) -> DataFrame:
    """The snapshots that have rows; keep a snapshot table to know the empty ones too."""
    return entries.groupBy(*GROUP).agg(F.min("scan_ts").alias("scan_ts"))


def latest_snapshots(snapshots: DataFrame) -> DataFrame:
    newest = F.max_by("snapshot_id", F.struct("scan_ts", "snapshot_id"))
    return snapshots.groupBy("host").agg(newest.alias("snapshot_id"))


def latest_inventory(entries: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """Rows of the newest snapshot of every host."""
    known = snapshots if snapshots is not None else snapshots_of(entries)
    return entries.join(latest_snapshots(known), list(GROUP), "left_semi")


def previous_snapshots(snapshots: DataFrame) -> DataFrame:
    """Pair every snapshot with the one before it on the same host.

    The first snapshot of a host has none and is left out.  The scans of a host are taken day
    by day, so a host with a third of all scans is as many groups as it has days; each day hands
    its last scan on to the next day that has any.
    """
    day = F.coalesce(F.to_date("scan_ts"), F.lit(_NO_DAY).cast("date"))
    known = snapshots.select(*GROUP, "scan_ts", day.alias("_day"))
    in_day = Window.partitionBy("host", "_day").orderBy("scan_ts", "snapshot_id")
    scans = known.withColumn("_before", F.lag(F.struct("snapshot_id")).over(in_day))

    # A row per host and day.
    last = F.max_by(F.struct("snapshot_id"), F.struct("scan_ts", "snapshot_id"))
    over_days = Window.partitionBy("host").orderBy("_day")
    carried = (
        known.groupBy("host", "_day").agg(last.alias("_last"))
        .withColumn("_carried", F.lag("_last").over(over_days))
        .filter(F.col("_carried").isNotNull())
        .select(F.col("host").alias("_host"), F.col("_day").alias("_of"), "_carried")
    )
    met = F.col("host").eqNullSafe(F.col("_host")) & (F.col("_day") == F.col("_of"))
    old = F.coalesce("_before", "_carried")
    return (
        scans.join(carried, met, "left")
        .filter(old.isNotNull())
        .select("host", old["snapshot_id"].alias("old_snapshot_id"), "snapshot_id")
    )


def _consecutive_sides(
    entries: DataFrame, rows: DataFrame, snapshots: DataFrame | None, pairs: DataFrame | None
) -> DataFrame:
    """``rows``, made of ``entries``, on both sides of the pairs they are in."""
    if pairs is None:
        known = snapshots if snapshots is not None else snapshots_of(entries)
        pairs = previous_snapshots(known)
    roles = pairs.select(
        *[F.col(key).alias(f"_{key}") for key in PAIR],
        F.explode(
            F.array(
                F.struct(F.col("snapshot_id").alias("of"), F.lit(True).alias("is_new")),
                F.struct(F.col("old_snapshot_id").alias("of"), F.lit(False).alias("is_new")),
            )
        ).alias("_role"),
    ).select("_host", "_old_snapshot_id", "_snapshot_id", "_role.*")
    roles = roles.withColumnRenamed("_host", "host").withColumnRenamed("of", "snapshot_id")
    return (
        rows.join(roles, list(GROUP))
        .drop("snapshot_id")
        .withColumnRenamed("_old_snapshot_id", "old_snapshot_id")
        .withColumnRenamed("_snapshot_id", "snapshot_id")
    )


def consecutive_diff(
    entries: DataFrame, snapshots: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """Diff every snapshot with the one before it on the same host.

    Each row takes part twice, as the new side of one pair and the old side of the
    next.  The pairs come from the snapshot table, so that a snapshot without rows
    still makes all earlier rows removed.
    """
    rows = entries.select(*GROUP, *ENTRY_COLUMNS, ORD)
    return diff_sides(_consecutive_sides(entries, rows, snapshots, pairs), PAIR)


def consecutive_statuses(
    entries: DataFrame, snapshots: DataFrame | None = None, pairs: DataFrame | None = None
) -> DataFrame:
    """``consecutive_diff`` without fields and rows: all that moves are digests."""
    rows = narrowed(entries, list(GROUP))
    return side_statuses(_consecutive_sides(entries, rows, snapshots, pairs), PAIR)
