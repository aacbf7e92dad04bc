"""From raw rows of many snapshots to the rows and counters of their reports."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.operators.durable import durable
from appcensus.operators.dedupe import COPIES, deduplicate
from appcensus.operators.filters import HIDDEN_SYSTEM, HIDDEN_UPDATE, hidden_reason
from appcensus.operators.shadow import SHADOWED, with_shadowed
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD

COUNTERS = (
    "raw_entry_count",
    "deduplicated_count",
    "filtered_system_component_count",
    "filtered_update_count",
    "result_count",
)


def judged(entries: DataFrame, **options) -> DataFrame:
    """One row per application with ``copies``, ``shadowed`` and ``reason``, in one pass.

    The filters come last on purpose: a hidden registry row still shadows.
    """
    return with_shadowed(deduplicate(entries)).withColumn("reason", hidden_reason(**options))


def _is_shown() -> Column:
    return ~F.col(SHADOWED) & F.col("reason").isNull()


def shown_rows(rows: DataFrame) -> DataFrame:
    """The rows of the reports out of judged ones."""
    return rows.filter(_is_shown()).drop("reason", SHADOWED, COPIES)


def prepare(entries: DataFrame, **options) -> DataFrame:
    """Rows of the reports, one snapshot after the other."""
    return shown_rows(judged(entries, **options))


def written_judged(entries: DataFrame, **options) -> DataFrame:
    """``judged`` as a table, for callers that need rows and counters.

    Rows that are not shown only count, and are written without their fields.
    """
    rows = judged(entries, **options)
    told = {name: F.when(_is_shown(), F.col(name)).alias(name) for name in (*ENTRY_COLUMNS, ORD)}
    return durable(rows.select(*[told.get(name, F.col(name)) for name in rows.columns]))


def report_order() -> list:
    """Order within a report: name, then path, then first appearance."""
    return [F.lower(F.col("name")), F.col("registry_path"), F.col(ORD)]


def in_report_order(prepared: DataFrame) -> DataFrame:
    return prepared.select(*GROUP, *ENTRY_COLUMNS, ORD).orderBy(*GROUP, *report_order())


def prepare_stats(
    entries: DataFrame, snapshots: DataFrame | None = None, **options
) -> DataFrame:
    """What each step removed, one row per snapshot.

    Give ``snapshots`` (at least the group columns) to also see empty snapshots.
    """
    return counters(judged(entries, **options), snapshots)


def counters(rows: DataFrame, snapshots: DataFrame | None = None) -> DataFrame:
    """``prepare_stats`` of judged rows."""
    left, reason = ~F.col(SHADOWED), F.col("reason")
    counts = (
        rows
        .groupBy(*GROUP)
        .agg(
            F.sum(COPIES).alias("raw_entry_count"),
            F.count_if(left).alias("_left"),
            F.count_if(left & (reason == HIDDEN_SYSTEM)).alias("filtered_system_component_count"),
            F.count_if(left & (reason == HIDDEN_UPDATE)).alias("filtered_update_count"),
            F.count_if(left & reason.isNull()).alias("result_count"),
        )
    )
    if snapshots is not None:
        counts = snapshots.select(*GROUP).distinct().join(counts, list(GROUP), "left")
    counts = counts.fillna(
        0,
        subset=[
            "raw_entry_count",
            "_left",
            "filtered_system_component_count",
            "filtered_update_count",
            "result_count",
        ],
    )
    removed = F.greatest(F.lit(0), F.col("raw_entry_count") - F.col("_left"))
    return counts.withColumn("deduplicated_count", removed.cast("bigint")).select(
        *GROUP, *COUNTERS
    )
