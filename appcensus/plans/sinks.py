"""Writing reports, documents and the snapshot history."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcensus.plans.archive import History
from appcensus.plans.documents import ORDER, csv_rows
from appcensus.plans.prepare import report_order
from appcensus.schema import ENTRY_COLUMNS, GROUP


def _folder_name(column: str):
    """A name for every value and no two with the same, null and empty text included."""
    value = F.col(column).cast("string")
    return F.when(value.isNull(), "null").otherwise(F.concat(F.lit("is "), F.url_encode(value)))


def _ranged(df: DataFrame, order: list, parts: int | None) -> DataFrame:
    slices = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartitionByRange(slices, *order)


def write_documents(pieces: DataFrame, group: list[str], path: str, parts: int | None = None):
    """Write documents as text, a folder per document; meant for chosen hosts.

    The pieces are range-partitioned by their real keys: a large document is several files
    whose names sort in its order, and small ones share a task.
    """
    keys = [f"of_{name}" for name in group]
    rows = _ranged(pieces.select(*group, *ORDER, "piece"), [*group, *ORDER], parts)
    named = rows.withColumns({key: _folder_name(name) for name, key in zip(group, keys)})
    ordered = named.sortWithinPartitions(*keys, *ORDER)
    ordered.select(*keys, "piece").write.partitionBy(*keys).text(path)


def write_document_rows(pieces: DataFrame, group: list[str], path: str, parts: int | None = None):
    """Write the documents of a whole fleet as few large files.

    Rows are the group columns, the order columns and the piece, sorted, in Parquet: millions
    of snapshots are no folders, and a reader picks a document by its keys.
    """
    order = [*group, *ORDER]
    rows = _ranged(pieces.select(*order, "piece"), order, parts)
    rows.sortWithinPartitions(*order).write.parquet(path)


_CSV = {"header": True, "nullValue": "", "emptyValue": "", "escape": '"', "lineSep": "\n"}


def write_csv(prepared: DataFrame, path: str) -> None:
    """Write host, snapshot and the public columns as CSV with a header, in report order."""
    sorted_rows = prepared.orderBy(*GROUP, *report_order())
    csv_rows(sorted_rows, list(GROUP)).write.csv(path, **_CSV)


def write_csv_per_snapshot(prepared: DataFrame, path: str, parts: int | None = None) -> None:
    """Write the public columns as CSV with a header, a folder per snapshot."""
    rows = _ranged(prepared, [*GROUP, *report_order()], parts)
    keys = {f"of_{name}": _folder_name(name) for name in GROUP}
    ordered = rows.withColumns(keys).sortWithinPartitions(*keys, *report_order())
    csv_rows(ordered, list(keys)).write.partitionBy(*keys).csv(path, **_CSV)


def write_rows_json(prepared: DataFrame, path: str) -> None:
    """Write rows as JSON lines that keep their nulls."""
    prepared.select(*GROUP, *ENTRY_COLUMNS).write.json(path, ignoreNullFields=False)


def write_history(prepared: DataFrame, path: str, snapshots: DataFrame | None = None) -> None:
    """Merge prepared rows into the history below ``path``.

    Snapshots that come again replace themselves and nothing else.
    """
    History(prepared.sparkSession, path).merge(prepared, snapshots)
