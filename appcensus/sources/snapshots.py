"""Snapshot files: a report with ``schema_version`` and ``scan``, or a bare array."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions.text import clean
from appcensus.functions.values import INTEGER_TEXT
from appcensus.operators.durable import durable
from appcensus.schema import (
    ENTRY_COLUMNS,
    GROUP,
    ORD,
    READABLE_VERSIONS,
    SCAN_SCHEMA,
    SOURCE_REGISTRY,
)
from appcensus.sources.files import without_bom
from appcensus.sources.variants import (
    field,
    fields_of,
    is_array,
    is_object,
    is_truthy,
    json_value,
    kind,
    shown_text,
    worked_out,
)

_SIZE = "estimated_size_kb"


def _size(raw: Column, text: Column) -> Column:
    """Size of a stored row: negatives stay, fractions of numbers are cut off."""
    whole = F.replace(clean(text), F.lit("_"), F.lit("")).try_cast("bigint")
    return F.when(kind(raw) == "STRING", whole).otherwise(F.try_variant_get(raw, "$", "bigint"))


def _bad_size(item: Column) -> Column:
    shape = kind(field(item, _SIZE))
    text = F.try_variant_get(item, f"$.{_SIZE}", "string")
    junk = (text != "") & ~F.coalesce(clean(text), F.lit("")).rlike(INTEGER_TEXT)
    return F.coalesce(
        F.when(shape == "STRING", junk)
        .when(shape == "VOID", F.lit(False))
        .otherwise(F.startswith(shape, F.lit("ARRAY")) | F.startswith(shape, F.lit("OBJECT"))),
        F.lit(False),
    )


def _bad_name(item: Column) -> Column:
    text = clean(F.try_variant_get(item, "$.name", "string"))
    return (kind(field(item, "name")) != "STRING") | text.isNull()


def parse_snapshots(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per file: ``status``, ``reason``, the scan block, the row values and ``keep``.

    A file with one bad row is bad as a whole.  The check runs inside the array of the
    file, so it takes no shuffle.
    """
    doc = F.col("_doc")
    items = F.col("_items")
    parsed = worked_out(texts, "_doc", json_value(without_bom(F.col("text"))))
    parsed = parsed.withColumn("_is_report", is_object(doc))
    parsed = worked_out(
        parsed,
        "_items",
        F.when(is_array(doc), F.try_variant_get(doc, "$", "array<variant>")).otherwise(
            F.try_variant_get(doc, "$.software", "array<variant>")
        ),
    )
    version = field(doc, "schema_version")
    version_text = F.try_variant_get(doc, "$.schema_version", "string")
    reason = (
        F.when(doc.isNull(), "invalid JSON")
        .when(~F.col("_is_report") & ~is_array(doc), "neither a report nor a list of rows")
        .when(F.col("_is_report") & (kind(version) == "VOID"), "schema_version is missing")
        .when(
            F.col("_is_report")
            & ((kind(version) != "STRING") | ~version_text.isin(*READABLE_VERSIONS)),
            "schema_version is not supported",
        )
        .when(F.col("_is_report") & ~is_array(field(doc, "software")), "software is not a list")
        .when(
            F.exists(items, lambda item: is_object(item) & _bad_name(item)), "a row has no name"
        )
        .when(
            F.exists(items, lambda item: is_object(item) & _bad_size(item)),
            "a row has a bad estimated_size_kb",
        )
    )
    scan = F.try_variant_get(doc, "$.scan", SCAN_SCHEMA.simpleString())
    return worked_out(parsed, "reason", reason).select(
        "path",
        F.when(F.col("reason").isNull(), "ok").otherwise("bad").alias("status"),
        "reason",
        scan.alias("scan"),
        F.when(F.col("reason").isNull(), items).alias("items"),
        *keep,
    )


def _named(field: str) -> Column:
    return F.coalesce(clean(F.col(field)), F.col("path"))


def snapshot_table(parsed: DataFrame) -> DataFrame:
    """One row per usable file.  A bare array is known by its path."""
    return parsed.filter(F.col("status") == "ok").select(
        _named("scan.hostname").alias("host"),
        _named("scan.started_at").alias("snapshot_id"),
        F.try_to_timestamp(F.col("scan.started_at")).alias("scan_ts"),
        "path",
        "scan",
        "items",
    )


def _repeated(table: DataFrame) -> DataFrame:
    """``path, repeats``: files whose snapshot another file with a smaller path gives too."""
    paths = table.select(*GROUP, "path")
    first = paths.groupBy(*[F.col(key).alias(f"_{key}") for key in GROUP]).agg(
        F.min("path").alias("_first"), F.max("path").alias("_last")
    )
    same = (F.col("host") == F.col("_host")) & (F.col("snapshot_id") == F.col("_snapshot_id"))
    return (
        paths.join(first.filter("_first <> _last"), same)
        .filter(F.col("path") != F.col("_first"))
        .select("path", F.col("_first").alias("repeats"))
    )


def unique_snapshots(table: DataFrame) -> DataFrame:
    """One row per snapshot: of several files the one with the smallest path counts.

    ``snapshot_status`` names the others.
    """
    return table.join(_repeated(table).select("path"), "path", "left_anti").select(*table.columns)


def snapshot_status(parsed: DataFrame) -> DataFrame:
    """``path, status, reason`` of every file: ok, bad, or repeated.

    Files are parsed once, and what is told of them is written down.
    """
    names = {"host": _named("scan.hostname"), "snapshot_id": _named("scan.started_at")}
    told = parsed.select("path", "status", "reason", *[value.alias(name) for name, value in names.items()])
    told = durable(told)
    again = _repeated(told.filter(F.col("status") == "ok")).withColumnRenamed("path", "_path")
    marked = told.join(again, F.col("path") == F.col("_path"), "left")
    repeats = F.col("repeats").isNotNull()
    return marked.select(
        "path",
        F.when(repeats, "repeated").otherwise(F.col("status")).alias("status"),
        F.when(repeats, F.concat(F.lit("the same snapshot is in "), "repeats"))
        .otherwise(F.col("reason"))
        .alias("reason"),
    )


def rehydrate(raw: Column, text: Column) -> dict[str, Column]:
    """Entry fields out of the fields of a stored row."""
    fields = {
        name: shown_text(raw[name], text[name])
        for name in ENTRY_COLUMNS
        if name not in (_SIZE, "system_component")
    }
    fields["scope"] = F.coalesce(fields["scope"], F.lit("unknown"))
    fields["architecture"] = F.coalesce(fields["architecture"], F.lit("unknown"))
    fields["registry_path"] = F.coalesce(fields["registry_path"], F.lit(""))
    fields["source"] = F.lower(F.coalesce(fields["source"], F.lit(SOURCE_REGISTRY)))
    fields[_SIZE] = _size(raw[_SIZE], text[_SIZE])
    fields["system_component"] = is_truthy(raw["system_component"], text["system_component"])
    return fields


def snapshot_entries(snapshots: DataFrame) -> DataFrame:
    """Rows of the snapshots; items that are no objects are skipped."""
    rows = snapshots.select(*GROUP, "scan_ts", F.posexplode("items").alias(ORD, "_item"))
    raw, text = fields_of(F.col("_item"), ENTRY_COLUMNS)
    rows = worked_out(rows.filter(is_object(F.col("_item"))), "_raw", raw)
    rows = worked_out(rows, "_text", text)
    fields = rehydrate(F.col("_raw"), F.col("_text"))
    return rows.select(
        *GROUP,
        "scan_ts",
        *[fields[name].alias(name) for name in ENTRY_COLUMNS],
        F.col(ORD).cast("bigint").alias(ORD),
    )
