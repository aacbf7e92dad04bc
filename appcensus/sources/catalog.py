"""Package catalogs as JSON files or as captured text listings."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions.keys import IMPORTABLE_SOURCES
from appcensus.functions.text import clean, lstrip, strip
from appcensus.schema import ORD
from appcensus.sources.files import without_bom
from appcensus.sources.variants import (
    as_filled_text,
    as_text,
    field,
    is_array,
    is_object,
    json_value,
    kind,
    worked_out,
)

OTHER_BREAKS = r"\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}"
"""What ends a line beside carriage return and line feed, within a class of an expression."""

COLUMNS = ("Name", "Id", "Version", "Available", "Source")


def _package_id(item: Column) -> Column:
    """The id, or the package id where there is none.  An id of blanks is one that is bad."""
    blank = F.try_variant_get(item, "$.id", "string").rlike(r"^\s+$") & (
        kind(field(item, "id")) == "STRING"
    )
    other = F.when(~F.coalesce(blank, F.lit(False)), as_filled_text(item, "package_id"))
    return F.coalesce(as_filled_text(item, "id"), other)


def parse_catalogs(texts: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per catalog file: ``status``, ``reason``, the package values and ``keep``."""
    doc = F.col("_doc")
    items = F.col("_items")
    parsed = worked_out(texts, "_doc", json_value(without_bom(F.col("text"))))
    inner = field(doc, "packages")
    parsed = worked_out(
        parsed, "_list", F.when(is_object(doc) & inner.isNotNull(), inner).otherwise(doc)
    )
    parsed = worked_out(
        parsed,
        "_items",
        F.when(is_array(F.col("_list")), F.try_variant_get("_list", "$", "array<variant>")),
    )
    reason = (
        F.when(doc.isNull(), "invalid JSON")
        .when(items.isNull(), "not a list of packages")
        .when(F.exists(items, lambda item: ~is_object(item)), "a row is not an object")
        .when(
            F.exists(
                items,
                lambda item: as_filled_text(item, "name").isNull() | _package_id(item).isNull(),
            ),
            "a row has no name or id",
        )
    )
    return worked_out(parsed, "reason", reason).select(
        "path",
        F.when(F.col("reason").isNull(), "ok").otherwise("bad").alias("status"),
        "reason",
        F.when(F.col("reason").isNull(), items).alias("items"),
        *keep,
    )


def catalog_packages(parsed: DataFrame) -> DataFrame:
    rows = parsed.filter(F.col("status") == "ok").select(
        "path", F.posexplode("items").alias(ORD, "_item")
    )
    return item_packages(rows)


def item_packages(rows: DataFrame) -> DataFrame:
    """Package rows out of package values: ``path, ord, _item``."""
    item = F.col("_item")
    return rows.select(
        "path",
        as_filled_text(item, "name").alias("name"),
        _package_id(item).alias("package_id"),
        F.when(kind(field(item, "version")) != "VOID", as_text(item, "version")).alias("version"),
        F.coalesce(as_filled_text(item, "source"), F.lit("")).alias("source"),
        F.col(ORD).cast("bigint").alias(ORD),
    )


def is_header(line: Column) -> Column:
    labels = (F.contains(line, F.lit(label)) for label in COLUMNS[:3])
    found = F.lit(True)
    for label in labels:
        found = found & label
    return found & ~F.startswith(lstrip(line), F.lit("-"))


def column_starts(header: Column) -> Column:
    """Where the columns begin, counted from 1; null for one that the header lacks."""
    return F.struct(
        *[
            F.when(F.contains(header, F.lit(label)), F.instr(header, label)).alias(label)
            for label in COLUMNS
        ]
    )


def is_rule(line: Column) -> Column:
    """A line that parts the header from the data."""
    return strip(line).rlike("^[- ]*$")


def parse_listing_texts(texts: DataFrame) -> DataFrame:
    """One row per listing: ``status``, ``reason``, the column starts and data lines.

    The header may stand anywhere; what precedes it is noise.
    """
    lines = F.filter(
        F.transform(
            F.split(F.col("text"), rf"\r\n|[\n\r{OTHER_BREAKS}]"),
            lambda line: F.rtrim(line, F.lit("\r")),
        ),
        lambda line: strip(line) != "",
    )
    parsed = worked_out(texts, "_lines", lines)
    header_at = F.array_position(F.transform("_lines", is_header), F.lit(True))
    parsed = worked_out(parsed, "_at", F.when(header_at > 0, header_at))
    parsed = parsed.withColumn("_header", F.try_element_at("_lines", F.col("_at").cast("int")))
    following = F.slice("_lines", F.col("_at").cast("int") + 1, F.size("_lines"))
    ruled = F.coalesce(is_rule(F.try_element_at(following, F.lit(1))), F.lit(False))
    data = F.when(ruled, F.slice(following, 2, F.size(following))).otherwise(following)
    reason = F.when(F.col("_at").isNull(), "no header with Name, Id and Version")
    return parsed.select(
        "path",
        F.when(reason.isNull(), "ok").otherwise("bad").alias("status"),
        reason.alias("reason"),
        column_starts(F.col("_header")).alias("starts"),
        F.when(reason.isNull(), data).alias("lines"),
    )


def _column_end(starts: Column, label: str) -> Column:
    """Start of the next column to the right; null for the last column."""
    later = [
        F.when(starts[other] > starts[label], starts[other]) for other in COLUMNS if other != label
    ]
    return F.least(*later)


def _part(line: Column, start: Column, end: Column) -> Column:
    """Characters from ``start`` up to ``end``, counted from 1; null ``end`` is open."""
    length = F.coalesce(end, F.length(line) + 1) - start
    return F.substr(line, start, F.greatest(length, F.lit(0)))


def listing_packages(parsed: DataFrame) -> DataFrame:
    """Package rows of the usable listings."""
    rows = parsed.filter(F.col("status") == "ok").select(
        "path", "starts", F.posexplode("lines").alias(ORD, "line")
    )
    return line_packages(rows)


def line_packages(rows: DataFrame) -> DataFrame:
    """Package rows out of data lines: ``path, starts, ord, line``.

    The source is the last word right of the version if that names a known source,
    since listings do not keep the source column aligned; else the source column, else
    that column begun one character earlier.
    """
    line, starts = F.col("line"), F.col("starts")
    rows = rows.filter(
        ~F.startswith(lstrip(line), F.lit("---"))
        & ~F.contains(line, F.lit("\x08"))
        & ~F.startswith(line, F.lit("  "))
    )
    cut = {
        label: strip(_part(line, starts[label], _column_end(starts, label)))
        for label in ("Name", "Id", "Version", "Source")
    }
    version_end = _column_end(starts, "Version")
    spaces = r"(?U)[\s\x1c-\x1f]+"
    tail = strip(F.substr(line, version_end))
    last = F.element_at(F.split(tail, spaces), -1)
    widened = F.element_at(F.split(strip(F.substr(line, starts["Source"] - 1)), spaces), 1)
    source = F.coalesce(
        F.when(version_end.isNotNull() & F.lower(last).isin(*IMPORTABLE_SOURCES), last),
        F.when(cut["Source"] != "", cut["Source"]),
        F.when(starts["Source"] > 1, widened),
        F.lit(""),
    )
    return rows.filter((cut["Name"] != "") & (cut["Id"] != "")).select(
        "path",
        cut["Name"].alias("name"),
        cut["Id"].alias("package_id"),
        clean(cut["Version"]).alias("version"),
        source.alias("source"),
        F.col(ORD).cast("bigint").alias(ORD),
    )
