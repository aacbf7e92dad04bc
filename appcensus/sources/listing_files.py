"""Text listings of any size, read by byte range.

``parse_listing_texts`` holds a listing in one row.  Here a file is as many tasks as it has byte
ranges: lines are read where they lie, and what a line needs of those before it (the spans of the
header, its own number) is handed on from range to range.  Both ways give the same rows.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.functions.text import strip
from appcensus.operators.durable import durable
from appcensus.operators.running import running
from appcensus.schema import ORD
from appcensus.sources.catalog import (
    OTHER_BREAKS,
    column_starts,
    is_header,
    is_rule,
    line_packages,
)

_PLACE = ["_block", "_at", "_piece"]
"""The place of a line in its file: byte range, line within the range, piece of the line."""


def read_listing_lines(spark: SparkSession, folder: str) -> DataFrame:
    """``path``, the place and the text of every line that is not blank.

    The lines are written down, since their places depend on how the files were split.
    """
    whole = spark.read.text(folder).select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_at"),
        F.posexplode(F.split("value", f"[{OTHER_BREAKS}]")).alias("_piece", "line"),
    )
    return durable(whole.filter(strip(F.col("line")) != ""))


def _here(*more: Column) -> Column:
    """The place of a row, so that the largest of many is the first of them."""
    return F.struct(*[(-F.col(name)).alias(name) for name in _PLACE], *more)


def _handed_on(rows: DataFrame, **totals) -> DataFrame:
    return running(rows, ["path"], _PLACE, totals, slices=F.col("_block"))


def _data_lines(lines: DataFrame) -> DataFrame:
    """``path, starts, ord, line`` of the lines below the first header of their file."""
    header = _here(column_starts(F.col("line")).alias("starts"))
    rows = _handed_on(lines, _header=("max", F.when(is_header(F.col("line")), header)))
    is_own = F.lit(True)
    for name in _PLACE:
        is_own = is_own & (F.col(f"_header.{name}") == -F.col(name))
    below = rows.filter(F.col("_header").isNotNull() & ~is_own)

    first = _here(is_rule(F.col("line")).alias("is_rule"))
    below = _handed_on(below, _number=("sum", F.lit(1).cast("bigint")), _first=("max", first))
    ruled = F.col("_first.is_rule").cast("bigint")
    return below.select(
        "path", F.col("_header.starts").alias("starts"), (F.col("_number") - 1 - ruled).alias(ORD), "line"
    ).filter(F.col(ORD) >= 0)


def listing_file_packages(lines: DataFrame) -> DataFrame:
    """Package rows of the listings, as ``listing_packages`` gives them."""
    return line_packages(_data_lines(lines))


def listing_file_status(spark: SparkSession, folder: str, lines: DataFrame) -> DataFrame:
    """``path, status, reason`` of every file of the folder that holds a byte."""
    files = spark.read.format("binaryFile").load(folder).select(
        F.col("_metadata.file_path").alias("path")
    )
    usable = lines.filter(is_header(F.col("line"))).select(F.col("path").alias("_path")).distinct()
    found = F.col("_path").isNotNull()
    return files.join(usable, F.col("path") == F.col("_path"), "left").select(
        "path",
        F.when(found, "ok").otherwise("bad").alias("status"),
        F.when(~found, "no header with Name, Id and Version").alias("reason"),
    )
