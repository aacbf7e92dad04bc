"""JSON catalogs of any size, read by byte range.

``parse_catalogs`` holds a catalog in one row.  Here a file is cut at every closing brace, where
it lies.  Whether a cut is within a text, and how deep it is, follows from the quotes and brackets
before it, which are handed on from range to range as running totals.  So every package becomes a
row of its own, and what stands around the packages (the frame) is small.

A file is a list of packages, or an object with such a list; other fields of the object may hold
objects, but no lists of them (such a file is bad here: read it whole).  A file with one bad package is bad as a whole, as with ``parse_catalogs``.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.operators.durable import durable
from appcensus.operators.running import running
from appcensus.schema import ORD
from appcensus.sources.catalog import item_packages, parse_catalogs

SALTS = 16
"""Parts that the packages of one file are dealt into where they meet its status."""

_PLACE = ["_block", "_at"]
_ANY_PACKAGE = '{"name":"n","id":"i"}'
_COMMA = r"^[ \t\n\r]*,[ \t\n\r]*$"


def _fragments(spark: SparkSession, folder: str) -> DataFrame:
    """What lies between closing braces, with its place.  Written, as places follow the splits."""
    cut = spark.read.option("lineSep", "}").text(folder)
    return durable(
        cut.select(
            F.col("_metadata.file_path").alias("path"),
            F.col("_metadata.file_size").alias("_bytes"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_at"),
            F.col("value").alias("text"),
        )
    )


def _handed_on(rows: DataFrame, **totals) -> DataFrame:
    """``rows`` with running totals, written, so that the next totals do not repeat these."""
    return durable(running(rows, ["path"], _PLACE, totals, slices=F.col("_block")))


def _count(text: Column, character: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(character), F.lit("")))


def _deeper(text: Column) -> Column:
    return _count(text, "[") - _count(text, "]")


def _cut(mask: Column, braces: Column, brackets: Column, base: Column) -> Column:
    """Characters before the brace that opens a package; null without one."""

    def step(state: Column, piece: Column) -> Column:
        at = state["at"] + F.length(piece)
        here = state["brackets"] + _deeper(piece)
        opens = (here == 1) & (state["braces"] == base - 1)
        return F.struct(
            (state["braces"] + 1).alias("braces"), here.alias("brackets"), (at + 1).alias("at"),
            F.coalesce(state["found"], F.when(opens, at)).alias("found"),
        )

    pieces = F.split(mask, r"\{", -1)
    begun = F.struct(
        braces.cast("int").alias("braces"), brackets.cast("int").alias("brackets"),
        F.lit(0).alias("at"), F.lit(None).cast("int").alias("found"),
    )
    return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), begun, step)["found"]


def _numbered_pieces(fragments: DataFrame) -> DataFrame:
    """Fragments parted in what belongs to package ``_number`` and what stands between packages."""
    # Escaped characters are neither quotes nor brackets; all places stay.
    plain = F.regexp_replace("text", r"(?s)\\.", "__")
    parts = F.split(plain, '"', -1)
    own_quotes = (F.size(parts) - 1).cast("bigint")
    start = F.ltrim(F.col("text"), F.lit(" \t\r\n"))
    opening = F.struct(
        (-F.col("_block")).alias("block"), (-F.col("_at")).alias("at"),
        F.when(F.startswith(start, F.lit("{")), 2).otherwise(1).alias("base"),
    )
    rows = _handed_on(
        fragments, _quotes=("sum", own_quotes), _opening=("max", F.when(start != "", opening))
    )
    in_text = (F.col("_quotes") - own_quotes) % 2
    mask = F.array_join(
        F.transform(
            parts,
            lambda part, i: F.when((i + in_text) % 2 == 1, F.repeat(F.lit("_"), F.length(part))).otherwise(part),
        ),
        '"',
    )
    rows = rows.withColumn("_mask", mask).withColumn("_base", F.coalesce("_opening.base", F.lit(1)))
    closes = 1 - F.col("_quotes") % 2
    own_braces = _count(F.col("_mask"), "{").cast("bigint") - closes
    own_brackets = _deeper(F.col("_mask")).cast("bigint")
    rows = _handed_on(
        rows.drop("_opening"), _braces=("sum", own_braces), _brackets=("sum", own_brackets)
    )
    braces, brackets = F.col("_braces") - own_braces, F.col("_brackets") - own_brackets
    rows = rows.withColumn("_within", (braces + brackets > F.col("_base")) & (brackets > 0))
    cut = F.when(~F.col("_within"), _cut(F.col("_mask"), braces, brackets, F.col("_base")))
    rows = rows.withColumn("_cut", cut)
    opened = F.col("_cut").isNotNull().cast("bigint")
    return _handed_on(rows.drop("_mask"), _number=("sum", opened))


def read_catalog_items(spark: SparkSession, folder: str) -> DataFrame:
    """``path, number, item, gap``: packages from 1 on, each with what follows it.

    Number 0 is what stands before the first one.  ``size`` is the number of bytes read.
    """
    rows = _numbered_pieces(_fragments(spark, folder))
    cut, text = F.col("_cut"), F.concat("text", F.lit("}"))
    item = F.when(F.col("_within"), text).when(cut.isNotNull(), F.substr(text, cut + 1))
    gap = F.when(~F.col("_within"), F.when(cut.isNotNull(), F.substr(text, F.lit(1), cut)).otherwise(text))
    number = F.col("_number")
    # What precedes the package that a fragment opens follows the package before.
    follows = F.when(cut.isNotNull(), number - 1).otherwise(number)
    none = F.lit(None).cast("string")
    pieces = F.array(
        *[
            F.struct(place.alias("number"), own.alias("item"), after.alias("gap"))
            for place, own, after in ((number, item, none), (follows, none, gap))
        ]
    )
    size = F.octet_length("text") + 1
    rows = rows.select(
        "path", "_bytes", *_PLACE, size.alias("_size"), F.posexplode(pieces).alias("_side", "_piece")
    ).filter("_piece.item is not null or _piece.gap is not null or _side = 0")

    def joined(name: str) -> Column:
        part = F.col(f"_piece.{name}")
        parts = F.collect_list(F.when(part.isNotNull(), F.struct(*_PLACE, part.alias("text"))))
        return F.array_join(F.transform(F.array_sort(parts), lambda p: p["text"]), "").alias(name)

    # A group is one package.
    grouped = rows.groupBy("path", F.col("_piece.number").alias("number")).agg(
        joined("item"), joined("gap"), F.max("_bytes").alias("bytes"),
        F.sum(F.when(F.col("_side") == 0, F.col("_size"))).alias("size"),
    )
    return durable(grouped)


def _parsed_items(items: DataFrame) -> DataFrame:
    texts = items.filter("number > 0").select(
        "path", "number", F.concat(F.lit("["), "item", F.lit("]")).alias("text")
    )
    return parse_catalogs(texts, keep=("number",))


def catalog_file_status(items: DataFrame) -> DataFrame:
    """``path, status, reason`` of every file that holds a byte."""
    between = (F.col("number") > 0) & ~F.col("gap").rlike(_COMMA)
    files = items.groupBy("path").agg(
        F.max("number").alias("n"),
        F.min_by("gap", "number").alias("prefix"),
        F.max_by("gap", "number").alias("suffix"),
        F.count_if(between).alias("between"),
        F.count_if((F.col("number") == 0) & (F.col("item") != "")).alias("lost"),
        F.sum("size").alias("size"),
        F.max("bytes").alias("bytes"),
    )
    # The last fragment ends with the file, not with a brace: one byte too many was counted.  A
    # byte order mark, three bytes, is not read.
    open_end = (F.col("size") - F.col("bytes")).isin(1, -2)
    frame = F.when(F.col("n") == 0, F.col("prefix")).otherwise(
        F.concat("prefix", F.lit(_ANY_PACKAGE), "suffix")
    )
    frame = F.when(open_end, F.substr(frame, F.lit(1), F.length(frame) - 1)).otherwise(frame)
    framed = parse_catalogs(files.withColumn("text", frame), keep=("n", "between", "lost"))
    plain = (F.col("n") == 0) | ((F.col("between") == 1) & (F.size("items") == 1))
    other = ~plain | (F.col("lost") > 0)
    framed = framed.select(
        "path",
        F.coalesce("reason", F.when(other, "more than a list of packages")).alias("_reason"),
    )
    bad = _parsed_items(items).groupBy("path").agg(F.min("reason").alias("_bad"))
    reason = F.coalesce("_reason", "_bad")
    return framed.join(bad, "path", "left").select(
        "path", F.when(reason.isNull(), "ok").otherwise("bad").alias("status"), reason.alias("reason")
    )


def catalog_file_packages(items: DataFrame) -> DataFrame:
    """Package rows of the usable files, as ``catalog_packages`` gives them."""
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    usable = catalog_file_status(items).filter("status = 'ok'").select("path", salts.alias("_salt"))
    rows = _parsed_items(items).select(
        "path", (F.col("number") - 1).alias(ORD), F.get("items", F.lit(0)).alias("_item"),
        (F.col("number") % SALTS).cast("int").alias("_salt"),
    )
    return item_packages(rows.join(usable, ["path", "_salt"]))
