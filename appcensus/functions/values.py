"""Typed values out of captured text, and text out of typed values."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from appcensus.functions.text import TRUE_WORDS, clean, decoded, folded, strip

# Processor names as captured, and the label of each.
ARCHITECTURES = {
    "x64": "64-bit",
    "x86": "32-bit",
    "x86onarm64": "32-bit",
    "arm64": "arm64",
    "arm": "arm",
    "neutral": "neutral",
}

# What marks a row as an operating system update.
UPDATE_RELEASES = ("security update", "update", "hotfix", "service pack")
UPDATE_NAMES = (
    r"^KB\d+",
    r"^Security Update\b",
    r"^Update for\b",
    r"^Hotfix for\b",
    r"\bHotfix\b",
)

# How captured dates are turned into ISO.  A text with exactly eight digits, whatever
# stands between them, comes first.  What was turned begins with a blank, which no stripped text
# does, so that no later pattern sees it.
DATES = (
    (r"(?U)^\D*+" + r"(\d)\D*+" * 8 + "$", " $1$2$3$4-$5$6-$7$8"),
    (r"^(?:(\d{1,2})/(\d{1,2})/(\d{4})|(\d{4})/(\d{1,2})/(\d{1,2}))$", " $3$4-$1$5-$2$6"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", " $3-$2-$1"),
)

# The same for texts of ASCII alone, in one pattern; of the groups only those of one form are set.
ASCII_DATES = (
    r"^(?:\D*+" + r"(\d)\D*+" * 8
    + r"|(\d{1,2})/(\d{1,2})/(\d{4})|(\d{4})/(\d{1,2})/(\d{1,2})|(\d{1,2})-(\d{1,2})-(\d{4}))$",
    " $1$2$3$4$11$12$17-$5$6$9$13$16-$7$8$10$14$15",
)

# Fixed value: a turned date from 1980 on.
TURNED_DATE = "^ ((?:19[89][0-9]|[2-9][0-9]{3})-.*)$"

INTEGER_TEXT = r"^[+-]?[0-9]+(_[0-9]+)*$"
NOT_NEGATIVE_TEXT = r"^(?:\+?[0-9]+(_[0-9]+)*|-0+(_0+)*)$"


def install_date(raw: Column) -> Column:
    """Captured install date as ``yyyy-MM-dd``, or null.

    A text with exactly eight digits is always year, month, day, whatever stands
    between them.  Only shorter texts are tried in the spelled-out formats.
    """
    text = strip(raw)
    iso = text
    # One step feeds the next and none is named twice: each runs once per row.
    for pattern, order in DATES:
        iso = F.regexp_replace(iso, pattern, order)
    is_ascii = F.octet_length(raw) == F.length(raw)
    iso = F.when(is_ascii, F.regexp_replace(text, *ASCII_DATES)).otherwise(iso)
    # Casts of ISO text find bad days without raising an exception for every row.
    return F.regexp_extract(iso, TURNED_DATE, 1).try_cast("date").cast("string")


def as_date(iso: Column) -> Column:
    """The ISO text of a row as a DATE; null when it is not one."""
    return F.try_to_date(iso, "yyyy-MM-dd")


def integer(text: Column, shape: str = INTEGER_TEXT) -> Column:
    """Whole number out of text: a sign and ``_`` between digits are accepted."""
    value = clean(text)
    plain = F.replace(value, F.lit("_"), F.lit(""))
    return F.when(value.rlike(shape), plain.try_cast("bigint"))


def size_kb(text: Column) -> Column:
    """Captured size in KB; null for negatives and for anything but a whole number."""
    return integer(text, NOT_NEGATIVE_TEXT)


def captured_text(value: Column, kind: str, whole: Column) -> Column:
    """A captured value as the text that the rules for captured text are written for.

    ``kind`` is the column's type: text, bytes, a number, a truth value, or a VARIANT that holds
    any of them.  Bytes are decoded, with U+FFFD for what is not UTF-8.  Where ``whole`` holds, a
    number loses its fraction and a truth value is 1 or 0; elsewhere both are written out.
    """

    def number(v: Column) -> Column:
        return F.when(whole, v.try_cast("bigint").cast("string")).otherwise(v.cast("string"))

    def truth(v: Column) -> Column:
        return F.when(whole, v.cast("int").cast("string")).otherwise(F.initcap(v.cast("string")))

    if kind == "string":
        return value
    if kind == "binary":
        return decoded(value)
    if kind == "boolean":
        return truth(value)
    if kind != "variant":
        return number(value)
    held = F.schema_of_variant(value)
    floating = F.try_variant_get(value, "$", "double")
    return (
        F.when(held == "STRING", F.try_variant_get(value, "$", "string"))
        .when(held == "BINARY", decoded(F.try_variant_get(value, "$", "binary")))
        .when(held == "BOOLEAN", truth(F.try_variant_get(value, "$", "boolean")))
        .when(held == "BIGINT", F.try_variant_get(value, "$", "bigint").cast("string"))
        .when(whole & ~F.isnan(floating), floating.try_cast("bigint").cast("string"))
        .otherwise(F.try_variant_get(value, "$", "string"))
    )


def system_flag(text: Column) -> Column:
    """Captured flag: any whole number but zero, or a word for yes."""
    value = clean(text)
    number = F.when(value.rlike(INTEGER_TEXT), value.rlike("[1-9]"))
    return F.coalesce(number, F.lower(value).isin(*TRUE_WORDS), F.lit(False))


def update_flag(name: Column, release_type: Column) -> Column:
    """Is this row an update rather than an application?"""
    by_release = folded(release_type).isin(*UPDATE_RELEASES)
    by_name = F.coalesce(name, F.lit("")).rlike("(?iU)" + "|".join(UPDATE_NAMES))
    return by_release | by_name


def subject_publisher(subject: Column) -> Column:
    """Publisher named in a signing subject: the organization, else the common name."""
    text = clean(subject)

    def part(label: str) -> Column:
        return clean(F.regexp_extract(text, rf'(?:^|,)(?U:\s*){label}="?([^,"]+)', 1))

    return F.coalesce(part("O"), part("CN"))


def architecture(raw: Column) -> Column:
    pairs = [F.lit(text) for pair in ARCHITECTURES.items() for text in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), folded(raw)), F.lit("unknown"))


def human_size(kb: Column) -> Column:
    """``512 KB``, ``850 MB``, ``1.4 GB``; empty when unknown.  Halves round to even."""

    def scaled(value: Column, unit: str) -> Column:
        whole = (value >= 100) | (value == F.floor(value))
        return F.when(
            whole, F.concat(F.bround(value, 0).cast("bigint").cast("string"), F.lit(unit))
        ).otherwise(F.concat(F.format_string("%.1f", F.bround(value, 1)), F.lit(unit)))

    mb = kb / F.lit(1024.0)
    gb = mb / F.lit(1024.0)
    return (
        F.when(kb.isNull(), F.lit(""))
        .when(kb < 1024, F.concat(kb.cast("string"), F.lit(" KB")))
        .when(mb < 1024, scaled(mb, " MB"))
        .otherwise(scaled(gb, " GB"))
    )


def utc_text(moment: Column) -> Column:
    """A timestamp to the second, as UTC text ending in ``Z``."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.date_format(F.date_trunc("second", utc), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def utc_text_ms(moment: Column) -> Column:
    """A timestamp to the millisecond, as UTC text ending in ``-00:00``."""
    utc = F.to_utc_timestamp(moment, F.current_timezone())
    return F.concat(F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("-00:00"))


def elapsed_ms(start: Column, end: Column) -> Column:
    """Whole milliseconds between two timestamps, never below zero."""
    return F.greatest(F.lit(0), F.timestamp_diff("MILLISECOND", start, end)).cast("bigint")
