"""The keys and scores that decide which rows are the same application."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from appcensus.functions.text import clean, folded, folded_path, lstrip, strip
from appcensus.schema import SOURCE_APPX

# The fields that count as detail of a row.
DETAIL_FIELDS = (
    "version",
    "publisher",
    "install_date",
    "install_location",
    "estimated_size_kb",
    "uninstall_string",
    "quiet_uninstall_string",
    "release_type",
)

# A version at the end of a display name.
TRAILING_VERSION = r"[\s\-_]*(?:v(?:er(?:sion)?)?[\s\-_]*)?\d+(?:\.\d+){0,3}(?:\+\d+)?$"

# Catalogs that can be installed from, and ids that cannot.
IMPORTABLE_SOURCES = ("winget", "msstore")
LOCAL_ID_PREFIXES = ("ARP\\", "MSIX\\", "arp\\", "msix\\")

DEDUP_KEYS = ("key_name", "key_version", "key_publisher", "key_location")
IDENTITY_KEYS = ("identity_1", "identity_2", "identity_3")


def dedup_keys() -> list[Column]:
    """Copies of one application within a snapshot; the version is part of the key."""
    parts = (
        folded(F.col("name")),
        folded(F.col("version")),
        folded(F.col("publisher")),
        folded_path(F.col("install_location")),
    )
    return [part.alias(key) for part, key in zip(parts, DEDUP_KEYS)]


def identity_keys() -> list[Column]:
    """One application across snapshots; the version is no part of the key.

    Packages are known by family and architecture, since their folder changes with
    every version.
    """
    path = folded(F.col("registry_path"))
    packaged = (F.col("source") == SOURCE_APPX) & F.startswith(path, F.lit("appx:"))
    parts = (
        F.when(packaged, path).otherwise(folded(F.col("name"))),
        F.when(packaged, F.lit("")).otherwise(folded(F.col("publisher"))),
        F.when(packaged, folded(F.col("architecture"))).otherwise(
            folded_path(F.col("install_location"))
        ),
    )
    return [part.alias(key) for part, key in zip(parts, IDENTITY_KEYS)]


def publisher_key(publisher: Column) -> Column:
    return F.lower(clean(publisher))


def completeness() -> Column:
    """How many detail fields are filled.  A size of zero counts, blank text does not."""
    score = F.lit(0)
    for field in DETAIL_FIELDS:
        value = F.col(field)
        filled = value.isNotNull() if field == "estimated_size_kb" else lstrip(value) != ""
        score = score + F.when(filled, 1).otherwise(0)
    return score


def match_key(name: Column) -> Column:
    """Display name without its version, as compared with a package catalog.

    Empty for a blank name; the whole text when nothing but a version is there.
    """
    text = F.regexp_replace(folded(name), r"(?U)[\s\x1c-\x1f]+", " ")
    short = F.btrim(F.regexp_replace(text, "(?U)" + TRAILING_VERSION, ""), F.lit(" -_"))
    return F.coalesce(F.nullif(short, F.lit("")), text)


def importable(package_id: Column, source: Column) -> Column:
    """Can a package be installed from a catalog, going by its id and source?"""
    ident = strip(F.coalesce(package_id, F.lit("")))
    local = F.lit(False)
    for prefix in LOCAL_ID_PREFIXES:
        local = local | F.startswith(ident, F.lit(prefix))
    dotted = F.contains(ident, F.lit(".")) & ~F.contains(ident, F.lit("\\"))
    known = folded(source).isin(*IMPORTABLE_SOURCES)
    return (ident != "") & ~local & (known | dotted)
