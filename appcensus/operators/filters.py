"""Which rows a report shows, and why the others are hidden."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions.text import clean, strip
from appcensus.functions.values import update_flag
from appcensus.schema import SOURCE_CHOICES

HIDDEN_BLANK = "blank"
HIDDEN_SYSTEM = "system"
HIDDEN_UPDATE = "update"
HIDDEN_SEARCH = "search"


def matches_search(needle: str) -> Column:
    """Is the needle part of the name, the publisher or the version, in any case?"""
    wanted = F.lower(strip(F.lit(needle)))
    found = F.lit(False)
    for field in ("name", "publisher", "version"):
        found = found | F.contains(F.lower(F.coalesce(F.col(field), F.lit(""))), wanted)
    return found


def hidden_reason(
    include_system_components: bool = False,
    include_updates: bool = False,
    search: str | None = None,
) -> Column:
    """The first rule that hides a row; null for a row that stays."""
    reason = F.when(clean(F.col("name")).isNull(), HIDDEN_BLANK)
    if not include_system_components:
        reason = reason.when(F.col("system_component"), HIDDEN_SYSTEM)
    if not include_updates:
        reason = reason.when(update_flag(F.col("name"), F.col("release_type")), HIDDEN_UPDATE)
    if search:
        reason = reason.when(~matches_search(search), HIDDEN_SEARCH)
    return reason


def filter_entries(entries: DataFrame, **options) -> DataFrame:
    return entries.filter(hidden_reason(**options).isNull())


def select_source(entries: DataFrame, source: str) -> DataFrame:
    """Rows of one collector.  Meant for raw rows: it decides what can shadow what."""
    if source not in SOURCE_CHOICES:
        raise ValueError(f"unknown source {source!r}; expected one of {', '.join(SOURCE_CHOICES)}")
    return entries if source == "all" else entries.filter(F.col("source") == source)
