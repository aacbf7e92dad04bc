"""One table of raw rows out of the captures of a fleet."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcensus.schema import GROUP, ORD, SOURCE_APPX, SOURCE_CHOICES, SOURCE_REGISTRY
from appcensus.sources.files import CaptureError
from appcensus.sources.packaged import SOURCE_LABEL, package_entries, packages_of, parse_listings
from appcensus.sources.registry import gather_values, registry_entries, registry_sources

_AFTER_REGISTRY = 1 << 60


def collect(
    registry_values: DataFrame | None, listings: DataFrame | None, source: str = "all"
) -> DataFrame:
    """Registry rows, then packages, per snapshot.

    With ``all``, a bad package listing only costs its own host the packages, and
    ``collect_status`` names it; with ``appx`` alone it is an error.
    """
    if source not in SOURCE_CHOICES:
        raise ValueError(f"unknown source {source!r}; expected one of {', '.join(SOURCE_CHOICES)}")
    parts = []
    if source in ("all", SOURCE_REGISTRY):
        parts.append(registry_entries(gather_values(registry_values)))
    if source in ("all", SOURCE_APPX) and listings is not None:
        parsed = parse_listings(listings)
        if source == SOURCE_APPX:
            bad = parsed.filter(F.col("status") != "ok").limit(1).collect()
            if bad:
                raise CaptureError(f"{bad[0].host} {bad[0].snapshot_id}: {bad[0].reason}")
        packages = package_entries(packages_of(parsed))
        parts.append(packages.withColumn(ORD, F.col(ORD) + F.lit(_AFTER_REGISTRY)))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def collect_status(registry_values: DataFrame | None, listings: DataFrame | None) -> DataFrame:
    """What ``collect`` with ``all`` makes of every capture: ``source, status, reason``.

    A bad package listing is left out there and named here.
    """
    parts = []
    if registry_values is not None:
        seen = registry_values.select(*GROUP).distinct()
        parts.append(
            seen.select(
                *GROUP, F.lit(SOURCE_REGISTRY).alias("source"), F.lit("ok").alias("status"),
                F.lit(None).cast("string").alias("reason"),
            )
        )
    if listings is not None:
        parsed = parse_listings(listings)
        parts.append(parsed.select(*GROUP, F.lit(SOURCE_APPX).alias("source"), "status", "reason"))
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return rows


def collector_sources(
    registry_values: DataFrame | None, listings: DataFrame | None
) -> DataFrame:
    """Labels of what contributed to each snapshot, registry views first."""
    parts = []
    if registry_values is not None:
        labels = registry_sources(registry_values)
        parts.append(labels.select(*GROUP, F.lit(0).alias("_part"), "labels"))
    if listings is not None:
        usable = parse_listings(listings).filter(F.col("status") == "ok")
        parts.append(
            usable.select(
                *GROUP, F.lit(1).alias("_part"), F.array(F.lit(SOURCE_LABEL)).alias("labels")
            ).distinct()
        )
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    # At most two rows per snapshot.
    ordered = F.array_sort(F.collect_list(F.struct("_part", "labels")))
    return rows.groupBy(*GROUP).agg(
        F.flatten(F.transform(ordered, lambda part: part["labels"])).alias("collector_sources")
    )
