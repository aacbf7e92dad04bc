"""Packaged applications that the registry of the same snapshot already lists."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appcensus.functions.keys import publisher_key
from appcensus.functions.text import folded
from appcensus.schema import GROUP, SOURCE_APPX, SOURCE_REGISTRY

SHADOWED = "shadowed"


def _any(flag: Column, window) -> Column:
    return F.coalesce(F.max(flag).over(window), F.lit(False))


def with_shadowed(entries: DataFrame) -> DataFrame:
    """Flag packages whose name a registry row has, if the publishers agree.

    Publishers agree when they are equal or either is missing.  Every row learns about its
    name, and about its name and publisher, from totals over rows that one shuffle brings
    together: the input is read once and no row meets another.  A group is one name of one
    snapshot, after copies are gone; a large one is sorted on disk.
    """
    rows = entries.withColumns(
        {"_name": folded(F.col("name")), "_publisher": publisher_key(F.col("publisher"))}
    )
    registry = (F.col("source") == SOURCE_REGISTRY) & (F.col("_name") != "")
    of_name = Window.partitionBy(*GROUP, "_name")
    of_both = Window.partitionBy(*GROUP, "_name", "_publisher")
    named = _any(registry, of_name)
    open_name = _any(registry & F.col("_publisher").isNull(), of_name)
    same = F.col("_publisher").isNotNull() & _any(registry, of_both)
    rows = rows.withColumns({"_named": named, "_open": open_name, "_same": same})
    hidden = (F.col("source") == SOURCE_APPX) & F.when(
        F.col("_publisher").isNull(), F.col("_named")
    ).otherwise(F.col("_open") | F.col("_same"))
    return rows.withColumn(SHADOWED, F.coalesce(hidden, F.lit(False))).select(
        *entries.columns, SHADOWED
    )


def drop_shadowed(entries: DataFrame) -> DataFrame:
    """Drop packages whose name a registry row has, if the publishers agree."""
    return with_shadowed(entries).filter(~F.col(SHADOWED)).drop(SHADOWED)
