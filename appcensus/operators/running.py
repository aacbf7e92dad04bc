"""Running totals within groups, also where one group holds most of the rows.

A group is cut into slices along its order.  Every slice is totalled on its own, and what
came before a slice is added from the totals of the slices before it.  There is one way of
doing this, whatever the size of a group.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from appcensus.operators.durable import durable

SLICE = 65_536
"""Length of a slice where the order is a number that counts rows."""

_AGGREGATES = {"sum": F.sum, "max": F.max}


def along(number: str) -> Column:
    """The slice of a row whose order begins with ``number``."""
    return F.floor(F.col(number) / SLICE)


def _together(kind: str, before: Column, here: Column) -> Column:
    """Null is the total of no values."""
    both = before + here if kind == "sum" else F.greatest(before, here)
    return F.when(before.isNull(), here).when(here.isNull(), before).otherwise(both)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    totals: dict[str, tuple[str, Column]],
    slices: Column | None = None,
) -> DataFrame:
    """Add running ``sum`` or ``max`` columns, in ``order`` within ``keys``.

    ``order`` must be unique within a group, and ``df`` cheap to read twice.  ``slices``
    is the slice of a row and must not fall along ``order``; without it, ranges of the
    sorted rows are the slices.  These depend on sampled bounds and are written down.
    """
    cut = df.withColumns({f"_in_{name}": value for name, (_, value) in totals.items()})
    if slices is None:
        ranged = cut.repartitionByRange(*keys, *order)
        cut = durable(ranged.withColumn("_slice", F.spark_partition_id().cast("bigint")))
    else:
        cut = cut.withColumn("_slice", slices)
    here = (
        Window.partitionBy(*keys, "_slice")
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    local = cut.withColumns(
        {name: _AGGREGATES[kind](f"_in_{name}").over(here) for name, (kind, _) in totals.items()}
    )

    # A row per group and slice; most groups have one slice and carry nothing on.
    earlier = (
        Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    )
    carried = (
        cut.groupBy(*keys, "_slice")
        .agg(*[_AGGREGATES[k](f"_in_{name}").alias(f"_of_{name}") for name, (k, _) in totals.items()])
        .withColumns(
            {
                f"_before_{name}": _AGGREGATES[kind](f"_of_{name}").over(earlier)
                for name, (kind, _) in totals.items()
            }
        )
    )
    some = F.lit(False)
    for name in totals:
        some = some | F.col(f"_before_{name}").isNotNull()
    at = [*keys, "_slice"]
    carried = carried.filter(some).select(
        *[F.col(key).alias(f"_at_{key}") for key in at], *[f"_before_{name}" for name in totals]
    )
    same = F.lit(True)
    for key in at:
        same = same & F.col(key).eqNullSafe(F.col(f"_at_{key}"))
    joined = local.join(carried, same, "left")
    return joined.select(
        *df.columns,
        *[
            _together(kind, F.col(f"_before_{name}"), F.col(name)).alias(name)
            for name, (kind, _) in totals.items()
        ],
    )


def numbered(
    df: DataFrame, keys: list[str], order: list[str], name: str, slices: Column | None = None
) -> DataFrame:
    """Number the rows of each group from 1, in ``order``."""
    return running(df, keys, order, {name: ("sum", F.lit(1).cast("bigint"))}, slices)
