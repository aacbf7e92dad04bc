"""One row per key: the most detailed one."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcensus.functions.keys import completeness, dedup_keys, identity_keys
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD


COPIES = "copies"


def entry_struct():
    return F.struct(*ENTRY_COLUMNS, ORD)


def preference():
    """Smaller is better: more detail, then the lower path, then the earlier row."""
    return F.struct((-completeness()).alias("score"), F.col("registry_path"), F.col(ORD))


def preferred_entry():
    """``preference`` and then the other fields, as one value: no field is shuffled twice."""
    others = [name for name in ENTRY_COLUMNS if name != "registry_path"]
    return F.struct((-completeness()).alias("score"), F.col("registry_path"), F.col(ORD), *others)


def best_per_key(entries: DataFrame, keys, group=GROUP) -> DataFrame:
    """Keep the preferred row of each key within its snapshot.

    An aggregate with a partial step: copies collapse before the shuffle, so a key
    that holds a large share of the rows costs one small row per map task.
    ``first_ord`` is the position of the first row seen for the key, ``copies`` their
    number.  A scan time, which all rows of a snapshot share, is kept.
    """
    carried = [name for name in ("scan_ts",) if name in entries.columns]
    best = (
        entries.withColumn("_entry", preferred_entry())
        .groupBy(*group, *keys)
        .agg(
            F.min("_entry").alias("_entry"),
            F.min(ORD).alias("first_ord"),
            F.count("*").alias(COPIES),
            *[F.min(name).alias(name) for name in carried],
        )
    )
    named = [c for c in best.columns if c not in ("_entry", "first_ord", COPIES, *carried)]
    fields = [F.col(f"_entry.{name}").alias(name) for name in (*ENTRY_COLUMNS, ORD)]
    return best.select(*named, *fields, "first_ord", COPIES, *carried)


def deduplicate(entries: DataFrame) -> DataFrame:
    """Collapse copies of an application within each snapshot."""
    best = best_per_key(entries, dedup_keys())
    kept = [name for name in (COPIES, "scan_ts") if name in best.columns]
    return best.select(*GROUP, *ENTRY_COLUMNS, F.col("first_ord").alias(ORD), *kept)


def index_by_identity(entries: DataFrame) -> DataFrame:
    """One preferred row per application and snapshot, whatever its version."""
    return best_per_key(entries, identity_keys())
