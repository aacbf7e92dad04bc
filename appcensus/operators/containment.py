"""Which keys are part of which other keys."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHORTEST = 4


def containment(short: DataFrame, long: DataFrame, by: list[str]) -> DataFrame:
    """Pairs ``(short_key, long_key)`` where the one is a proper part of the other.

    Both inputs hold distinct ``key`` values per ``by``.  A long key is cut only into
    the pieces that can be a short key: those that start with the first letters of
    some short key and have the length of one of these.  The pieces then meet the
    short keys in an equi-join, so every joined row is a true pair and the work stays
    linear in the number of keys, however many share a common word.
    """
    short = short.filter(F.length("key") >= SHORTEST)
    # As many lengths as the longest key has characters, at most.
    lengths = short.groupBy(*by, F.substring("key", 1, SHORTEST).alias("_start")).agg(
        F.collect_set(F.length("key")).alias("_lengths")
    )
    starts = long.filter(F.length("key") > SHORTEST).select(
        *by,
        F.col("key").alias("long_key"),
        F.explode(F.sequence(F.lit(1), F.length("key") - SHORTEST + 1)).alias("_at"),
    )
    starts = starts.withColumn(
        "_start", F.substr(F.col("long_key"), F.col("_at"), F.lit(SHORTEST))
    )
    pieces = (
        starts.join(lengths, [*by, "_start"])
        .select(*by, "long_key", "_at", F.explode("_lengths").alias("_length"))
        .filter(
            (F.col("_at") + F.col("_length") - 1 <= F.length("long_key"))
            & (F.col("_length") < F.length("long_key"))
        )
        .select(
            *by,
            "long_key",
            F.substr(F.col("long_key"), F.col("_at"), F.col("_length")).alias("short_key"),
        )
        .distinct()
    )
    return pieces.join(
        short.select(*by, F.col("key").alias("short_key")), [*by, "short_key"]
    ).select(*by, "short_key", "long_key")
