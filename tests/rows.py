"""Rows for tests, with defaults for what a test does not care about."""

from pyspark.sql import functions as F
from pyspark.sql import types as T

from appcensus.schema import ENTRY_SCHEMA

FLEET_SCHEMA = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        *ENTRY_SCHEMA.fields,
        T.StructField("ord", T.LongType()),
    ]
)


def entry(name, ord=0, host="h1", snapshot_id="s1", **fields):
    row = {
        "host": host,
        "snapshot_id": snapshot_id,
        "name": name,
        "version": "1.0",
        "publisher": "Acme",
        "install_date": None,
        "install_location": None,
        "estimated_size_kb": None,
        "scope": "machine",
        "architecture": "64-bit",
        "uninstall_string": None,
        "quiet_uninstall_string": None,
        "registry_path": f"path-{ord or 0:04d}",
        "release_type": None,
        "system_component": False,
        "source": "registry",
        "ord": ord,
    }
    row.update(fields)
    return row


def fleet(spark, rows):
    names = FLEET_SCHEMA.fieldNames()
    return spark.createDataFrame([tuple(row[n] for n in names) for row in rows], FLEET_SCHEMA)


def scalar(spark, function, values, kind="string"):
    """Apply a column function to values and return the results in order."""
    df = spark.createDataFrame(list(enumerate(values)), f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(function(F.col("v"))).collect()]
