"""Column contracts shared by every job.

Rows of many hosts and many snapshots live in one table.  ``GROUP`` names the
snapshot a row belongs to, and every operator works inside that group.
"""

from pyspark.sql import types as T

GROUP = ("host", "snapshot_id")
ORD = "ord"

ENTRY_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("install_date", T.StringType()),
        T.StructField("install_location", T.StringType()),
        T.StructField("estimated_size_kb", T.LongType()),
        T.StructField("scope", T.StringType(), False),
        T.StructField("architecture", T.StringType(), False),
        T.StructField("uninstall_string", T.StringType()),
        T.StructField("quiet_uninstall_string", T.StringType()),
        T.StructField("registry_path", T.StringType(), False),
        T.StructField("release_type", T.StringType()),
        T.StructField("system_component", T.BooleanType(), False),
        T.StructField("source", T.StringType(), False),
    ]
)
"""One installed application.  The order is public: new columns go last."""

ENTRY_COLUMNS = tuple(ENTRY_SCHEMA.fieldNames())

SCAN_SCHEMA = T.StructType(
    [
        T.StructField("started_at", T.StringType()),
        T.StructField("completed_at", T.StringType()),
        T.StructField("duration_ms", T.LongType()),
        T.StructField("hostname", T.StringType()),
        T.StructField("platform", T.StringType()),
        T.StructField("collector_sources", T.ArrayType(T.StringType())),
        T.StructField("raw_entry_count", T.LongType()),
        T.StructField("deduplicated_count", T.LongType()),
        T.StructField("filtered_system_component_count", T.LongType()),
        T.StructField("filtered_update_count", T.LongType()),
        T.StructField("result_count", T.LongType()),
    ]
)

PACKAGE_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType(), False),
        T.StructField("package_id", T.StringType(), False),
        T.StructField("version", T.StringType()),
        T.StructField("source", T.StringType(), False),
    ]
)

APPX_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("family", T.StringType()),
        T.StructField("full_name", T.StringType()),
        T.StructField("display_name", T.StringType()),
        T.StructField("publisher_display_name", T.StringType()),
        T.StructField("publisher", T.StringType()),
        T.StructField("version", T.StringType()),
        T.StructField("architecture", T.StringType()),
        T.StructField("install_location", T.StringType()),
        T.StructField("installed_date", T.StringType()),
        T.StructField("is_framework", T.StringType()),
        T.StructField("is_resource", T.StringType()),
        T.StructField("is_bundle", T.StringType()),
        T.StructField("signature_kind", T.StringType()),
    ]
)
"""A packaged application as captured.  Flags stay text until they are mapped."""

SOURCE_REGISTRY = "registry"
SOURCE_APPX = "appx"
SOURCE_CHOICES = ("all", SOURCE_REGISTRY, SOURCE_APPX)

REPORT_VERSION = "1.2"
READABLE_VERSIONS = ("1.1", "1.2")
