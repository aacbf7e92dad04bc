"""Captured registry values of many hosts."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions import values as V
from appcensus.functions.text import clean
from appcensus.schema import ENTRY_COLUMNS, GROUP, ORD, SOURCE_REGISTRY

# The value names read from each key.
VALUE_NAMES = (
    "DisplayName",
    "DisplayVersion",
    "Publisher",
    "InstallDate",
    "InstallLocation",
    "EstimatedSize",
    "UninstallString",
    "QuietUninstallString",
    "ReleaseType",
    "SystemComponent",
)

# Those that are numbers.
NUMBER_NAMES = ("EstimatedSize", "SystemComponent")

_UNINSTALL = "SOFTWARE\\Microsoft\\Windows\\CurrentVersion\\Uninstall"
_UNINSTALL_32 = "SOFTWARE\\WOW6432Node\\Microsoft\\Windows\\CurrentVersion\\Uninstall"

# The views of the registry, as (root, folder, scope, architecture, label).
VIEWS = (
    ("HKEY_LOCAL_MACHINE", _UNINSTALL, "machine", "64-bit", " [64-bit view]"),
    ("HKEY_LOCAL_MACHINE", _UNINSTALL, "machine", "32-bit", " [32-bit view]"),
    ("HKEY_LOCAL_MACHINE", _UNINSTALL_32, "machine", "32-bit", ""),
    ("HKEY_CURRENT_USER", _UNINSTALL, "current_user", "unknown", ""),
)


def view_labels() -> list[str]:
    return [f"{root}\\{folder}{label}" for root, folder, _, _, label in VIEWS]


def _of_view(view: Column, texts: list[str]) -> Column:
    return F.element_at(F.array(*[F.lit(text) for text in texts]), view + 1)


def gather_values(captured: DataFrame) -> DataFrame:
    """One row per registry key out of ``(view, sub_name, key_ord, value_name, value)``.

    ``view`` numbers the entries of ``VIEWS`` from 0.  A value name occurs once in a key.
    ``value`` is text, bytes, a number or a truth value, or a VARIANT of them all.
    """
    kind = captured.schema["value"].dataType.simpleString()
    text = V.captured_text(F.col("value"), kind, F.col("value_name").isin(*NUMBER_NAMES))
    captured = captured.withColumn("value", text)
    named = [
        F.first(F.when(F.col("value_name") == name, F.col("value")), ignorenulls=True).alias(name)
        for name in VALUE_NAMES
    ]
    keys = [*GROUP, "view", "sub_name", "key_ord"]
    # The aggregate sorts by its keys; with the number first, few texts are compared.
    return captured.groupBy(*reversed(keys)).agg(*named).select(*keys, *VALUE_NAMES)


def registry_entries(keys: DataFrame) -> DataFrame:
    """Entries of registry keys; keys without a display name are dropped."""
    view = F.col("view")
    path = F.concat_ws(
        "\\",
        _of_view(view, [f"{root}\\{folder}" for root, folder, *_ in VIEWS]),
        F.col("sub_name"),
    )
    fields = {
        "name": clean(F.col("DisplayName")),
        "version": clean(F.col("DisplayVersion")),
        "publisher": clean(F.col("Publisher")),
        "install_date": V.install_date(F.col("InstallDate")),
        "install_location": clean(F.col("InstallLocation")),
        "estimated_size_kb": V.size_kb(F.col("EstimatedSize")),
        "scope": _of_view(view, [scope for _, _, scope, _, _ in VIEWS]),
        "architecture": _of_view(view, [arch for _, _, _, arch, _ in VIEWS]),
        "uninstall_string": clean(F.col("UninstallString")),
        "quiet_uninstall_string": clean(F.col("QuietUninstallString")),
        "registry_path": path,
        "release_type": clean(F.col("ReleaseType")),
        "system_component": V.system_flag(F.col("SystemComponent")),
        "source": F.lit(SOURCE_REGISTRY),
    }
    # Views are read one after the other, keys in the order they were listed.
    order = view.cast("bigint") * F.lit(1 << 48) + F.col("key_ord")
    return keys.filter(fields["name"].isNotNull()).select(
        *GROUP, *[fields[name].alias(name) for name in ENTRY_COLUMNS], order.alias(ORD)
    )


def registry_sources(captured: DataFrame) -> DataFrame:
    """Labels of the views that were captured, in view order, per snapshot."""
    views = captured.groupBy(*GROUP).agg(F.array_sort(F.collect_set("view")).alias("views"))
    labels = F.array(*[F.lit(label) for label in view_labels()])
    return views.select(
        *GROUP,
        F.transform("views", lambda view: F.element_at(labels, view + 1)).alias("labels"),
    )
