"""Captured listings of packaged applications."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from appcensus.functions import values as V
from appcensus.functions.text import clean, folded, is_true_word, strip
from appcensus.schema import APPX_SCHEMA, ENTRY_COLUMNS, GROUP, ORD, SOURCE_APPX
from appcensus.sources.files import BOM
from appcensus.sources.variants import fields_of, is_array, is_object, json_value, shown_text, worked_out

# Fixed value: the label of this source in a report.
SOURCE_LABEL = "Appx/MSIX packages [Windows.Management.Deployment.PackageManager, current user]"


def parse_listings(captures: DataFrame) -> DataFrame:
    """One row per capture with ``status``, ``reason`` and the package values.

    A lone object is a list of one; blank text is an empty list; items that are no
    objects are skipped.
    """
    body = F.ltrim(strip(F.col("text")), F.lit(BOM))
    doc = F.col("_doc")
    parsed = captures.withColumn("_blank", F.coalesce(body == "", F.lit(True)))
    parsed = worked_out(parsed, "_doc", json_value(body))
    reason = F.when(~F.col("_blank") & doc.isNull(), "invalid JSON").when(
        ~F.col("_blank") & ~is_object(doc) & ~is_array(doc), "not a list of packages"
    )
    items = (
        F.when(F.col("_blank"), F.array().cast("array<variant>"))
        .when(is_object(doc), F.array(doc))
        .otherwise(F.filter(F.try_variant_get(doc, "$", "array<variant>"), is_object))
    )
    return worked_out(parsed, "reason", reason).select(
        *[name for name in captures.columns if name != "text"],
        F.when(F.col("reason").isNull(), "ok").otherwise("bad").alias("status"),
        "reason",
        F.when(F.col("reason").isNull(), items).alias("items"),
    )


def packages_of(listings: DataFrame) -> DataFrame:
    """Package rows of the usable captures, with ``ord`` as listed."""
    rows = listings.filter(F.col("status") == "ok").select(
        *GROUP, F.posexplode("items").alias(ORD, "_item")
    )
    names = APPX_SCHEMA.fieldNames()
    raw, text = fields_of(F.col("_item"), names)
    rows = worked_out(worked_out(rows, "_raw", raw), "_text", text)
    return rows.select(
        *GROUP,
        *[shown_text(F.col("_raw")[n], F.col("_text")[n]).alias(n) for n in names],
        F.col(ORD).cast("bigint").alias(ORD),
    )


def package_entries(packages: DataFrame) -> DataFrame:
    """Entries of packages.  Resource packages and packages without identity or name are dropped."""
    name = clean(F.col("name"))
    family = clean(F.col("family"))
    display = clean(F.col("display_name"))
    display = F.when(~F.startswith(F.lower(display), F.lit("ms-resource:")), display)
    framework = is_true_word(F.col("is_framework").cast("string"))
    fields = {
        "name": F.coalesce(display, name),
        "version": clean(F.col("version")),
        "publisher": F.coalesce(
            clean(F.col("publisher_display_name")), V.subject_publisher(F.col("publisher"))
        ),
        "install_date": V.install_date(F.substring(clean(F.col("installed_date")), 1, 10)),
        "install_location": clean(F.col("install_location")),
        "estimated_size_kb": F.lit(None).cast("bigint"),
        "scope": F.lit("current_user"),
        "architecture": V.architecture(F.col("architecture")),
        "uninstall_string": F.lit(None).cast("string"),
        "quiet_uninstall_string": F.lit(None).cast("string"),
        "registry_path": F.concat(F.lit("appx:"), F.coalesce(family, name)),
        "release_type": F.lit(None).cast("string"),
        "system_component": framework | (folded(F.col("signature_kind")) == "system"),
        "source": F.lit(SOURCE_APPX),
    }
    resource = is_true_word(F.col("is_resource").cast("string"))
    known = F.coalesce(family, name).isNotNull() & fields["name"].isNotNull()
    return packages.filter(~resource & known).select(
        *GROUP, *[fields[column].alias(column) for column in ENTRY_COLUMNS], ORD
    )
