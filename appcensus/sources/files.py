"""Whole capture files as rows of ``path`` and ``text``."""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BOM = "\ufeff"


def read_texts(spark: SparkSession, folder: str) -> DataFrame:
    """One row per file.  A capture describes one host and is read as a whole."""
    return spark.read.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def stream_texts(spark: SparkSession, folder: str) -> DataFrame:
    """``read_texts`` as a stream of new files."""
    return spark.readStream.text(folder, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")
    )


def without_bom(text: Column) -> Column:
    return F.when(F.startswith(text, F.lit(BOM)), F.substr(text, F.lit(2))).otherwise(text)


class CaptureError(ValueError):
    """A capture file that cannot be used, named with the reason."""


def quarantine(status: DataFrame) -> DataFrame:
    """The files that were left out, with the reason."""
    return status.filter(F.col("status") != "ok").select("path", "status", "reason")


def require_all(status: DataFrame) -> None:
    """Raise for the first bad file, for callers that want all files or none."""
    bad = quarantine(status).orderBy("path").limit(1).collect()
    if bad:
        raise CaptureError(f"{bad[0].path}: {bad[0].reason}")
