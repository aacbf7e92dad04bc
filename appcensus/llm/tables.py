"""Reading inputs and writing the intermediate tables that cut lineage."""

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = r"[^\x20\x09-\x0D]+"
"""A word: a run of characters that are not blank or ASCII white space (Java and RE2 syntax)."""

SPACES = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def quoted(column: str) -> str:
    """A column's name as it is, dots included."""
    return f"`{column.replace('`', '``')}`"


def shared_folder(spark: SparkSession) -> str:
    """The folder in ``spark.checkpoint.dir``; a local session without one gets its own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="llm-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again.

    The table survives lost executors, is computed once however often it is read, and
    its true size guides the planner.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_KEYS = 2_000_000
"""Rows of 16 bytes that may be broadcast; a larger table is joined by a shuffle."""


def bounded(keys: DataFrame) -> DataFrame:
    """``keys`` (a written table of 16 bytes a row), to be broadcast if it is small enough."""
    return F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys


def without(df: DataFrame, gone: DataFrame, id_column: str, text: str) -> DataFrame:
    """The rows of ``df`` that ``gone`` (id, ``xxhash64`` of the text) does not name.

    While few rows go, the texts of the others stay where they are.
    """
    gone = bounded(written(gone.toDF("_gone_id", "_gone_text").distinct(), "gone"))
    same = df[id_column].eqNullSafe(gone["_gone_id"]) & (
        F.xxhash64(df[text]) == gone["_gone_text"]
    )
    return df.join(gone, same, "left_anti")


def one_of_each(
    df: DataFrame, rows: DataFrame, id_column: str, text: str
) -> DataFrame:
    """The rows of ``df`` with exactly one of each group of ``rows``, or none of it.

    ``rows`` (``_id, _raw, _group, kept``; ``_raw`` is ``xxhash64`` of the text) is written
    down or cheap to read twice, and the kept rows of a group have one id.  Where several of a
    group are kept, ids do not tell them apart: the one with the largest hash of its text
    stays, and of those with one text that with the largest hash of all its columns.  Equal
    rows collapse before the shuffle, so one that is a third of all rows costs a row per task.
    """
    tied = written(
        rows.filter("kept").groupBy("_group").agg(
            F.max("_id").alias("_one_id"), F.max("_raw").alias("_one_text"),
            F.count(F.lit(1)).alias("_n"),
        ).filter("_n > 1"),
        "tied",
    )
    gone = rows.filter("not kept").select("_id", "_raw")
    if tied.isEmpty():
        return without(df, gone, id_column, text)
    several = rows.filter("kept").join(tied.select("_group"), "_group", "left_semi")
    rest = without(df, gone.union(several.select("_id", "_raw")), id_column, text)

    keys = bounded(tied.select("_one_id", "_one_text"))
    same = df[id_column].eqNullSafe(keys["_one_id"]) & (F.xxhash64(df[text]) == keys["_one_text"])
    packed = df.join(keys, same, "left_semi").select(
        F.struct(*[df[quoted(c)] for c in df.columns]).alias("_row"),
        df[id_column].alias("_one_id"), F.xxhash64(df[text]).alias("_one_text"),
    )
    ones = packed.groupBy("_one_id", "_one_text").agg(
        F.max_by("_row", F.xxhash64(F.to_json("_row"))).alias("_row")
    )
    return rest.union(ones.select("_row.*"))


def _ship(spark: SparkSession) -> None:
    """Give the executors this package, once per application."""
    context = spark.sparkContext
    if getattr(context, "_llm_shipped", False):
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(os.path.dirname(package))
    archive = os.path.join(tempfile.mkdtemp(prefix="llm-code-"), "llm_code.zip")
    with zipfile.ZipFile(archive, "w") as out:
        out.write(os.path.join(os.path.dirname(package), "__init__.py"), "appcensus/__init__.py")
        for name in sorted(os.listdir(package)):
            if name.endswith(".py"):
                path = os.path.join(package, name)
                out.write(path, os.path.relpath(path, root))
    context.addPyFile(archive)
    context._llm_shipped = True


def in_python(df: DataFrame, function, schema: str) -> DataFrame:
    """``df.mapInArrow`` with this package at hand where the function runs."""
    _ship(df.sparkSession)
    return df.mapInArrow(function, schema)
