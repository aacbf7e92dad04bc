"""Intermediate results that outlive the executors that made them."""

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"

_open: ContextVar[list[str] | None] = ContextVar("open_tables", default=None)


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    A local session without one gets a temporary folder; a cluster without one is
    refused, since its executors share no local disk.
    """
    context = spark.sparkContext
    folder = spark.conf.get(_CHECKPOINT_DIR, None) or context.getCheckpointDir()
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="appcensus-"))
        folder = context.getCheckpointDir()
    return folder.rstrip("/")


def durable(df: DataFrame, keep: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    This cuts the lineage, fixes values that depend on the partitioning, and gives
    the optimizer true sizes for what follows.  Within ``temporary_tables`` the table
    goes when the block ends, unless it is to be kept.
    """
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    opened = _open.get()
    if opened is not None and not keep:
        opened.append(path)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def temporary_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that ``durable`` writes in this block when it ends."""
    opened: list[str] = []
    token = _open.set(opened)
    try:
        yield
    finally:
        _open.reset(token)
        jvm = spark.sparkContext._jvm
        for path in opened:
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
