"""New snapshot files, taken in as they arrive.

Each batch is read, prepared and added to the history, and every new snapshot is
compared with the one before it on its host.  A batch writes folders of its own, which
count once the commit log lists them, after the last of them is written: a batch that
dies half-way shows nothing, and readers never meet half of one.  A batch is named by
what its files hold, so one that runs twice is listed once, and a new checkpoint on an
old store, which sends all files again in other batches, adds what the store lacks.

A snapshot that arrives late is stored and compared with its own predecessor, and its
successor is compared again, with it.  It does not become the latest of its host.  A batch
also stores the pairs it compared: the newest pair of a snapshot is the current one, so
``current_diffs`` is what a batch job over all files gives.  A snapshot that comes again in
another file counts once; the file is listed in ``rejected`` as repeated.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appcensus.operators.commits import CommitLog
from appcensus.operators.durable import durable, temporary_tables
from appcensus.plans.history import PAIR, consecutive_diff, latest_snapshots, previous_snapshots
from appcensus.plans.prepare import prepare
from appcensus.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, GROUP, ORD
from appcensus.sources.files import quarantine, stream_texts
from appcensus.sources.snapshots import (
    parse_snapshots,
    snapshot_entries,
    snapshot_status,
    snapshot_table,
    unique_snapshots,
)

def _fields(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([*[T.StructField(*f) for f in fields], T.StructField("folder", T.StringType())])


_TEXT = T.StringType()
_TABLES = {
    "rejected": _fields(("path", _TEXT), ("status", _TEXT), ("reason", _TEXT)),
    "snapshots": _fields(
        ("host", _TEXT), ("snapshot_id", _TEXT), ("scan_ts", T.TimestampType()), ("path", _TEXT)
    ),
    "rows": _fields(
        ("host", _TEXT), ("snapshot_id", _TEXT),
        *[(f.name, f.dataType) for f in ENTRY_SCHEMA.fields], (ORD, T.LongType()),
    ),
    "pairs": _fields(*[(key, _TEXT) for key in PAIR]),
}


def _stored(spark: SparkSession, store: str, table: str) -> DataFrame:
    """What the commits of ``store`` have in ``table``, with the number of the ``batch``."""
    log = CommitLog(spark, store)
    if not log.exists(table):
        return spark.createDataFrame([], _TABLES[table]).drop("folder").withColumn(
            "batch", F.lit(None).cast("bigint")
        )
    reader = spark.read.schema(_TABLES[table]) if table in _TABLES else spark.read
    listed = log.listed().filter("number > 0").select("folder", F.col("number").alias("batch"))
    return reader.parquet(f"{store}/{table}").join(listed, "folder").drop("folder")


def stored_snapshots(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "snapshots")


def stored_rows(spark: SparkSession, store: str) -> DataFrame:
    return _stored(spark, store, "rows")


def rejected_files(spark: SparkSession, store: str) -> DataFrame:
    """``path, status, reason`` of the files that were left out."""
    return _stored(spark, store, "rejected")


def stored_diffs(spark: SparkSession, store: str) -> DataFrame:
    """All diffs that batches made, those with a pair that is no longer current too."""
    return _stored(spark, store, "diffs")


def latest_rows(spark: SparkSession, store: str) -> DataFrame:
    """Rows of the newest snapshot of every host."""
    newest = latest_snapshots(stored_snapshots(spark, store))
    return stored_rows(spark, store).join(newest, list(GROUP), "left_semi")


def current_diffs(spark: SparkSession, store: str) -> DataFrame:
    """The diff of each snapshot with the one before it, as known now."""
    pairs = _stored(spark, store, "pairs")
    newest = pairs.groupBy("host", "snapshot_id").agg(F.max("batch").alias("batch"))
    current = pairs.join(newest, ["host", "snapshot_id", "batch"], "left_semi")
    return stored_diffs(spark, store).join(current, [*PAIR, "batch"], "left_semi").drop("batch")


def take_in(texts: DataFrame, store: str, **options) -> None:
    """Process one batch of snapshot files."""
    spark = texts.sparkSession
    mark = F.struct(F.xxhash64("path", "text").alias("a"), F.xxhash64("text", "path").alias("b"))
    with temporary_tables(spark):
        parsed = durable(parse_snapshots(texts.withColumn("_mark", mark), keep=("_mark",)))
        sums = [F.sum(F.col(f"_mark.{k}").cast("decimal(38,0)")).cast("string") for k in "ab"]
        name = "-".join(str(x) for x in parsed.agg(F.count(F.lit(1)), *sums).first())
        log = CommitLog(spark, store)
        if not log.has(name):
            number, folder = log.last() + 1, log.folder()
            _take_in(spark, parsed.drop("_mark"), store, folder, options)
            log.commit(number, name, folder)


def _take_in(spark: SparkSession, parsed: DataFrame, store: str, folder: str, options) -> None:
    def write(df: DataFrame, table: str) -> DataFrame:
        """What the batch has in ``table``, which nobody else sees yet."""
        path = f"{store}/{table}/folder={folder}"
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    found = unique_snapshots(snapshot_table(parsed))
    known = stored_snapshots(spark, store).drop("batch")
    earlier = known.select(*GROUP, F.col("path").alias("_earlier"))
    # A file that is sent again is the one it was.
    again = found.select(*GROUP, "path").join(earlier, list(GROUP)).filter(
        F.col("path") != F.col("_earlier")
    )
    again = again.select(
        "path",
        F.lit("repeated").alias("status"),
        F.concat(F.lit("the same snapshot is in "), "_earlier").alias("reason"),
    )
    left_out = quarantine(snapshot_status(parsed)).unionByName(again)
    listed = _stored(spark, store, "rejected").select("path", "status", "reason")
    write(left_out.join(listed, left_out.columns, "left_anti"), "rejected")

    fresh = durable(found.join(known, list(GROUP), "left_anti"))
    mine = write(fresh.select(*GROUP, "scan_ts", "path"), "snapshots")
    rows = prepare(snapshot_entries(fresh), **options)
    rows = write(rows.select(*GROUP, *ENTRY_COLUMNS, ORD), "rows")

    snapshots = known.unionByName(mine)
    on_hosts = durable(snapshots.join(mine.select("host").distinct(), "host", "left_semi"))
    pairs = durable(previous_snapshots(on_hosts))
    old = mine.select("host", F.col("snapshot_id").alias("old_snapshot_id"))
    as_new = pairs.join(mine, list(GROUP), "left_semi")
    as_old = pairs.join(old, ["host", "old_snapshot_id"], "left_semi")
    pairs = write(as_new.unionByName(as_old).distinct().select(*PAIR), "pairs")
    # Only the two snapshots of each pair are read.
    sides = pairs.select("host", F.explode(F.array("old_snapshot_id", "snapshot_id")).alias("snapshot_id"))
    history = _stored(spark, store, "rows").drop("batch").unionByName(rows)
    history = history.join(sides.distinct(), list(GROUP), "left_semi")
    write(consecutive_diff(history, pairs=pairs), "diffs")


def run_intake(spark: SparkSession, inbox: str, store: str, checkpoint: str, **options):
    """Take in all files that arrived since the last run, then stop."""

    def process(texts: DataFrame, batch: int) -> None:
        take_in(texts, store, **options)

    query = (
        stream_texts(spark, inbox)
        .writeStream.option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(process)
        .start()
    )
    query.awaitTermination()
    return query
