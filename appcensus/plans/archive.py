"""The history of all snapshots, kept by merging.

Rows lie by day of the scan and hash bucket of the snapshot: every day has the same number of
files at most, however many hosts were scanned, and a host with a third of a day's rows is in all
buckets of the day.  What is written replaces snapshots of the same host and id and leaves all
others: the buckets that get new rows are copied with them into new folders, which count from the
commit on.  So a second scan on one day stays beside the first, and a job that runs twice leaves
one copy.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from appcensus.operators.commits import CommitLog
from appcensus.operators.durable import durable, temporary_tables
from appcensus.schema import ENTRY_COLUMNS, ENTRY_SCHEMA, GROUP, ORD

BUCKETS = 16

_ROWS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("snapshot_id", T.StringType()),
        T.StructField("scan_ts", T.TimestampType()),
        *[T.StructField(f.name, f.dataType) for f in ENTRY_SCHEMA.fields],
        T.StructField(ORD, T.LongType()),
        T.StructField("folder", T.StringType()),
        T.StructField("scan_date", T.StringType()),
        T.StructField("bucket", T.IntegerType()),
    ]
)


def _part() -> Column:
    return F.concat_ws("/", "scan_date", F.col("bucket").cast("string"))


def _dealt(rows: DataFrame, buckets: int) -> DataFrame:
    return rows.withColumns(
        {
            "scan_date": F.coalesce(F.date_format("scan_ts", "yyyy-MM-dd"), F.lit("none")),
            "bucket": F.pmod(F.xxhash64(*GROUP), F.lit(buckets)).cast("int"),
        }
    )


class History:
    """Prepared rows of all snapshots below ``path``.

    The number of buckets is that of the first commit.  A snapshot is its host, id and day.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.log = spark, path.rstrip("/"), CommitLog(spark, path)
        first = self.log._every().filter("number = 1").select("name").first()
        self.buckets = int(first["name"].rpartition(" ")[2]) if first else buckets

    def _stored(self) -> DataFrame:
        if not self.log.exists("rows"):
            return self.spark.createDataFrame([], _ROWS)
        return self.spark.read.schema(_ROWS).parquet(f"{self.path}/rows")

    def _listed(self) -> DataFrame:
        """The folders that count.  The list is small, and folders it lacks are not opened."""
        live = self.log.listed().filter("number > 0").select(
            "folder", F.element_at(F.split("part", "/"), 1).alias("scan_date"),
            F.element_at(F.split("part", "/"), 2).cast("int").alias("bucket"),
        )
        return self._stored().join(live, ["folder", "scan_date", "bucket"], "left_semi")

    def rows(self) -> DataFrame:
        return self._listed().select(*GROUP, "scan_ts", *ENTRY_COLUMNS, ORD)

    def merge(self, prepared: DataFrame, snapshots: DataFrame | None = None) -> None:
        """Put the rows of some snapshots in the place of what the history has of them.

        ``snapshots`` (``host, snapshot_id, scan_ts``) also names those that have no rows now.
        """
        with temporary_tables(self.spark):
            new = durable(_dealt(prepared.select(*GROUP, "scan_ts", *ENTRY_COLUMNS, ORD), self.buckets))
            come = new.select(*GROUP, "scan_date", "bucket")
            if snapshots is not None:
                come = come.union(_dealt(snapshots, self.buckets).select(*come.columns))
            come = durable(come.distinct())
            if come.isEmpty():
                return
            parts = come.select("scan_date", "bucket").distinct()
            same = F.lit(True)
            for name in (*GROUP, "scan_date"):
                same = same & F.col(name).eqNullSafe(F.col(f"_{name}"))
            gone = come.select(*[F.col(name).alias(f"_{name}") for name in (*GROUP, "scan_date")])
            old = (
                self._listed().join(parts, ["scan_date", "bucket"], "left_semi")
                .join(gone, same, "left_anti").select(*new.columns)
            )
            folder, number = self.log.folder(), self.log.last() + 1
            # A bucket of a day is one file.
            merged = old.unionByName(new).repartition("scan_date", "bucket")
            (
                merged.withColumn("folder", F.lit(folder))
                .write.mode("append").partitionBy("folder", "scan_date", "bucket").parquet(f"{self.path}/rows")
            )
            self.log.commit(number, f"buckets {self.buckets}", folder, parts.select(_part().alias("part")))

    def clean(self) -> None:
        """Delete files that newer ones have replaced; readers that began before lose theirs."""
        for row in self.log.superseded().select("folder", "part").collect():
            day, _, bucket = row["part"].partition("/")
            self.log.remove(f"rows/folder={row['folder']}/scan_date={day}/bucket={bucket}")
