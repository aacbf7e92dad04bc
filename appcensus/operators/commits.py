"""Which folders of a table count: a list that is written last.

Data go to folders of a fresh name first.  Then one Parquet file lists them, and from then on,
and not before, readers see them: a job that dies half-way leaves folders that nobody reads, and
a reader meets either all of a commit or nothing of it.  Commits are numbered; a commit that finds
its number taken by another writer fails, and nothing of it counts.
"""

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LIST = "number bigint, name string, folder string, part string"


class CommitLog:
    """The list in ``path/commits``: a row per part of a commit.

    ``name`` says what was committed, ``folder`` is where it is, ``part`` is the part of the table
    that the folder gives anew (null: the folder adds to the table).
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _place(self, folder: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return place, place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def exists(self, folder: str) -> bool:
        place, files = self._place(f"{self.path}/{folder}")
        return files.exists(place)

    def remove(self, folder: str) -> None:
        place, files = self._place(f"{self.path}/{folder}")
        files.delete(place, True)

    def _every(self) -> DataFrame:
        if not self.exists("commits"):
            return self.spark.createDataFrame([], _LIST)
        return self.spark.read.schema(_LIST).parquet(f"{self.path}/commits/*")

    def listed(self) -> DataFrame:
        """The commits that count: of each part the newest, of what has no part all."""
        every = self._every()
        newest = every.groupBy(F.coalesce("part", F.concat(F.lit("commit "), "folder")).alias("_part")).agg(
            F.max_by(F.struct("number", "name", "folder", "part"), "number").alias("_row")
        )
        return newest.select("_row.*")

    def last(self) -> int:
        return self._every().agg(F.max("number")).first()[0] or 0

    def has(self, name: str) -> bool:
        return not self._every().filter(F.col("name") == name).isEmpty()

    def folder(self) -> str:
        """A fresh name."""
        return f"c{uuid.uuid4().hex}"

    def commit(self, number: int, name: str, folder: str, parts: DataFrame | None = None) -> None:
        """List ``folder`` as commit ``number``; ``parts`` (``part``) are what it gives anew."""
        rows = self.spark.range(1) if parts is None else parts.select("part")
        rows = rows.select(
            F.lit(number).cast("bigint").alias("number"), F.lit(name).alias("name"),
            F.lit(folder).alias("folder"),
            (F.lit(None).cast("string") if parts is None else F.col("part")).alias("part"),
        )
        # The writer refuses a number that is there.
        rows.coalesce(1).write.mode("errorifexists").parquet(f"{self.path}/commits/number={number:09d}")

    def superseded(self) -> DataFrame:
        """Parts of commits that newer ones have given anew."""
        live = self.listed().select("number", "part")
        return self._every().filter("part is not null").join(live, ["number", "part"], "left_anti")
