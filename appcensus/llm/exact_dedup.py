"""Exact dedup against a persistent digest index.

The index is a table of distinct digests, bucketed and sorted by digest.  New rows are
reduced to one row per digest (map-side first, so a text that makes up a third of all rows
costs a few rows per task), anti-joined with the index by sort-merge on the digest and
appended with their number of copies.  Only digests travel; texts never leave the scan.

Every append adds a file to each bucket.  When there are many, the buckets are merged into one
sorted file each, in a table beside the old one that counts once it is complete; the number of
buckets follows the number of digests, also of the first batch.  A merged bucket is read in its order and not sorted again.

Texts are equal when they agree after lower-casing A-Z only.  Defined results: a null text
counts as empty, and empty texts are copies of each other; of equal texts the largest id
stays (a null id is smaller than any); a digest already in the index keeps none of the new
rows.  ``deduplicate`` and ``keep_new`` decide by id, so rows that share the largest id all
stay.  ``keep_one``, the stage of the pipeline, tells these apart by row: exactly one stays.
"""

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.tables import documents, new_path, one_of_each, without, written

BUCKETS = 8
"""Buckets of an index at least."""
BUCKET_DIGESTS = 4_000_000
"""Digests of a bucket at most, when an index gets its first batch and when buckets are merged."""
MERGE_BATCHES = 8
"""Batches, each a file or more of every bucket, that are merged into one."""
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    # For ASCII the general function does the same and is several times faster.
    ascii_only = F.octet_length(text) == F.length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def digest(text: Column) -> Column:
    return F.sha2(folded(text).cast("binary"), 256)


class DigestIndex:
    """Tables below ``path`` with the digests ever seen: ``digest, first_id, batch, copies, fresh``.

    A batch has one row per digest it holds; ``fresh`` tells the one that brought the digest.
    The files outlive the session: another session opens the same path.  ``append`` adds what the
    index lacks of a batch, so a batch that is tried again under its name adds nothing twice, and
    the digests that it added itself (same batch, same first id) count as new to it.  Merging
    keeps the batch that brought a digest and forgets which ones added copies: merge when no
    batch will be tried again.
    """

    _COLUMNS = ("digest", "first_id", "batch", "copies", "fresh")

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path, self.least = spark, path.rstrip("/"), buckets
        # A bucket that is one file is read in its order.
        spark.conf.set("spark.sql.legacy.bucketedTableScan.outputOrdering", "true")
        self._open(*self._latest())

    def _files(self, folder: str):
        place = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        return place.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), place

    def _latest(self) -> tuple[int, int]:
        """Version and number of buckets of the newest table that is complete."""
        files, place = self._files(self.path)
        found = [(0, self.least)]
        for status in files.listStatus(place) if files.exists(place) else []:
            name = status.getPath().getName()
            version, _, buckets = name.removeprefix("version-").partition("-of-")
            done = files.exists(self._files(f"{self.path}/{name}/_SUCCESS")[1])
            if name.startswith("version-") and (done or int(version) == 0):
                found.append((int(version), int(buckets)))
        return max(found, key=lambda f: f[0] + (f is not found[0]) / 2)

    def _open(self, version: int, buckets: int) -> None:
        self.version, self.buckets = version, buckets
        self.location = f"{self.path}/version-{version:06d}-of-{buckets}"
        known_as = hashlib.sha256(self.location.encode()).hexdigest()[:32]
        self.name = f"digest_index_{known_as}"
        self.spark.sql(
            f"create table if not exists `{self.name}` (digest string, first_id bigint, batch string,"
            f" copies bigint, fresh boolean) using parquet clustered by (digest) sorted by (digest)"
            f" into {buckets} buckets location '{self.location}'"
        )

    def _every(self) -> DataFrame:
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """``digest, first_id, batch``, one row per digest."""
        return self._every().filter("fresh").select("digest", "first_id", "batch")

    def groups(self) -> DataFrame:
        """``digest, keep_id, group_size`` over all batches; nothing is shuffled."""
        return self._every().groupBy("digest").agg(
            F.max(F.when(F.col("fresh"), F.col("first_id"))).alias("keep_id"),
            F.sum("copies").alias("group_size"),
        )

    def unseen(self, digests: DataFrame) -> DataFrame:
        """Rows of ``digests`` (one per digest) that the index lacks, by sort-merge anti-join."""
        return digests.join(self.rows().select("digest").hint("merge"), "digest", "left_anti")

    def new_to(self, groups: DataFrame, batch: str) -> DataFrame:
        """``digest`` of ``groups`` (``digest, keep_id``) that the index lacks or has from ``batch``."""
        seen = self.rows().select(F.col("digest").alias("_seen"), "first_id", "batch").hint("merge")
        own = F.coalesce(F.col("batch") == batch, F.lit(False)) & F.col("first_id").eqNullSafe(
            F.col("keep_id")
        )
        at = (F.col("digest") == F.col("_seen")) & ~own
        return groups.select("digest", "keep_id").join(seen, at, "left_anti").select("digest")

    def _write(self, rows: DataFrame, mode: str) -> None:
        # Each bucket is one task's, so that it becomes one sorted file.
        (
            rows.select(*self._COLUMNS).repartition(self.buckets, "digest")
            .write.mode(mode).format("parquet")
            .bucketBy(self.buckets, "digest").sortBy("digest")
            .option("path", self.location).saveAsTable(self.name)
        )
        self.spark.catalog.refreshTable(self.name)

    def append(self, groups: DataFrame, batch: str) -> None:
        """Add a batch's ``digest, keep_id, group_size, new``."""
        mine = self._every().filter(F.col("batch") == batch).select("digest").hint("merge")
        rows = groups.select(
            "digest", F.col("keep_id").alias("first_id"), F.lit(batch).alias("batch"),
            F.col("group_size").alias("copies"), F.coalesce("new", F.lit(False)).alias("fresh"),
        )
        # Written down first: a table cannot be read and appended to in one job.
        rows = written(rows.join(mine, "digest", "left_anti"), "new-digests")
        if self._every().isEmpty() and self._needed(rows) > self.buckets:
            self._open(self.version + 1, self._needed(rows))
            self._write(rows, "overwrite")
        else:
            self._write(rows, "append")
        if self._every().agg(F.count_distinct("batch")).first()[0] >= MERGE_BATCHES:
            self.merge()

    def _needed(self, rows: DataFrame) -> int:
        buckets, digests = self.least, rows.count()
        while digests > buckets * BUCKET_DIGESTS:
            buckets *= 2
        return buckets

    def merge(self) -> None:
        """Make every bucket one sorted file, in as many buckets as the digests need."""
        one = F.struct("first_id", "batch")
        rows = self._every().groupBy("digest").agg(
            F.max(F.when(F.col("fresh"), one)).alias("_first"), F.sum("copies").alias("copies")
        ).select("digest", "_first.first_id", "_first.batch", "copies", F.lit(True).alias("fresh"))
        rows = written(rows, "merged-digests")
        self._open(self.version + 1, self._needed(rows))
        self._write(rows, "overwrite")


def _digests(df: DataFrame, id_column: str, text: str) -> DataFrame:
    return written(
        df.select(
            df[id_column].alias("_id"),
            digest(df[text]).alias("digest"),
            F.xxhash64(df[text]).alias("_raw"),
        ),
        "digests",
    )


def _added(rows: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """Add a batch to ``index``: ``digest, keep_id, group_size, new`` of its groups."""
    groups = rows.groupBy("digest").agg(
        F.max("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
    )
    fresh = index.new_to(groups, batch).withColumn("new", F.lit(True))
    groups = written(groups.join(fresh, "digest", "left"), "groups")
    index.append(groups, batch)
    return groups


def _verdicts(
    df: DataFrame, index: DigestIndex, id_column: str, text: str, batch: str | None
) -> DataFrame:
    rows = _digests(df, id_column, text)
    groups = _added(rows, index, batch or uuid.uuid4().hex)
    # The left side may be skewed; adaptive execution splits it, the right has one row a key.
    kept = F.col("_id").eqNullSafe(F.col("keep_id")) & F.coalesce("new", F.lit(False))
    return rows.join(groups, "digest").withColumn("kept", kept)


def _by_halves(df: DataFrame, index: DigestIndex, id_column: str, text: str) -> DataFrame:
    """Verdicts over a whole table that goes into a new ``index`` in two batches.

    The half with the larger ids goes first, so the id that the index has of a digest is the
    largest, and the other half is rejected where the index has its digests.
    """
    rows = _digests(df, id_column, text)
    middle = rows.agg(F.percentile_approx("_id", 0.5)).first()[0]
    later = F.coalesce(F.col("_id") >= F.lit(middle), F.lit(False))
    for name, part in (("later ids", later), ("earlier ids", ~later)):
        _added(rows.filter(part), index, name)
    kept = F.col("_id").eqNullSafe(F.col("keep_id"))
    return rows.join(index.groups(), "digest").withColumn("kept", kept)


def deduplicate(
    df: DataFrame,
    index: DigestIndex,
    id_column: str = "doc_id",
    text: str = "text",
    batch: str | None = None,
) -> DataFrame:
    """Verdict of each row: id, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The batch is added to ``index`` before the caller has written its rows: give it a name
    (``batch``), and under that name it can be tried again with the same verdicts.  Without one
    it cannot.  Groups are those of this batch.
    """
    return _verdicts(df, index, id_column, text, batch).select(
        F.col("_id").alias(id_column), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


def keep_new(
    df: DataFrame,
    index: DigestIndex,
    id_column: str = "doc_id",
    text: str = "text",
    batch: str | None = None,
) -> DataFrame:
    """The rows of ``df`` that stay, with their columns.

    The dropped rows are the smaller side, and they are known by id and text.
    """
    dropped = _verdicts(df, index, id_column, text, batch).filter("not kept").select("_id", "_raw")
    return without(df, dropped, id_column, text)


def keep_one(
    df: DataFrame,
    index: DigestIndex,
    id_column: str = "doc_id",
    text: str = "text",
    batch: str | None = None,
) -> DataFrame:
    """Exactly one row of each group of equal texts that the index lacks, with its columns."""
    return _one_of(df, _verdicts(df, index, id_column, text, batch), id_column, text)


def deduplicate_table(
    df: DataFrame, index: DigestIndex, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``deduplicate`` of a whole table through a new index, in two batches; groups are the table's."""
    return _by_halves(df, index, id_column, text).select(
        F.col("_id").alias(id_column), "keep_id", "group_size", "kept",
        F.col("digest").alias("text_sha256"),
    )


def keep_one_of_table(
    df: DataFrame, index: DigestIndex, id_column: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``keep_one`` of a whole table through a new index, in two batches."""
    return _one_of(df, _by_halves(df, index, id_column, text), id_column, text)


def _one_of(df: DataFrame, rows: DataFrame, id_column: str, text: str) -> DataFrame:
    rows = rows.withColumnRenamed("digest", "_group")
    return one_of_each(df, rows.select("_id", "_raw", "_group", "kept"), id_column, text)


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = DigestIndex(spark, new_path(spark, "digest-index"))
    return deduplicate_table(documents(spark, sf_dir), index)


OP4_SQL = f"""
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), '{UPPER}', '{LOWER}')) as text_sha256
  from documents
)
select doc_id, max(doc_id) over g as keep_id, count(*) over g as group_size,
       doc_id = max(doc_id) over g as kept, text_sha256
from d window g as (partition by text_sha256)
"""

QUERIES = {"op4_exact_dedup": op4_exact_dedup}
ORACLE = {"op4_exact_dedup": OP4_SQL}
