"""Mixing sources to target weights with hash-threshold histograms.

Every document has a fixed 64-bit hash.  A source's mix is all documents as often as the
target holds the whole source, and once more those below a hash threshold.  The threshold
comes from nested histograms: sizes are summed by source and leading hash bits, the bucket
where the running sum meets the budget is found, and only this bucket is summed by its next
bits, until it holds one hash.  Nothing is sorted, each level is a map-side aggregate over
a narrow table, and the thresholds do not depend on how rows are partitioned.

Rows that share a hash (one id, or none) are told apart by the hash of their text, and rows that
share this too by a hash of their number, each refined in the same way where the one before ends.

Targets: all sizes times ``share`` are split by weight; no target exceeds ``most`` times its
source's size, and the excess goes to the others by weight.  The last document goes in or
stays out, whichever is nearer the target.  Sources are put in order by ranges, with sums carried
from range to range, so their number has no bound.

Defined results: a null text has size 0 and comes as often as its source is held whole; a null
source is a source of its own, last in the order; of equal rows as many are taken as the target
needs, whichever; sources of size 0 have target 0; an empty table gives an empty table.  ``df`` may
have any further columns; it gives its rows in the same order whenever it is read, as a table does.
"""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from appcensus.llm.tables import WORDS, documents, quoted, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
LEVEL_BITS = 10
SEED = 20


def fixed_hash(id_column: Column, seed: int = SEED) -> Column:
    """60 bits that depend on the id and the seed only (a null id has a hash too)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(id_column.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 15), 16, 10).cast("bigint")


def _hash_of(value: Column) -> Column:
    """60 bits of a value that tells rows of one id apart."""
    return F.xxhash64(value).bitwiseAND(F.lit((1 << 60) - 1))


HASHES = ("hash", "hash_2", "hash_3")


def _hashes(id_column: Column, text: Column) -> list[Column]:
    number = F.monotonically_increasing_id()
    found = (fixed_hash(id_column), _hash_of(text), _hash_of(number))
    return [value.alias(name) for value, name in zip(found, HASHES)]


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORDS)).cast("bigint")


def _running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """``df`` with the sums of all rows before each in ``order``, and ``_part``.

    Ranges of the order are summed by themselves; what is carried on is one row per range.
    """
    rows = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    rows = written(rows, name)
    here = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    parts = rows.groupBy("_part").agg(*[F.sum(c).alias(f"_in_{k}") for k, c in sums.items()])
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        F.col("_part").alias("_of"),
        *[F.coalesce(F.sum(f"_in_{k}").over(earlier), F.lit(0)).alias(f"_till_{k}") for k in sums],
    )
    # As many rows as there are ranges.
    joined = rows.join(F.broadcast(parts), F.col("_part") == F.col("_of"))
    before = {
        k: F.coalesce(F.sum(c).over(here), F.lit(0)) + F.col(f"_till_{k}") for k, c in sums.items()
    }
    return joined.withColumns(before).drop("_of", *[f"_till_{k}" for k in sums])


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """Per source: ``source, source_size, target``.  ``sizes`` has one row per source.

    A source is at its cap when its weight's part of what is left is more than the cap; in order
    of cap by weight, the capped sources come first.
    """
    sizes = sizes.withColumn("_one", F.lit(1).cast("bigint"))
    rows = _running(sizes, [F.col("source").asc_nulls_last()], {"_n": "_one"}, "mix-sources")
    rows = rows.withColumn(
        "_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int"))
    )
    rows = rows.withColumn("_cap", most * F.col("source_size"))
    rows = rows.withColumn("_ratio", F.col("_cap") / F.col("_weight")).drop("_part")
    total, weight = rows.agg(F.sum("source_size"), F.sum("_weight")).first()
    sums = {"_caps": "_cap", "_weights": "_weight"}
    rows = _running(rows, [F.col("_ratio"), F.col("_n")], sums, "mix-sources")
    level = (F.lit(share * (total or 0)) - F.col("_caps")) / (F.lit(weight or 0) - F.col("_weights"))
    # The first source in this order that its part would not fill up sets the level of all.
    free = rows.select(F.min(F.when(level < F.col("_ratio"), F.struct("_ratio", "_n", level.alias("level"))))["level"])
    at = free.first()[0]
    target = F.col("_cap") if at is None else F.least(F.col("_cap"), at * F.col("_weight"))
    return rows.select("source", "source_size", target.alias("target"))


def _boundary(rows: DataFrame, budgets: DataFrame, bits: int) -> DataFrame:
    """Per source the hash where its budget ends: ``source, left, lo, size, n, all``.

    ``rows``: source, size, hash (0 to 2^60 - 1); ``budgets``: source, budget.  ``left`` is what
    the hashes below ``lo`` leave of the budget, ``size`` and ``n`` are the size and number of the
    rows with this hash; where ``all`` holds the budget is enough for it too, and it is the last.
    """
    total_bits = 60
    state = budgets.select(
        "source", F.col("budget").cast("double").alias("left"), F.lit(0).cast("bigint").alias("low")
    )
    shift = total_bits
    while shift > 0:
        above, shift = shift, max(0, shift - bits)
        at = state.select(F.col("source").alias("_at"), "left", "low")
        inside = rows.join(at, rows["source"].eqNullSafe(at["_at"])).where(
            F.shiftrightunsigned("hash", above) == F.shiftrightunsigned("low", above)
        )
        inside = inside.withColumn("bucket", F.shiftrightunsigned("hash", shift))
        histogram = inside.groupBy("source", "left", "bucket").agg(
            F.sum("size").alias("size"), F.min("hash").alias("lo"), F.max("hash").alias("hi"),
            F.count(F.lit(1)).alias("n"),
        )
        running = Window.partitionBy("source").orderBy("bucket")
        histogram = histogram.withColumn("upto", F.sum("size").over(running))
        # The boundary bucket is the first whose running sum is more than the budget; when
        # there is none, the last one, which is then taken whole.
        pick = F.struct("bucket", "size", "upto", "lo", "hi", "n")
        boundary = histogram.groupBy("source", "left").agg(
            F.min(F.when(F.col("upto") > F.col("left"), pick)).alias("over"), F.max(pick).alias("last")
        )
        level = boundary.select(
            "source", "left", F.coalesce("over", "last").alias("b"), F.col("over").isNull().alias("all")
        )
        state = written(
            level.select(
                "source",
                (F.col("left") - (F.col("b.upto") - F.col("b.size"))).alias("left"),
                F.col("b.lo").alias("low"), "b.size", "b.lo", "b.hi", "b.n", "all",
            ),
            "mix-state",
        )
        if state.filter("lo < hi and not all").isEmpty():
            break
    return state.select("source", "left", "lo", "hi", "size", "n", "all")


def _thresholds(rows: DataFrame, budgets: DataFrame, bits: int) -> DataFrame:
    """Per source where its budget ends: ``source, at, at_2, at_3`` (null: nowhere).

    Rows are taken whose first hash is below ``at``, or the same and the second below ``at_2``, or
    both the same and the third not above ``at_3``.
    """
    ends, found = budgets, None
    for level, name in enumerate(HASHES):
        state = _boundary(rows.withColumn("hash", F.col(name)), ends, bits)
        last = level + 1 == len(HASHES)
        # Where the last hash is one row's, or nothing is left below, the nearer side is taken.
        single = (F.col("n") == 1) | F.lit(last)
        taken = F.col("all") | (F.abs(F.col("left") - F.col("size")) < F.abs("left"))
        here = F.when(F.col("all"), F.col("hi") + 1).when(~single, F.col("lo"))
        here = here.otherwise(F.when(taken, F.col("lo") + 1).otherwise(F.col("lo")))
        state = written(
            state.select(
                F.col("source").alias("_s"), here.alias(f"at_{level}"), (~F.col("all") & ~single).alias("_on"),
                "left", "lo",
            ),
            "mix-ends",
        )
        shown = state.select("_s", f"at_{level}")
        found = shown if found is None else found.join(
            shown.withColumnRenamed("_s", "_t"), F.col("_s").eqNullSafe(F.col("_t")), "left"
        ).drop("_t")
        tied = state.filter("_on").select("_s", "left", "lo")
        if tied.isEmpty():
            break
        # Only the rows with the tied hash are refined by the next one.
        rows = written(
            rows.join(tied.drop("left"), rows["source"].eqNullSafe(tied["_s"]) & (rows[name] == tied["lo"]), "left_semi"),
            "mix-tied",
        )
        ends = tied.select(F.col("_s").alias("source"), F.col("left").alias("budget"))
    for level in range(len(HASHES)):
        if f"at_{level}" not in found.columns:
            found = found.withColumn(f"at_{level}", F.lit(None).cast("bigint"))
    return found.withColumnRenamed("_s", "source")


def _planned(
    rows: DataFrame, weights, share: float, most: float, level_bits: int
) -> DataFrame:
    """Per source ``_source, source_size, target, whole`` and where its budget ends, one small row each.

    ``rows``: source, size and the hashes.
    """
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    times = F.floor(F.col("target") / F.col("source_size"))
    plan = written(
        targets(sizes, weights, share, most)
        .withColumn("whole", F.when(F.col("source_size") > 0, times).otherwise(0))
        .withColumn("budget", F.col("target") - F.col("whole") * F.col("source_size")),
        "mix-plan",
    )
    limits = _thresholds(rows.filter("size > 0"), plan.filter("budget > 0"), level_bits)
    joined = plan.alias("p").join(
        limits.alias("t"), F.col("p.source").eqNullSafe(F.col("t.source")), "left"
    )
    return written(
        joined.select(
            F.col("p.source").alias("_source"), "source_size", "target", "whole",
            *[f"at_{level}" for level in range(len(HASHES))],
        ),
        "mix-plan",
    )


def _narrow(df: DataFrame, id_column: str, source: str, text: str) -> DataFrame:
    rows = df.select(
        df[id_column].alias("_id"), df[source].alias("source"), n_words(df[text]).alias("size"),
        *_hashes(df[id_column], df[text]),
    )
    return written(rows, "mix-rows")


def _copies() -> Column:
    """All documents as often as the source is held whole, and those before its budget's end."""
    before, same = F.lit(False), F.lit(True)
    for level, name in enumerate(HASHES):
        mine, end = F.col(f"_{name}"), F.col(f"at_{level}")
        before = before | (same & F.coalesce(mine < end, F.lit(False)))
        same = same & F.coalesce(mine == end, F.lit(False))
    return F.col("whole") + (before & (F.col("_size") > 0)).cast("bigint")


def mix(
    df: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    id_column: str = "doc_id",
    source: str = "source",
    text: str = "text",
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """Per row: id, ``size``, ``source_size``, ``target``, ``copies``, ``taken``."""
    rows = _narrow(df, id_column, source, text)
    plan = _planned(rows, weights, share, most, level_bits)
    joined = rows.withColumns({f"_{c}": F.col(c) for c in (*HASHES, "size")}).join(
        plan, rows["source"].eqNullSafe(plan["_source"])
    )
    return joined.select(
        F.col("_id").alias(id_column), "size", "source_size", "target",
        _copies().alias("copies"), (_copies() * F.col("size")).alias("taken"),
    )


def mixed(
    df: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    level_bits: int = LEVEL_BITS,
) -> DataFrame:
    """The rows of the mix with their columns, each as often as it is taken.

    A row's own hash decides, so texts are filtered where they are.
    """
    plan = _planned(_narrow(df, "doc_id", "source", "text"), weights, share, most, level_bits)
    packed = df.select(
        F.struct(*[df[quoted(c)] for c in df.columns]).alias("_row"),
        df["source"].alias("_of"),
        *[value.alias(f"_{name}") for value, name in zip(_hashes(df["doc_id"], df["text"]), HASHES)],
        n_words(df["text"]).alias("_size"),
    )
    rows = packed.join(plan, packed["_of"].eqNullSafe(plan["_source"])).withColumn("_copies", _copies())
    rows = rows.filter("_copies > 0").select(
        "_row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_copies"))).alias("_copy")
    )
    return rows.select("_row.*")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


OP6_SQL = rf"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}')) as size,
         cast('0x' || substr(md5('{SEED}:' || doc_id), 1, 15) as bigint) as hash
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size,
         [3, 1, 2][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from d group by source
), o as (
  select *, 2.0::double * source_size as cap, 2.0::double * source_size / weight as ratio from s
), v as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (
           order by ratio, source rows between unbounded preceding and 1 preceding), 0))
           / sum(weight) over (
           order by ratio, source rows between current row and unbounded following) as level
  from o
), t as (
  select source, source_size, least(cap, coalesce(weight * (
           select arg_min(level, ratio) from v where level < ratio), cap)) as target
  from v
), b as (
  select *, target - floor(target / source_size) * source_size as budget,
         cast(floor(target / source_size) as bigint) as whole
  from t where source_size > 0
), r as (
  select d.*, b.source_size, target, budget, whole,
         sum(size) over (partition by d.source order by hash) as upto
  from d join b on d.source is not distinct from b.source
)
select doc_id, size, source_size, target,
       size * (whole + cast(budget > 0 and (upto <= budget
         or (upto - size < budget and upto - budget < budget - (upto - size))) as bigint)) as taken
from r
"""

QUERIES = {"op6_mixing": op6_mixing}
ORACLE = {"op6_mixing": OP6_SQL}
