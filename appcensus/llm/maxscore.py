"""Exact inner-product search with MaxScore over shards of integer vectors.

A dimension is a term of the query, and a shard's posting list of it holds the vectors whose
component is not 0, with the range of the values.  The range bounds what the term can add to a
score.  Terms are ordered by this bound; the longest row of the smallest ones whose bounds add up
to less than the query's threshold is not essential: a vector found in their lists alone cannot be
among the best.  So

1. the lists of the essential terms are traversed, and their products summed,
2. vectors whose sum and the bounds of the other terms reach the threshold are competitive; the
   other terms are probed for these only, the largest bound first, and fewer stay after each,
3. the best of the shards are merged, in each task and then over all tasks.

A task raises the thresholds from shard to shard, and a part of the vectors is searched first so
that all tasks begin with thresholds.  Every vector meets every query in one of the two passes.

Queries are kept in memory in blocks of bounded size; the vectors are read once for each block and
never shuffled.  Products are exact: in double numbers below 2^53, in whole numbers of any size
beyond.

Defined results: vectors that are null or hold a null, an infinity or a NaN take no part; a shorter
vector counts as filled up with zeros, and an empty one scores 0; every row is a vector of its own,
repeated rows too, and a query leaves out its own row only; a null id is no query and comes last
among equal scores; components stop at the range of a 64-bit integer, and so do scores; an empty
table gives no rows.  Other columns are not looked at.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.tables import in_python, written
from appcensus.llm.topk import Best, best_of_all, floors

TOP = 10
EVERY = 100
SCALE = 1024
SHARD_ROWS = 4096
SHARD_COMPONENTS = 1 << 20
BLOCK_COMPONENTS = 4 << 20
"""Components of all queries that are searched together."""
FIRST = 16
"""One vector of so many is searched first, for thresholds."""
PROBES = 4
"""Terms probed between two looks at who is still competitive."""

_FOUND = "query bigint, vec_id bigint, score bigint"


def whole(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(scale * x.cast("double")).cast("bigint"))


def usable(vector: Column) -> Column:
    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))

    return F.coalesce(vector.isNotNull() & F.forall(vector, finite), F.lit(False))


def _matrix(lists: pa.Array) -> np.ndarray:
    """A row per dimension, a column per vector, filled up with zeros."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy()
    out = np.zeros((int(sizes.max(initial=0)), len(sizes)), np.int64)
    if len(flat):
        row = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        out[row, np.repeat(np.arange(len(sizes)), sizes)] = flat
    return out


def _largest(values: np.ndarray) -> int:
    return max(int(values.max()), -int(values.min())) if values.size else 0


class _Shard:
    """Vectors by dimension, with the posting lists that do not hold them all."""

    def __init__(self, rows: np.ndarray, ids: np.ndarray, values: np.ndarray, largest: int):
        self.rows, self.ids = rows, ids
        exact = len(values) * largest * _largest(values) < 1 << 53
        self.values = values.astype(np.float64 if exact else object)
        self.least, self.most = (
            (self.values.min(1), self.values.max(1)) if values.size else (np.zeros(len(values)),) * 2
        )
        self.lists = [None if x.all() else np.flatnonzero(x) for x in values]

    def search(self, row: int, query: np.ndarray, best: Best) -> None:
        q = np.zeros(len(self.values), self.values.dtype)
        q[: len(query)] = query[: len(q)]
        bounds = np.maximum(q * self.least, q * self.most)
        order = np.argsort(bounds, kind="stable")
        sums = np.cumsum(bounds[order])
        others = 0
        if best.floor is not None:
            if (sums[-1] if len(sums) else 0) < best.floor:
                return
            below = np.flatnonzero(sums < best.floor)
            others = int(below[-1]) + 1 if len(below) else 0
        essential, rest = order[others:], sums[others - 1] if others else 0
        found = [self.lists[j] for j in essential]
        if others == 0 or any(x is None for x in found):
            docs = np.arange(len(self.rows))
            used = q.copy()
            used[order[:others]] = 0
            part = used @ self.values
        else:
            docs = np.unique(np.concatenate(found))
            part = q[essential] @ self.values[np.ix_(essential, docs)]
        for k, j in enumerate(order[:others][::-1]):
            if k % PROBES == 0:
                stay = part + rest >= best.floor
                docs, part = docs[stay], part[stay]
            part = part + q[j] * self.values[j, docs]
            rest = rest - bounds[j]
        other = self.rows[docs] != row
        best.add(_long(part[other]), self.ids[docs[other]])


def _long(values: np.ndarray) -> np.ndarray:
    if values.dtype == object:
        least, most = -(1 << 63), (1 << 63) - 1
        return np.array([min(max(int(v), least), most) for v in values.tolist()], np.int64)
    return values.astype(np.int64)


def _search(vectors: DataFrame, queries, known: dict[int, int], top: int) -> DataFrame:
    """The best vectors of each task for each query: ``query, vec_id, score``."""

    def search(batches):
        rows, wanted = queries.value
        largest = max(map(_largest, wanted), default=0)
        best = [Best(top, known.get(row)) for row in rows]
        for batch in batches:
            wide = int(np.diff(batch.column(2).offsets.to_numpy()).max(initial=1)) or 1
            step = max(1, min(SHARD_ROWS, SHARD_COMPONENTS // wide))
            for start in range(0, batch.num_rows, step):
                piece = batch.slice(start, step)
                shard = _Shard(
                    piece.column(0).to_numpy(), np.array(piece.column(1).to_pylist(), object),
                    _matrix(piece.column(2)), largest,
                )
                for row, query, b in zip(rows, wanted, best):
                    shard.search(row, query, b)
        found = [(row, x, score) for row, b in zip(rows, best) for x, score in b.rows()]
        columns = list(zip(*found)) or [[], [], []]
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, pa.int64()) for c in columns], names=["query", "vec_id", "score"]
        )

    return in_python(vectors, search, _FOUND)


def _blocks(queries: DataFrame) -> Iterator[tuple[DataFrame, list]]:
    """The queries in blocks that a driver and a task can hold."""
    n, size = queries.agg(F.count(F.lit(1)), F.sum(F.size("vector"))).first()
    blocks = max(-(-(size or 0) // BLOCK_COMPONENTS), 1 if n else 0, -(-n * 8 // BLOCK_COMPONENTS))
    for k in range(blocks):
        block = queries.filter(F.pmod(F.xxhash64("row"), F.lit(blocks)) == k)
        yield block, sorted(tuple(r) for r in block.select("row", "vector").collect())


def search(df: DataFrame, is_query: Column, top: int = TOP, scale: int = SCALE) -> DataFrame:
    """The ``top`` best rows for every query row: ``query_id, rank, vec_id, score``.

    ``df`` has ``vec_id`` and ``embedding``; ``is_query`` is a condition on its rows.
    """
    spark = df.sparkSession
    rows = df.select(
        df["vec_id"].cast("bigint").alias("vec_id"), whole(df["embedding"], scale).alias("vector"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    ).filter(usable(df["embedding"]))
    vectors = written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors")
    narrow = vectors.select("row", "vec_id", "vector")
    early = F.pmod(F.xxhash64("row"), F.lit(FIRST)) == 0
    out = spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    for block, asked in _blocks(vectors.filter("asks")):
        queries = spark.sparkContext.broadcast(
            ([row for row, _ in asked], [np.array(v, np.int64) for _, v in asked])
        )
        found = written(_search(narrow.filter(early), queries, {}, top), "found")
        known = floors(found, "query", "vec_id", top)
        found = found.union(written(_search(narrow.filter(~early), queries, known, top), "found"))
        names = block.select(F.col("row").alias("query"), F.col("vec_id").alias("query_id"))
        best = best_of_all(found, "query", "vec_id", top).join(names, "query")
        out = out.union(best.select("query_id", "rank", "vec_id", "score"))
    return out


def op13_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(df, df["vec_id"] % EVERY == 0)


OP13_SQL = f"""
with v as (
  select row_number() over () as r, vec_id,
         list_transform(embedding, lambda x: floor({SCALE} * x::double)) as e
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
), s as (
  select q.r as query, q.vec_id as query_id, c.vec_id,
         cast(list_inner_product(q.e, c.e) as bigint) as score
  from v q join v c on q.r <> c.r where q.vec_id % {EVERY} = 0
)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query order by score desc, vec_id) as rank from s)
where rank <= {TOP}
"""

QUERIES = {"op13_maxscore": op13_maxscore}
ORACLE = {"op13_maxscore": OP13_SQL}
