"""Ranked lexical search over documents ordered by the length of their impact vectors.

A document is the vector of its impacts on the terms that any item has, each times the root of
the term's weight; an item is the vector of its term counts, each times the same root.  Their
inner product is the score.  Documents are written in the order of their length, longest first,
and taken in this order in buckets:

1. length: an item whose length times that of the bucket's longest document is below the item's
   threshold skips the bucket (Cauchy-Schwarz); a class of lengths that all items skip is not read.
2. coordinates: the item's heaviest terms are taken first from the lists of the bucket.  After
   every few of them a document goes whose sum so far, plus what the remaining parts of both
   vectors can give by their lengths, is below the threshold.
3. what is left is scored again in integers.

Thresholds are the last of the best scores known: every task raises its own, and the long
documents, searched first, give those that all others begin with.  Bounds are taken a little
wider than the floating-point error, so they never decide a result.

Items are kept in memory in blocks of bounded size; more items make more passes.  Only counts,
document frequencies of items' terms and thresholds reach the driver.

Defined results: null or empty texts have no terms, and such items no rows; every row of the
documents is a document, repeated ones too, and a null id comes last among equal scores; repeated
rows of items are one item, and rows with one id but other texts are ranked each for itself; an
empty table of either kind gives no rows.  Other columns are not looked at.
"""

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.tables import documents, in_python, written
from appcensus.llm.topk import Best, best_of_all, floors

TOP = 20
BUCKET_ROWS = 4096
FOCUS = 6
"""Terms taken between two looks at the coordinate bound."""
BLOCK_ITEMS = 10_000
BLOCK_BYTES = 32 << 20
"""Items, and bytes of their texts, that are searched together."""
ROUNDS = (1 / 64, 1 / 8, 1.0)
"""Parts of the documents, longest first, after which thresholds are handed to all tasks."""
SLACK = 1e-9
CHUNK = 1 << 20

# ASCII letters and digits and all bytes of other characters make terms; A-Z are lower-cased.
_FOLD = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32
    for b in range(256)
)
_GAP = re.compile(rb"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")

_VECTOR = "doc_id bigint, n bigint, terms array<int>, counts array<bigint>"
_IMPACT = "doc_id bigint, length double, class int, terms array<int>, impacts array<bigint>"
_FOUND = "item int, doc_id bigint, score bigint"


def terms_of(text: bytes) -> Iterator[list[bytes]]:
    """The terms in order, in pieces that keep the memory for a long text bounded."""
    start = 0
    while start < len(text):
        gap = _GAP.search(text, start + CHUNK)
        stop = gap.start() if gap else len(text)
        yield text[start:stop].translate(_FOLD).split()
        start = stop


def _arrow(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {
        "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(),
        "array<int>": pa.list_(pa.int32()), "array<bigint>": pa.list_(pa.int64()),
    }
    fields = [field.strip().split(" ") for field in schema.split(",")]
    arrays = [pa.array(values, kinds[kind]) for values, (_, kind) in zip(columns, fields)]
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def _vectors(rows: DataFrame, vocabulary) -> DataFrame:
    """Each document's number of terms, and its counts of the terms in ``vocabulary``."""

    def count(batches):
        known = vocabulary.value
        for batch in batches:
            ids, sizes, terms, counts = batch.column(0).to_pylist(), [], [], []
            for text in batch.column(1).cast(pa.large_binary()):
                n, found = 0, Counter()
                for piece in terms_of(text.as_py() or b""):
                    n += len(piece)
                    found.update(filter(known.__contains__, piece))
                sizes.append(n)
                pairs = sorted((known[term], tf) for term, tf in found.items())
                terms.append([t for t, _ in pairs])
                counts.append([tf for _, tf in pairs])
            yield _arrow(_VECTOR, [ids, sizes, terms, counts])

    return in_python(rows, count, _VECTOR)


def impact(counts: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * counts) // (1000 * counts + 12 * m)


def weights(df: np.ndarray, n_docs: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _impacts(vectors: DataFrame, n_docs: int, n_terms: int, weight) -> DataFrame:
    """Impact vectors with their length and its class (two classes double it)."""

    def convert(batches):
        root = np.sqrt(weight.value)
        for batch in batches:
            m = np.array([75 + 25 * n * n_docs // n_terms for n in batch.column(1).to_pylist()], np.int64)
            sizes = np.diff(batch.column(2).offsets.to_numpy()).astype(np.int64)
            terms = batch.column(2).flatten().to_numpy()
            values = impact(batch.column(3).flatten().to_numpy(), np.repeat(m, sizes))
            doc = np.repeat(np.arange(len(sizes)), sizes)
            use = root[terms] > 0
            terms, values, doc = terms[use], values[use], doc[use]
            length = np.sqrt(np.bincount(doc, (values * root[terms]) ** 2, len(sizes)))
            ends = np.append(0, np.cumsum(np.bincount(doc, minlength=len(sizes)))).astype(np.int32)
            at = np.flatnonzero(length > 0)
            lists = [
                pa.ListArray.from_arrays(ends, pa.array(x, kind)).take(pa.array(at))
                for x, kind in ((terms, pa.int32()), (values, pa.int64()))
            ]
            kind = np.floor(2 * np.log2(length[at])).astype(np.int32)
            yield _arrow(_IMPACT, [batch.column(0).take(pa.array(at)), length[at], kind, *lists])

    return in_python(vectors, convert, _IMPACT)


def _search(rows: DataFrame, items, weight, known: dict[int, int], top: int) -> DataFrame:
    """The best documents of each task for each item: ``item, doc_id, score``.

    ``known`` has the thresholds that are known.
    """

    def search(batches):
        weigh = weight.value
        best = [Best(top, known.get(k, 1)) for k in range(len(items.value))]
        queries = [_Query(terms, counts, weigh) for terms, counts in items.value]
        sizes = np.array([q.length for q in queries])
        for batch in batches:
            for start in range(0, batch.num_rows, BUCKET_ROWS):
                bucket = _Bucket(batch.slice(start, BUCKET_ROWS), weigh)
                need = np.array([b.floor for b in best], np.float64)
                for k in np.flatnonzero(sizes * bucket.longest * (1 + SLACK) >= need).tolist():
                    left = bucket.candidates(queries[k], best[k].floor)
                    if len(left):
                        best[k].add(bucket.scores(queries[k], left), bucket.ids[left])
        found = [(k, doc_id, score) for k, b in enumerate(best) for doc_id, score in b.rows()]
        yield _arrow(_FOUND, list(zip(*found)) or [[], [], []])

    return in_python(rows, search, _FOUND)


class _Query:
    """An item: its terms, heaviest first, and what of its length is left from each on."""

    def __init__(self, terms: np.ndarray, counts: np.ndarray, weight: np.ndarray):
        value = counts * np.sqrt(weight[terms])
        order = np.argsort(-value, kind="stable")
        self.terms, self.value = terms[order], value[order]
        self.exact = (counts * weight[terms])[order]
        self.rest = np.sqrt(np.append(np.cumsum((self.value**2)[::-1])[::-1], 0.0))
        self.length = self.rest[0]


class _Bucket:
    """Documents of about one length, with a list of documents for each term."""

    def __init__(self, batch: pa.RecordBatch, weight: np.ndarray):
        self.ids = np.array(batch.column(0).to_pylist(), object)
        self.length = batch.column(1).to_numpy()
        self.longest = self.length.max()
        doc = np.repeat(np.arange(batch.num_rows), np.diff(batch.column(3).offsets.to_numpy()))
        terms = batch.column(3).flatten().to_numpy()
        order = np.argsort(terms, kind="stable")
        terms = terms[order]
        self.doc, self.impact = doc[order], batch.column(4).flatten().to_numpy()[order]
        self.value = self.impact * np.sqrt(weight)[terms]
        self.terms, starts = np.unique(terms, return_index=True)
        self.starts = np.append(starts, len(terms))

    def _lists(self, query: _Query) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of the list of each of the item's terms."""
        at = np.minimum(np.searchsorted(self.terms, query.terms), len(self.terms) - 1)
        there = self.terms[at] == query.terms
        return np.where(there, self.starts[at], 0), np.where(there, self.starts[at + 1], 0)

    def candidates(self, query: _Query, floor: int) -> np.ndarray:
        """The documents that the bounds leave."""
        starts, ends = self._lists(query)
        total, rest = np.zeros(len(self.ids)), self.length**2
        left = None
        for k in range(len(query.terms)):
            part = slice(starts[k], ends[k])
            doc, value = self.doc[part], self.value[part]
            total[doc] += query.value[k] * value
            rest[doc] -= value * value
            if k % FOCUS == FOCUS - 1 or k + 1 == len(query.terms):
                # Subtracting leaves an error that the slack of the whole length covers.
                open_part = np.sqrt(np.maximum(rest, 0) + SLACK * self.length**2)
                bound = (total + query.rest[k + 1] * open_part) * (1 + SLACK)
                left = np.flatnonzero(bound >= floor)
                if len(left) * 50 < len(self.ids):
                    break
        return left

    def scores(self, query: _Query, left: np.ndarray) -> np.ndarray:
        place = np.full(len(self.ids), -1, np.int64)
        place[left] = np.arange(len(left))
        out = np.zeros(len(left), np.int64)
        for start, end, times in zip(*self._lists(query), query.exact):
            at = place[self.doc[start:end]]
            out[at[at >= 0]] += times * self.impact[start:end][at >= 0]
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple]]:
    """The items in blocks that a driver and a task can hold: id and text."""
    n, size = items.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    blocks = max(-(-n // BLOCK_ITEMS), -(-(size or 0) // BLOCK_BYTES))
    which = F.pmod(F.xxhash64("item_id", "text"), F.lit(max(blocks, 1)))
    for k in range(blocks):
        found = items.filter(which == k).collect()
        yield sorted((tuple(r) for r in found), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """The ``top`` best documents of every item: ``item_id, rank, doc_id, score``.

    ``docs`` has ``doc_id`` and ``text``, ``items`` has ``item_id`` and ``text``.
    """
    spark = docs.sparkSession
    share = spark.sparkContext.broadcast
    items = written(items.select("item_id", "text").filter("text is not null").distinct(), "items")
    kind = items.schema["item_id"].dataType.simpleString()
    narrow = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    out = spark.createDataFrame([], f"item_id {kind}, rank int, doc_id bigint, score bigint")
    for block in _blocks(items):
        counts = [Counter(t for piece in terms_of(text.encode()) for t in piece) for _, text in block]
        vocabulary = {term: k for k, term in enumerate(sorted(set().union(*counts)))}
        if not vocabulary:
            continue
        vectors = written(_vectors(narrow, share(vocabulary)).filter("n > 0"), "vectors")
        n_docs, n_terms = vectors.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            break
        holding = np.zeros(len(vocabulary), np.int64)
        for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            holding[r["t"]] = r["count"]
        weight = share(weights(holding, n_docs))
        queries = share([
            (np.array([vocabulary[t] for t in c], np.int64), np.array(list(c.values()), np.int64))
            for c in counts
        ])

        impacts = _impacts(vectors.filter("size(terms) > 0"), n_docs, n_terms, weight)
        order = [F.desc("length"), F.asc("doc_id"), F.asc("_tie")]
        impacts = impacts.withColumn("_tie", F.monotonically_increasing_id())
        impacts = impacts.repartitionByRange(*order).sortWithinPartitions(*order).drop("_tie")
        impacts = written(impacts, "impacts")
        found, known = None, {}
        lengths = [_Query(terms, n, weight.value).length for terms, n in queries.value]
        for classes in _rounds(impacts):
            needed = [
                kind for kind, longest in classes
                if any(q * longest * (1 + SLACK) >= known.get(k, 1) for k, q in enumerate(lengths))
            ]
            if needed:
                rows = _search(impacts.filter(F.col("class").isin(needed)), queries, weight, known, top)
                rows = written(rows, "found")
                found = rows if found is None else found.union(rows)
                known = floors(found, "item", "doc_id", top)
        if found is not None:
            names = spark.createDataFrame([(k, r[0]) for k, r in enumerate(block)], f"item int, item_id {kind}")
            best = best_of_all(found, "item", "doc_id", top).join(F.broadcast(names), "item")
            out = out.union(best.select("item_id", "rank", "doc_id", "score"))
    return out


def _rounds(impacts: DataFrame) -> list[list[tuple[int, float]]]:
    """Classes of length with their greatest length, longest first, cut where ``ROUNDS`` says."""
    kinds = impacts.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.max("length").alias("longest"))
    kinds = sorted(kinds.collect(), reverse=True)
    total, seen, rounds = sum(r["n"] for r in kinds), 0, [[] for _ in ROUNDS]
    for r in kinds:
        k = next(k for k, part in enumerate(ROUNDS) if seen <= part * total)
        rounds[k].append((r["class"], r["longest"]))
        seen += r["n"]
    return [r for r in rounds if r]


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = (
    r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    r" 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
)

OP12_SQL = rf"""
with d as (
  select row_number() over () as r, doc_id, {_TERMS} as terms from documents
), s as (
  select count(*) as n_docs, cast(sum(len(terms)) as bigint) as n_terms from d where len(terms) > 0
), q as (
  select item_id, term, count(*) as c
  from (select item_id, unnest({_TERMS}) as term from (select distinct item_id, text from benchmark))
  group by item_id, term
), f as (
  select r, doc_id, n, term, count(*) as tf
  from (select r, doc_id, len(terms) as n, unnest(terms) as term from d)
  where term in (select term from q) group by r, doc_id, n, term
), w as (
  select term, cast(floor(1000 * ln((2 * any_value(n_docs) + 2)::double / (2 * count(*) + 1))) as bigint) as w
  from f, s group by term
), p as (
  select item_id, r, doc_id, cast(sum(c * w * ((1000000000 * tf)
           // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) as bigint) as score
  from q join f using (term) join w using (term), s group by item_id, r, doc_id
)
select item_id, cast(rank as integer) as rank, doc_id, score
from (select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from p where score > 0)
where rank <= {TOP}
"""

QUERIES = {"op12_lexical_search": op12_lexical_search}
ORACLE = {"op12_lexical_search": OP12_SQL}
