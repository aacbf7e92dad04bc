"""Quality classifier: histogram gradient-boosted trees over document statistics.

Spark works out the statistics of a bounded sample of labelled documents (the hash order of
ids picks it), numpy grows the trees on quantile histograms, and the trees are flattened into
arrays.  Scoring walks all trees for all texts of a batch at once.  The model is small and
fixed in size, whatever the corpus.

Defined results: null and empty texts have zero in every statistic and are scored like any
other; repeated rows get equal scores; rows with a null id are scored and not held out;
without labels of both classes every score is the share of label 1 (a half without labels).
Other columns of the input are not looked at.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.quality_rules import STOP_WORDS
from appcensus.llm.tables import documents, in_python
from appcensus.llm.words import blocks, text_bytes, word_hashes

SAMPLE_ROWS = 20_000
"""Labelled rows the trees are fitted on, at most."""

BINS, DEPTH, TREES = 64, 4, 60
RATE, RIDGE, LEAST_WEIGHT = 0.2, 1.0, 2.0

FEATURES = (
    "log_bytes", "log_words", "bytes_per_word", "symbols", "pipes", "exclamations", "upper",
    "digits", "lines", "wide", "distinct", "top_word", "adjacent_equal", "stop_words",
    "distinct_pairs",
)

_CLASSES = (b"#*$%&<>", b"|", b"!", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"\n")


def _byte_table(characters: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(characters)] = True
    return table


def _stop_hashes() -> np.ndarray:
    raw = " ".join(sorted(set(STOP_WORDS))).encode()
    hashes, _ = word_hashes(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    return np.unique(hashes)


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    upto = np.append(0, np.cumsum(flags, dtype=np.int64))
    return upto[offsets[1:]] - upto[offsets[:-1]]


def statistics(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text."""
    data, offsets = text_bytes(column)
    tables = [_byte_table(c) for c in _CLASSES]
    wide = np.arange(256) >= 0x80
    stops = _stop_hashes()
    out = [np.zeros((0, len(FEATURES)))]
    for row, stop in blocks(offsets):
        at = offsets[row : stop + 1] - offsets[row]
        part = data[offsets[row] : offsets[stop]]
        size = np.diff(at)
        hashes, words = word_hashes(part, at)
        starts = np.append(0, np.cumsum(words))
        stop_words = _per_text(np.isin(hashes, stops), starts)
        same = np.append(False, hashes[1:] == hashes[:-1])
        distinct, top, pairs = np.zeros((3, len(words)))
        for k in range(len(words)):
            mine = hashes[starts[k] : starts[k + 1]]
            if len(mine):
                _, counts = np.unique(mine, return_counts=True)
                distinct[k], top[k] = len(counts), counts.max()
                pairs[k] = len(np.unique(mine[1:] * np.uint64(3) + mine[:-1])) + 1
                same[starts[k]] = False
        n_bytes, n_words = np.maximum(size, 1), np.maximum(words, 1)
        counted = [_per_text(table[part], at) / n_bytes for table in (*tables, wide)]
        out.append(
            np.column_stack(
                [np.log1p(size), np.log1p(words), size / n_words, *counted, distinct / n_words,
                 top / n_words, _per_text(same, starts) / n_words, stop_words / n_words,
                 pairs / n_words]
            )
        )
    return np.concatenate(out)


@dataclass
class Forest:
    """Complete trees as arrays: node k has the children 2k + 1 and 2k + 2.

    ``feature`` and ``limit`` are (trees, inner nodes); a value above the limit goes right, and a
    node that does not split has an infinite limit.  ``value`` is (trees, leaves).
    """

    base: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        trees = np.arange(len(self.feature))
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        inner = self.feature.shape[1] if len(trees) else 0
        for _ in range(int(np.log2(inner + 1))):
            right = x[rows, self.feature[trees, node]] > self.limit[trees, node]
            node = 2 * node + 1 + right
        total = self.base + self.value[trees, node - inner].sum(axis=1)
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def fit(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS
) -> Forest:
    """Boosted trees for the logistic loss; splits are searched in histograms of ``bins``."""
    inner, leaves = 2**depth - 1, 2**depth
    share = y.mean() if len(y) else 0.5
    empty = np.zeros((0, inner))
    if len(y) == 0 or share in (0.0, 1.0):
        share = np.clip(share, 1e-6, 1 - 1e-6)
        base = float(np.log(share / (1 - share)))
        return Forest(base, empty.astype(np.int64), empty, np.zeros((0, leaves)))
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.column_stack([np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)])
    base = float(np.log(share / (1 - share)))
    total = np.full(len(y), base)
    features, limits, values = [], [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-total))
        gradient, weight = y - p, p * (1 - p)
        feature, limit = np.zeros(inner, np.int64), np.full(inner, np.inf)
        node = np.zeros(len(y), np.int64)
        for level in range(depth):
            first, width = 2**level - 1, 2**level
            key = node - first
            best = np.full(width, 1e-6)
            for f, edge in enumerate(edges):
                if not len(edge):
                    continue
                slots = len(edge) + 1
                cell = key * slots + binned[:, f]
                g = np.bincount(cell, gradient, width * slots).reshape(width, slots).cumsum(axis=1)
                h = np.bincount(cell, weight, width * slots).reshape(width, slots).cumsum(axis=1)
                gl, hl, gt, ht = g[:, :-1], h[:, :-1], g[:, -1:], h[:, -1:]
                gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
                gain[(hl < LEAST_WEIGHT) | (ht - hl < LEAST_WEIGHT)] = 0
                cut = gain.argmax(axis=1)
                top = gain[np.arange(width), cut]
                better = top > best
                best[better] = top[better]
                feature[first : first + width][better] = f
                limit[first : first + width][better] = edge[cut[better]]
            node = 2 * node + 1 + (x[np.arange(len(y)), feature[node]] > limit[node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, weight, leaves)
        value = RATE * g / (h + RIDGE)
        total += value[leaf]
        features.append(feature)
        limits.append(limit)
        values.append(value)
    return Forest(base, np.array(features), np.array(limits), np.array(values))


def fold_of(id_column: Column, folds: int) -> Column:
    return F.pmod(F.crc32(id_column.cast("string").cast("binary")), F.lit(folds))


def labelled_sample(
    labels: DataFrame, label: str, keep: Column, rows: int = SAMPLE_ROWS
) -> DataFrame:
    """At most ``rows`` labelled ids, in hash order: ``_of, _label``; the least label of an id counts."""
    picked = labels.filter(keep & F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    picked = picked.groupBy("doc_id").agg(F.min(label).alias(label))
    return (
        picked.orderBy(F.xxhash64("doc_id"), "doc_id", label).limit(rows)
        .select(F.col("doc_id").alias("_of"), F.col(label).cast("double").alias("_label"))
    )


def train(df: DataFrame, labels: DataFrame, keep: Column, label: str = "quality") -> Forest:
    """Trees for the labelled rows for which ``keep`` holds."""
    sample = labelled_sample(labels, label, keep)
    rows = df.select(df["doc_id"].alias("_id"), df["text"].cast("string").alias("_text"))
    # The sample's size is bounded, so every executor may have it.
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_of")).select("_label", "_text", "_id")

    def described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = statistics(batch.column(1))
            yield pa.RecordBatch.from_arrays(
                [batch.column(2).cast(pa.int64()), batch.column(0), *[pa.array(x[:, k]) for k in range(x.shape[1])]],
                names=["_id", "label", *FEATURES],
            )

    names = ("label", *FEATURES)
    schema = ", ".join(["_id bigint", *[f"{name} double" for name in names]])
    # One row of numbers for each id of the sample, however many rows have this id.
    one = in_python(rows, described, schema).groupBy("_id").agg(F.min(F.struct(*names)).alias("_row"))
    table = one.select("_row.*").toPandas()
    # Rows come in any order; sorted, a rerun grows the same trees.
    table = table.sort_values(list(table.columns)).to_numpy()
    return fit(table[:, 1:], table[:, 0])


def classify(df: DataFrame, forest: Forest, held_out: Column, id_column: str = "doc_id") -> DataFrame:
    schema = pa.schema([("_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64())])

    def scored(batches):
        for batch in batches:
            score = forest.score(statistics(batch.column(2)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score)], schema=schema)

    rows = df.select(
        df[id_column].cast("bigint").alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        df["text"].cast("string").alias("_text"),
    )
    out = in_python(rows, scored, "_id bigint, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int")).withColumnRenamed("_id", id_column)


def op2_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_of(F.col("doc_id"), 3) == 1
    return classify(docs, train(docs, labels, ~held_out), held_out)


QUERIES = {"op2_quality_model": op2_quality_model}
ORACLE: dict[str, str] = {}
