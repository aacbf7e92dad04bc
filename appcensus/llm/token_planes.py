"""Token-ID files with bit-plane shuffling.

Documents are ordered by id in range partitions, encoded, and written as chunks.  A chunk
holds the ids of consecutive documents in blocks of a fixed number of ids.  A block is
transposed into planes (the n-th byte, or the n-th bit, of every id), each plane is compressed
with zstandard, and a plane of zeros takes no bytes.  The chunk begins with its own index of
block and plane sizes, so one block can be read alone:

    magic "TKPL", version 1, plane kind (0 byte, 1 bit), two bytes 0
    uint32: ids in a block, number of ids, planes in a block, number of blocks
    uint32 per block and plane: compressed size
    the planes

All numbers are little-endian.  Spark writes the chunks (its committers make a lost executor
harmless) as rows of a Parquet table with the place of every document in its chunk, and a
chunk index: partition, number, first id of all before it, number of ids, bytes.

Defined results: null and empty texts give the end id only; repeated rows are documents of
their own, next to each other; documents with a null id come first; an empty table gives
empty files.  Other columns of the input are not looked at.
"""

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark import TaskContext

from appcensus.llm.bpe import Encoder, default_vocabulary
from appcensus.llm.tables import documents, in_python, new_path

BLOCK_IDS = 16_384
CHUNK_IDS = 262_144
END_ID = 2
MAGIC = b"TKPL"
BYTES, BITS = 0, 1
LEVEL = 1


def _planes(block: np.ndarray, kind: int) -> Iterator[np.ndarray]:
    raw = block.astype("<u4").view(np.uint8).reshape(-1, 4)
    if kind == BYTES:
        for k in range(4):
            yield np.ascontiguousarray(raw[:, k])
    else:
        bits = np.unpackbits(raw, axis=1, bitorder="little")
        for k in range(32):
            yield np.packbits(bits[:, k], bitorder="little")


def pack(ids: np.ndarray, block_ids: int = BLOCK_IDS, kind: int = BYTES) -> bytes:
    """One chunk."""
    press = zstandard.ZstdCompressor(level=LEVEL)
    sizes, planes = [], []
    for start in range(0, len(ids), block_ids):
        for plane in _planes(ids[start : start + block_ids], kind):
            packed = press.compress(plane.tobytes()) if plane.any() else b""
            sizes.append(len(packed))
            planes.append(packed)
    per_block = 4 if kind == BYTES else 32
    head = np.array([block_ids, len(ids), per_block, -(-len(ids) // block_ids), *sizes], "<u4")
    return MAGIC + bytes([1, kind, 0, 0]) + head.tobytes() + b"".join(planes)


def unpack(chunk: bytes, blocks: range | None = None) -> np.ndarray:
    """The ids of a chunk, or of some of its blocks."""
    if chunk[:4] != MAGIC or chunk[4] != 1:
        raise ValueError("not a token chunk")
    kind = chunk[5]
    block_ids, count, per_block, n_blocks = np.frombuffer(chunk, "<u4", 4, 8).tolist()
    sizes = np.frombuffer(chunk, "<u4", per_block * n_blocks, 24)
    starts = 24 + 4 * len(sizes) + np.append(0, np.cumsum(sizes, dtype=np.int64))
    press, out = zstandard.ZstdDecompressor(), []
    for block in range(n_blocks) if blocks is None else blocks:
        n = min(block_ids, count - block * block_ids)
        raw = np.zeros((n, 4 if kind == BYTES else 32), np.uint8)
        for k in range(per_block):
            at = block * per_block + k
            if sizes[at]:
                plane = np.frombuffer(press.decompress(chunk[starts[at] : starts[at + 1]]), np.uint8)
                raw[:, k] = plane if kind == BYTES else np.unpackbits(plane, count=n, bitorder="little")
        if kind == BITS:
            raw = np.packbits(raw, axis=1, bitorder="little")
        out.append(np.ascontiguousarray(raw).view("<u4").reshape(-1))
    return np.concatenate(out) if out else np.zeros(0, "<u4")


_CHUNK = (
    "part bigint, number bigint, n_ids bigint, least_id bigint, doc_ids array<bigint>,"
    " n_tokens array<bigint>, data binary"
)


class TokenFiles:
    """Chunks and chunk index below a path."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def write(
        self, df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text",
        end_id: int = END_ID, kind: int = BYTES, chunk_ids: int = CHUNK_IDS,
    ) -> None:
        rows = df.select(
            df[id_column].cast("bigint").alias("_id"), df[text].cast("string").alias("_text"),
            F.monotonically_increasing_id().alias("_tie"),
        )
        # The text's hash settles the order of rows with the same id, and a number parts equal rows.
        order = [F.col("_id").asc_nulls_first(), F.xxhash64("_text"), F.col("_tie")]
        rows = rows.repartitionByRange(*order).sortWithinPartitions(*order)

        def chunks(batches):
            encoder, part, number = Encoder.of(vocabulary), TaskContext.get().partitionId(), 0
            ids, docs, size = [], [], 0
            schema = pa.schema(
                [("part", pa.int64()), ("number", pa.int64()), ("n_ids", pa.int64()),
                 ("least_id", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
                 ("n_tokens", pa.list_(pa.int64())), ("data", pa.binary())]
            )

            def chunk():
                flat = np.concatenate(ids)
                row = [part, number, len(flat), docs[0], list(docs), [len(x) for x in ids],
                       pack(flat, kind=kind)]
                return pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip(row, schema)], schema=schema
                )

            for batch in batches:
                names = batch.column(0).to_pylist()
                for k, found in enumerate(encoder.encoded(batch.column(1))):
                    if size and size + len(found) + 1 > chunk_ids:
                        yield chunk()
                        number, size = number + 1, 0
                        ids.clear()
                        docs.clear()
                    ids.append(np.append(found, np.uint32(end_id)))
                    docs.append(names[k])
                    size += len(found) + 1
            if docs:
                yield chunk()

        in_python(rows, chunks, _CHUNK).write.option("compression", "none").parquet(f"{self.path}/chunks")
        self._index().write.parquet(f"{self.path}/index")

    def _chunks(self) -> DataFrame:
        return self.spark.read.schema(_CHUNK).parquet(f"{self.path}/chunks")

    def _index(self) -> DataFrame:
        """First id of each chunk: partitions are summed first, one row each, in id order."""
        sizes = self._chunks().select(
            "part", "number", "n_ids", "least_id", F.octet_length("data").alias("n_bytes")
        )
        parts = sizes.groupBy("part").agg(
            F.sum("n_ids").alias("_in_part"), F.min("least_id").alias("_least"),
            F.max(F.col("least_id").isNull()).alias("_null"),
        )
        in_order = Window.orderBy(F.col("_null").desc(), "_least", "part")
        parts = parts.select(
            F.col("part").alias("_part"),
            (F.sum("_in_part").over(in_order) - F.col("_in_part")).alias("_before"),
        )
        within = Window.partitionBy("part").orderBy("number")
        first = F.col("_before") + F.sum("n_ids").over(within) - F.col("n_ids")
        joined = sizes.join(parts, F.col("part") == F.col("_part"))
        return joined.withColumn("first", first).select("part", "number", "first", "n_ids", "n_bytes")

    def index(self) -> DataFrame:
        schema = "part bigint, number bigint, first bigint, n_ids bigint, n_bytes int"
        return self.spark.read.schema(schema).parquet(f"{self.path}/index")

    def read(self) -> DataFrame:
        """Per document from the files: ``doc_id, start, n_tokens, ids_crc32``."""
        schema = pa.schema(
            [("part", pa.int64()), ("number", pa.int64()), ("doc_id", pa.int64()), ("at", pa.int64()),
             ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
        )

        def documents_of(batches):
            for batch in batches:
                for k in range(batch.num_rows):
                    ids = unpack(batch.column(4)[k].as_py())
                    counts = batch.column(3)[k].as_py()
                    ends = np.cumsum(counts)
                    sums = [zlib.crc32(ids[e - n : e].tobytes()) for e, n in zip(ends, counts)]
                    n = len(counts)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([batch.column(0)[k].as_py()] * n, pa.int64()),
                         pa.array([batch.column(1)[k].as_py()] * n, pa.int64()),
                         batch.column(2)[k].values.cast(pa.int64()), pa.array(ends - counts, pa.int64()),
                         pa.array(counts, pa.int64()), pa.array(sums, pa.int64())],
                        schema=schema,
                    )

        rows = self._chunks().select("part", "number", "doc_ids", "n_tokens", "data")
        found = in_python(
            rows, documents_of,
            "part bigint, number bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint",
        )
        index = self.index().select(
            F.col("part").alias("_part"), F.col("number").alias("_number"), "first"
        )
        same = (F.col("part") == F.col("_part")) & (F.col("number") == F.col("_number"))
        return found.join(index, same).select(
            "doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"
        )


def op8_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = TokenFiles(spark, new_path(spark, "token-files"))
    files.write(documents(spark, sf_dir), default_vocabulary())
    return files.read()


QUERIES = {"op8_token_planes": op8_token_planes}
ORACLE: dict[str, str] = {}
