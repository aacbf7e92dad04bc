"""BPE encoding and decoding by tree concatenation.

A text that is longer than a leaf is halved, and the halves again; leaves are encoded
independently, many at once, and the ids of two halves are joined: a window around the cut is
encoded again and grows until its first and its last token agree with the tokens the halves
already have there.  A window begins and ends where the result outside cannot depend on
the inside: before white space that follows other text, or, within an unbroken run of
letters, at any token boundary (a BPE sequence is right if every two neighbours are, and
agreement makes them neighbours in a right sequence).  When nothing else agrees, the window
is the whole of both halves.

Texts above ``SPREAD_CHARS`` are cut into parts that different tasks encode; one task joins
the parts of a text.

Defined results: null counts as empty and has no ids; repeated rows are encoded each; ids of
special tokens come out for their text, as the library does by default.
"""

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.bpe import Encoder, default_vocabulary
from appcensus.llm.tables import documents, in_python

LEAF_CHARS = 4_096
SPREAD_CHARS = 1 << 16
FIRST_WINDOW = 32

_EDGE = re.compile(r"[^\s᠎​﻿]\s")
# Letters by any version of the character tables.
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ʯぁ-ゖァ-ヺ一-龥가-힣]*")


def _tail(text: str, tokens: np.ndarray, sizes: np.ndarray, most: int) -> int:
    """Characters at the end of ``text`` that are whole tokens, as many as fit in ``most``."""
    raw = text[len(text) - most :].encode()
    upto, best = 0, 0
    for token in tokens[::-1]:
        upto += int(sizes[token])
        if upto > len(raw):
            break
        if raw[len(raw) - upto] & 0xC0 != 0x80:
            best = upto
    return len(raw[len(raw) - best :].decode())


def _head(text: str, tokens: np.ndarray, sizes: np.ndarray, most: int) -> int:
    raw = text[:most].encode()
    upto, best = 0, 0
    for token in tokens:
        upto += int(sizes[token])
        if upto > len(raw):
            break
        if upto == len(raw) or raw[upto] & 0xC0 != 0x80:
            best = upto
    return len(raw[:best].decode())


def _covering(tokens: np.ndarray, sizes: np.ndarray, length: int) -> int | None:
    """How many first tokens have ``length`` bytes together."""
    upto = 0
    for count, token in enumerate(tokens):
        if upto >= length:
            return count if upto == length else None
        upto += int(sizes[token])
    return len(tokens) if upto == length else None


def join(encoder: Encoder, left: str, left_ids: np.ndarray, right: str, right_ids: np.ndarray) -> np.ndarray:
    """The ids of ``left + right`` from those of both."""
    if not left or not right:
        return np.concatenate([left_ids, right_ids])
    sizes, window = encoder.token_bytes, FIRST_WINDOW
    while True:
        before, after = left[-window:], right[:window]
        whole_left, whole_right = window >= len(left), window >= len(right)
        unbroken = _LETTERS.fullmatch(before) and _LETTERS.fullmatch(after)
        back = forth = None
        if whole_left:
            back = len(left)
        elif edge := _EDGE.search(before):
            back = len(before) - edge.start() - 1
        elif unbroken:
            back = _tail(left, left_ids, sizes, window - 1) or None
        if whole_right:
            forth = len(right)
        elif edges := list(_EDGE.finditer(after)):
            forth = edges[-1].start() + 1
        elif unbroken:
            forth = _head(right, right_ids, sizes, window - 1) or None
        if back and forth:
            old_left = _covering(left_ids[::-1], sizes, len(left[len(left) - back :].encode()))
            old_right = _covering(right_ids, sizes, len(right[:forth].encode()))
            if old_left is not None and old_right is not None:
                new = encoder.whole(left[len(left) - back :] + right[:forth])
                agrees = (whole_left or new[0] == left_ids[len(left_ids) - old_left]) and (
                    whole_right or new[-1] == right_ids[old_right - 1]
                )
                if agrees:
                    kept = left_ids[: len(left_ids) - old_left]
                    return np.concatenate([kept, new, right_ids[old_right:]])
        window *= 2


def halves(length: int, leaf: int = LEAF_CHARS) -> list[int]:
    """The cuts of a text into leaves, 0 and ``length`` included."""
    if length <= leaf:
        return [0, length]
    middle = length // 2
    return halves(middle, leaf)[:-1] + [middle + c for c in halves(length - middle, leaf)]


def concatenated(encoder: Encoder, parts: list[str], ids: list[np.ndarray]) -> np.ndarray:
    """Join neighbouring parts pairwise, level by level."""
    while len(parts) > 1:
        joined = [
            join(encoder, parts[k], ids[k], parts[k + 1], ids[k + 1])
            for k in range(0, len(parts) - 1, 2)
        ]
        texts = [parts[k] + parts[k + 1] for k in range(0, len(parts) - 1, 2)]
        if len(parts) % 2:
            joined.append(ids[-1])
            texts.append(parts[-1])
        parts, ids = texts, joined
    return ids[0]


def encode_texts(encoder: Encoder, texts: list[str], leaf: int = LEAF_CHARS) -> Iterator[np.ndarray]:
    """The ids of each text; the leaves of all texts are encoded together."""
    cuts = [halves(len(text), leaf) for text in texts]
    leaves = [text[a:b] for text, c in zip(texts, cuts) for a, b in zip(c, c[1:])]
    ids = encoder.encode(pa.array(leaves, pa.large_string()))
    at = 0
    for text, c in zip(texts, cuts):
        count = len(c) - 1
        yield concatenated(encoder, leaves[at : at + count], ids[at : at + count])
        at += count


_RESULT = "_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_RESULT_ARROW = pa.schema(
    [("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
     ("decoded_sha256", pa.string())]
)


def _digests(encoder: Encoder, ids: np.ndarray) -> tuple[int, str, str]:
    numbers = ids.tolist()
    decoded = encoder.tokenizer.decode(numbers, skip_special_tokens=False)
    text = ",".join([encoder.text_of_id[i] for i in numbers])
    return (
        len(numbers),
        hashlib.sha256(text.encode()).hexdigest(),
        hashlib.sha256(decoded.encode()).hexdigest(),
    )


def _slices(texts: list[str], limit: int = 1 << 22) -> Iterator[tuple[int, int]]:
    start = size = 0
    for k, text in enumerate(texts):
        if size and size + len(text) > limit:
            yield start, k
            start, size = k, 0
        size += len(text)
    yield start, len(texts)


def round_trip(
    df: DataFrame, vocabulary: str, id_column: str = "doc_id", text: str = "text",
    spread_chars: int = SPREAD_CHARS, leaf_chars: int = LEAF_CHARS,
) -> DataFrame:
    """Encode and decode every text: id, ``n_tokens``, ``ids_sha256``, ``decoded_sha256``."""
    rows = df.select(
        df[id_column].cast("bigint").alias("_id"),
        F.coalesce(df[text].cast("string"), F.lit("")).alias("_text"),
    )

    def encode_rows(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for start, stop in _slices(texts):
                found = encode_texts(encoder, texts[start:stop], leaf_chars)
                results = [_digests(encoder, ids) for ids in found]
                columns = list(zip(*results)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), *map(pa.array, columns)]
                    if results else [pa.array([], f.type) for f in _RESULT_ARROW],
                    schema=_RESULT_ARROW,
                )

    short = in_python(rows.filter(F.length("_text") <= spread_chars), encode_rows, _RESULT)

    # Long texts: their parts become rows that any task may encode.  Equal rows are one with a count.
    long = rows.filter(F.length("_text") > spread_chars).withColumn("_th", F.xxhash64("_text"))
    long = long.groupBy("_id", "_th").agg(F.first("_text").alias("_text"), F.count(F.lit(1)).alias("_copies"))
    cut_schema = pa.schema(
        [("_id", pa.int64()), ("_th", pa.int64()), ("_copies", pa.int64()), ("_part", pa.int64()),
         ("_text", pa.string())]
    )

    def cut(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                key = [batch.column(i)[k].as_py() for i in (0, 1, 3)]
                whole = batch.column(2)[k].as_py()
                for part, start in enumerate(range(0, len(whole), spread_chars)):
                    values = (*key, part, whole[start : start + spread_chars])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([v], f.type) for v, f in zip(values, cut_schema)], schema=cut_schema
                    )

    parts = in_python(long, cut, "_id bigint, _th bigint, _copies bigint, _part bigint, _text string")
    parts = parts.repartition("_id", "_th", "_part")
    part_schema = pa.schema(
        [("_id", pa.int64()), ("_th", pa.int64()), ("_copies", pa.int64()), ("_part", pa.int64()),
         ("_text", pa.string()), ("_ids", pa.binary())]
    )

    def encode_parts(batches):
        encoder = Encoder.of(vocabulary)
        for batch in batches:
            texts = batch.column(4).to_pylist()
            for k, ids in enumerate(encode_texts(encoder, texts, leaf_chars)):
                yield pa.RecordBatch.from_arrays(
                    [*[batch.column(i).slice(k, 1) for i in range(4)], pa.array([texts[k]]),
                     pa.array([ids.tobytes()], pa.binary())],
                    schema=part_schema,
                )

    coded = in_python(
        parts, encode_parts,
        "_id bigint, _th bigint, _copies bigint, _part bigint, _text string, _ids binary",
    )
    coded = coded.repartition("_id", "_th").sortWithinPartitions("_id", "_th", "_part")

    def join_parts(batches):
        encoder = Encoder.of(vocabulary)
        key, texts, ids, copies = None, [], [], 0

        def done():
            result = _digests(encoder, concatenated(encoder, texts, ids))
            for _ in range(copies):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([v], f.type) for v, f in zip((key[0], *result), _RESULT_ARROW)],
                    schema=_RESULT_ARROW,
                )

        for batch in batches:
            numbers = [batch.column(i).to_pylist() for i in range(3)]
            for k, (doc, th, n) in enumerate(zip(*numbers)):
                if (doc, th) != key:
                    if texts:
                        yield from done()
                    key, texts, ids, copies = (doc, th), [], [], n
                texts.append(batch.column(4)[k].as_py())
                ids.append(np.frombuffer(batch.column(5)[k].as_py(), np.uint32))
        if texts:
            yield from done()

    joined = in_python(coded, join_parts, _RESULT)
    return short.union(joined).withColumnRenamed("_id", id_column)


def op5_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), default_vocabulary())


QUERIES = {"op5_tree_bpe": op5_tree_bpe}
ORACLE: dict[str, str] = {}
