"""Words of Arrow text columns as numpy arrays, many texts at once.

A word is a run of bytes other than blank and 0x09-0x0D; these bytes never occur inside a
character of UTF-8, so bytes do.  Work is done in blocks of bounded size; a text above the
block size is cut at white space, and only its hashes (eight bytes a word) are put together.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20

SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True

FOLD = np.arange(256, dtype=np.uint8)
FOLD[ord("A") : ord("Z") + 1] += 32

_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column and the offset of each text; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges that hold at most ``limit`` bytes, or one row."""
    row, rows = 0, len(offsets) - 1
    while row < rows:
        stop = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        stop = min(max(stop, row + 1), rows)
        yield row, stop
        row = stop


def _cut(data: np.ndarray, offsets: np.ndarray, limit: int) -> Iterator[tuple[int, int, int]]:
    """(row, start, stop) parts of texts, cut at white space where a text is too long."""
    for row in range(len(offsets) - 1):
        start, end = int(offsets[row]), int(offsets[row + 1])
        while end - start > limit:
            stop = start + limit
            while stop < end and not SPACE[data[stop]]:
                ahead = np.flatnonzero(SPACE[data[stop : stop + limit]])
                stop = min(end, stop + (int(ahead[0]) if len(ahead) else limit))
            yield row, start, stop
            start = stop
        yield row, start, end


def _hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    solid = ~SPACE[data]
    first = np.ones(len(data), dtype=bool)
    first[1:] = ~solid[:-1]
    first[offsets[:-1][offsets[:-1] < len(data)]] = True
    first &= solid
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(offsets) - 1, np.int64)
    at = np.flatnonzero(solid)
    heads = np.flatnonzero(first[at])
    sizes = np.diff(np.append(heads, len(at)))
    place = at - np.repeat(starts, sizes)
    values = mixed((data[at].astype(np.uint64) + np.uint64(1)) * _ODD + place.astype(np.uint64))
    hashes = mixed(np.add.reduceat(values, heads))
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return hashes, np.bincount(rows, minlength=len(offsets) - 1)


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, fold: bool = True
) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and the number of words of each text.

    With ``fold``, A-Z count as a-z.
    """
    if fold:
        data = FOLD[data]
    if offsets[-1] <= 2 * BLOCK_BYTES:
        return _hashes(data, offsets)
    hashes, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for row, start, stop in _cut(data, offsets, BLOCK_BYTES):
        part, _ = _hashes(data[start:stop], np.array([0, stop - start]))
        hashes.append(part)
        counts[row] += len(part)
    return np.concatenate(hashes), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text.

    A text with fewer than ``width`` words has its whole sequence as its only shingle, one
    without words has none.
    """
    total = len(hashes)
    salts = mixed((np.arange(width, dtype=np.uint64) + np.uint64(1)) * _ODD) | np.uint64(1)
    rolled = np.zeros(max(total - width + 1, 0), np.uint64)
    for k in range(width):
        rolled += hashes[k : k + len(rolled)] * salts[k]
    rolled = mixed(rolled)
    out, start = [], 0
    for count in counts.tolist():
        if count >= width:
            out.append(np.unique(rolled[start : start + count - width + 1]))
        elif count:
            whole = (hashes[start : start + count] * salts[:count]).sum(dtype=np.uint64)
            out.append(mixed(np.array([whole + np.uint64(count)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
        start += count
    return out


def shingle_sets(column: pa.Array, width: int) -> Iterator[np.ndarray]:
    """``shingles`` of every text of an Arrow column, in bounded blocks."""
    data, offsets = text_bytes(column)
    for row, stop in blocks(offsets):
        part = offsets[row : stop + 1]
        yield from shingles(*word_hashes(data[part[0] : part[-1]], part - part[0]), width)
