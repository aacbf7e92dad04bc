"""Secret scans over a trigram inverted index.

Every rule's regular expression is taken apart into a Boolean query over trigrams that any
match must contain.  A block of texts is one segment of the index: for the trigrams that
occur in some query, the segment has the sorted list of texts that contain them (ASCII case
folded).  A rule's candidates are the union, over its alternatives, of the intersected lists;
only candidates are verified with the expression.  Rules without mandatory trigrams scan
every text.  Of each part of an expression it is known what its matches begin with, end with and
are, so that two parts make a trigram only where nothing unknown can stand between them.

Defined results: null and empty texts have no spans; repeated rows are scanned each; spans
of different kinds may overlap; positions are code points.  Other columns are not looked at.
"""

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as sre
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from appcensus.llm.tables import documents, in_python
from appcensus.llm.words import FOLD, blocks, text_bytes

MOST_STRINGS = 256
"""Strings, or alternatives of a query, that are followed; beyond it less is known of a match."""
MOST_COPIES = 8
SMALL_CLASS = 6


@dataclass(frozen=True)
class Rule:
    """``least`` is the least length of ``group`` in a match; shorter matches are dropped."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        found = re.compile(self.pattern, re.ASCII).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]


# Forms of credentials.
BASE = (
    Rule(
        "assign",
        r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        8, 2,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]+", 32),
)
FURTHER = (
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("cloud", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----"),
)
RULES = BASE + FURTHER

Query = frozenset[frozenset[bytes]]
"""Alternatives, each a set of trigrams that must all occur."""
Strings = frozenset[str]


def _trigrams(text: str) -> frozenset[bytes]:
    raw = text.encode()
    return frozenset(raw[k : k + 3] for k in range(len(raw) - 2))


def _characters(item, folded: bool) -> list[str] | None:
    """The characters a one-character item can match, folded, if there are few of them."""
    op, value = item
    if op is sre.LITERAL:
        found = {value}
    elif op is sre.IN:
        found = set()
        for kind, part in value:
            if kind is sre.LITERAL:
                found.add(part)
            elif kind is sre.RANGE:
                if part[1] - part[0] > SMALL_CLASS:
                    return None
                found.update(range(part[0], part[1] + 1))
            else:
                return None
    else:
        return None
    letters = {chr(c).lower() if c < 128 else chr(c) for c in found}
    return sorted(letters) if len(letters) <= SMALL_CLASS else None


_ANY: Query = frozenset([frozenset()])
"""The query that every text meets."""


def _shortest(query: Query) -> Query:
    """Without alternatives that ask for more than another one does."""
    return frozenset(a for a in query if not any(b < a for b in query))


def _both(one: Query, other: Query) -> Query:
    """A query that both imply; the weaker one is left out where it would get too long."""
    if len(one) * len(other) > MOST_STRINGS:
        return min(one, other, key=len) if _ANY not in (one, other) else max(one, other, key=len)
    return _shortest(frozenset(a | b for a in one for b in other))


def _either(queries) -> Query:
    found = _shortest(frozenset().union(*queries))
    return found if len(found) <= MOST_STRINGS else _ANY


def _held(strings: Strings) -> Query:
    """The query that a text meets when it holds one of the strings."""
    if any(len(s.encode()) < 3 for s in strings):
        return _ANY
    return _either([frozenset([_trigrams(s)]) for s in strings])


def _joined(one: Strings, other: Strings) -> Strings | None:
    if len(one) * len(other) > MOST_STRINGS:
        return None
    return frozenset(a + b for a in one for b in other)


@dataclass(frozen=True)
class _Part:
    """What is known of every text that a part of an expression matches.

    It begins with one of ``starts`` and ends with one of ``ends``, which meet nothing unknown on
    that side, and it meets ``query``.  Where the part is known whole, it is one of ``exact``.
    """

    exact: Strings | None = None
    starts: Strings = frozenset([""])
    ends: Strings = frozenset([""])
    query: Query = _ANY

    @staticmethod
    def of(strings: Strings) -> "_Part":
        return _Part(strings, strings, strings) if len(strings) <= MOST_STRINGS else _Part()

    def all(self) -> Query:
        if self.exact is not None:
            return _held(self.exact)
        return _both(self.query, _both(_held(self.starts), _held(self.ends)))

    def then(self, other: "_Part") -> "_Part":
        if self.exact is not None and other.exact is not None:
            if (both := _joined(self.exact, other.exact)) is not None:
                return _Part.of(both)
        query = _both(self.all(), other.all())
        if (border := _joined(self.ends, other.starts)) is not None:
            query = _both(query, _held(border))
        starts, ends = self.starts, other.ends
        if self.exact is not None:
            starts = _joined(self.exact, other.starts) or self.exact
        if other.exact is not None:
            ends = _joined(self.ends, other.exact) or other.exact
        return _Part(None, starts, ends, query)

    @staticmethod
    def one_of(parts: list["_Part"]) -> "_Part":
        if all(p.exact is not None for p in parts):
            return _Part.of(frozenset().union(*(p.exact for p in parts)))
        starts, ends = (frozenset().union(*(getattr(p, n) for p in parts)) for n in ("starts", "ends"))
        unknown = frozenset([""])
        return _Part(
            None, starts if len(starts) <= MOST_STRINGS else unknown,
            ends if len(ends) <= MOST_STRINGS else unknown, _either([p.all() for p in parts]),
        )

    def times(self, low: int, high: int) -> "_Part":
        if high == 1 and low == 0:
            return _Part.one_of([self, _EMPTY])
        if low == 0:
            return _EMPTY if high == 0 else _Part()
        copies = self
        for _ in range(min(low, MOST_COPIES) - 1):
            copies = copies.then(self)
        if low == high <= MOST_COPIES:
            return copies
        # More copies may stand between those it begins with and those it ends with.
        return _Part(None, copies.starts, copies.ends, copies.all())


_EMPTY = _Part.of(frozenset([""]))


def _known(items) -> _Part:
    """What is known of a parsed expression."""
    whole = _EMPTY
    for op, value in items:
        if (found := _characters((op, value), True)) is not None:
            part = _Part.of(frozenset(found))
        elif op is sre.SUBPATTERN:
            part = _known(value[3])
        elif op is sre.ATOMIC_GROUP:
            part = _known(value)
        elif op is sre.BRANCH:
            part = _Part.one_of([_known(choice) for choice in value[1]])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
            part = _known(value[2]).times(int(value[0]), int(value[1]))
        elif op in (sre.AT, sre.ASSERT, sre.ASSERT_NOT):
            part = _EMPTY  # matches no character
        else:
            part = _Part()
        whole = whole.then(part)
    return whole


def trigram_query(pattern: str) -> Query | None:
    """The trigrams a match of ``pattern`` must contain, or None if there are none."""
    query = _known(parser.parse(pattern, re.ASCII)).all()
    return None if frozenset() in query else query


class Segment:
    """Lists of the texts that contain each of the trigrams of interest."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray):
        self.rows = len(offsets) - 1
        self.lists: dict[int, np.ndarray] = {}
        if len(data) < 3:
            return
        low = FOLD[data].astype(np.uint32)
        codes = (low[:-2] << np.uint32(16)) | (low[1:-1] << np.uint32(8)) | low[2:]
        at = np.flatnonzero(wanted[codes])
        row = np.searchsorted(offsets, at, side="right") - 1
        inside = at + 3 <= offsets[row + 1]
        pairs = np.unique((codes[at][inside].astype(np.int64) << 32) | row[inside])
        codes, rows = pairs >> 32, pairs & 0xFFFFFFFF
        heads = np.flatnonzero(np.append(True, codes[1:] != codes[:-1])) if len(codes) else []
        for start, stop in zip(heads, [*heads[1:], len(codes)]):
            self.lists[int(codes[start])] = rows[start:stop]

    def candidates(self, query: Query | None) -> np.ndarray:
        if query is None:
            return np.arange(self.rows)
        none, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for trigrams in query:
            lists = sorted((self.lists.get(int.from_bytes(t), none) for t in trigrams), key=len)
            rows = lists[0]
            for other in lists[1:]:
                rows = np.intersect1d(rows, other, assume_unique=True)
            found = np.union1d(found, rows)
        return found


def wanted_trigrams(queries: list[Query | None]) -> np.ndarray:
    wanted = np.zeros(1 << 24, bool)
    for query in queries:
        for trigrams in query or ():
            wanted[[int.from_bytes(t) for t in trigrams]] = True
    return wanted


def _text_of(spans: list[tuple[int, int, int]], rules) -> str:
    """``spans``: (start, kind number, end)."""
    return ",".join(f"{rules[k].kind}:{start}:{end}" for start, k, end in sorted(spans))


def scan_batch(column: pa.Array, rules, queries, wanted) -> Iterator[list[tuple[int, int, int]]]:
    """The spans of each text."""
    data, offsets = text_bytes(column)
    for row, stop in blocks(offsets):
        part = offsets[row : stop + 1]
        segment = Segment(data[part[0] : part[-1]], part - part[0], wanted)
        texts = column.slice(row, stop - row).to_pylist()
        spans: list[list] = [[] for _ in texts]
        for number, (rule, query) in enumerate(zip(rules, queries)):
            for k in segment.candidates(query).tolist():
                spans[k].extend((a, number, b) for a, b in rule.spans(texts[k] or ""))
        yield from spans


def scan(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, n_base: int = len(BASE),
    id_column: str = "doc_id", text: str = "text",
) -> DataFrame:
    """Per row: id, one count per base kind, ``base_sha256``, ``spans``."""
    kinds = [rule.kind for rule in rules[:n_base]]
    schema = pa.schema(
        [(id_column, pa.int64()), *[(f"n_{kind}", pa.int64()) for kind in kinds],
         ("base_sha256", pa.string()), ("spans", pa.string())]
    )

    def scanned(batches):
        queries = [trigram_query(rule.pattern) for rule in rules]
        wanted = wanted_trigrams(queries)
        for batch in batches:
            columns: list[list] = [[] for _ in range(n_base + 2)]
            for spans in scan_batch(batch.column(1), rules, queries, wanted):
                base = [s for s in spans if s[1] < n_base]
                for number in range(n_base):
                    columns[number].append(sum(s[1] == number for s in base))
                columns[-2].append(hashlib.sha256(_text_of(base, rules).encode()).hexdigest())
                columns[-1].append(_text_of(spans, rules))
            arrays = [pa.array(c, f.type) for c, f in zip(columns, list(schema)[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays], schema=schema)

    counts = "".join(f", n_{kind} bigint" for kind in kinds)
    rows = df.select(df[id_column].cast("bigint"), df[text].cast("string"))
    return in_python(rows, scanned, f"{id_column} bigint{counts}, base_sha256 string, spans string")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(documents(spark, sf_dir))


QUERIES = {"op3_secret_scan": op3_secret_scan}
ORACLE: dict[str, str] = {}
