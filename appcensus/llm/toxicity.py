"""Toxicity: Levenshtein automata intersected with a lexicon trie.

The lexicon is learned from a bounded sample of labelled documents: word stems that occur in
toxic ones and hardly elsewhere.  Its trie and the automaton of all words within a number of
edits of a stem are walked together: a state is the set of (trie node, edits) that a prefix of
the word can have reached, states are numbered as they are met, and most words leave the
automaton after two or three letters.  A word matches a stem if its beginning does, so forms
with endings are found.

Every match weighs what its stem (or its misspelled form) weighs in the sample, times a factor
from the words around it: quotation marks and verbs of reporting around the match make it
lighter, words that address someone make it heavier.  A document's score comes from the sum.

Defined results: null and empty texts match nothing and get the score of no match; repeated
rows get equal scores; rows with a null id are scored and not held out; without labels the
lexicon is ``SEED_TERMS``.  Other columns of the input are not looked at.
"""

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.quality_model import fold_of, labelled_sample
from appcensus.llm.tables import documents, in_python
from appcensus.llm.words import blocks, text_bytes

SAMPLE_ROWS = 3_000
"""Labelled documents of each class the lexicon is learned from, at most."""
LEAST_DOCS = 4
"""A stem occurs in at least so many toxic documents of the sample (or one in a hundred)."""
LEAST_RATIO = 20.0
STEM = (4, 9)
LONGEST_ENDING = 2
WINDOW = 6
QUOTED, ADDRESSED = 0.3, 1.25

SEED_TERMS = ("idiot", "moron", "stupid", "worthless", "pathetic", "disgusting")

# Fixed values.
TRIMMED = ".,;:!?\"'`´()[]{}<>«»“”„‚‘’‹›…"
QUOTES = set("\"«»“”„‹›「」")
REPORTING = frozenset(
    "said says called calls wrote quoted quote term word phrase insult slur cited "
    "sagte nannte schrieb zitat wort dit appelle mot cite dijo escribió llamó palabra".split()
)
ADDRESSING = frozenset("you your you're u du dich dein ihr euch tu toi ton vous tú te usted vosotros".split())


_WORD = re.compile(r"[^\W\d_]+")


def edits_allowed(stem: str) -> int:
    return 0 if len(stem) < 4 else 1 if len(stem) < 9 else 2


def is_form(word: str, stem: str) -> bool:
    """May ``word`` be a misspelled form of ``stem``, going by its length and first letter?

    Nearly every short word is an edit away from some other word, so a short stem keeps both.
    """
    if len(stem) < 5:
        return len(word) == len(stem) and word[0] == stem[0]
    return len(word) <= len(stem) + LONGEST_ENDING


class Automaton:
    """The words whose beginning is within the allowed edits of a stem."""

    MOST_STATES = 100_000

    def __init__(self, stems: list[str]):
        self.stems = stems
        self.limits = [edits_allowed(s) for s in stems]
        self.children: list[dict[str, int]] = [{}]
        self.ends: dict[int, int] = {}
        for number, stem in enumerate(stems):
            node = 0
            for letter in stem:
                if letter not in self.children[node]:
                    self.children[node][letter] = len(self.children)
                    self.children.append({})
                node = self.children[node][letter]
            self.ends[node] = number
        # The most edits any stem below a node allows: nothing beyond it is followed.
        self.budget = [0] * len(self.children)
        for node in reversed(range(len(self.children))):
            own = self.limits[self.ends[node]] if node in self.ends else -1
            self.budget[node] = max([own, *(self.budget[c] for c in self.children[node].values())])
        self._forget()

    def _forget(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.sets: list[tuple] = []
        self.steps: list[dict[str, int]] = []
        self.accepts: list[tuple] = []
        self.start = self._number({0: 0})

    def _number(self, reached: dict[int, int]) -> int:
        """The state of a set of (node, fewest edits), closed under skipped stem letters."""
        todo = list(reached.items())
        while todo:
            node, edits = todo.pop()
            if reached.get(node) != edits:
                continue
            for child in self.children[node].values():
                if edits + 1 <= self.budget[child] and edits + 1 < reached.get(child, 99):
                    reached[child] = edits + 1
                    todo.append((child, edits + 1))
        key = tuple(sorted(reached.items()))
        if key not in self.numbers:
            self.numbers[key] = len(self.sets)
            self.sets.append(key)
            self.steps.append({})
            self.accepts.append(
                tuple(
                    (self.ends[n], e) for n, e in key if n in self.ends and e <= self.limits[self.ends[n]]
                )
            )
        return self.numbers[key]

    def _step(self, state: int, letter: str) -> int:
        """The state after one more letter, -1 when no stem is left."""
        reached: dict[int, int] = {}

        def reach(node: int, edits: int) -> None:
            if edits <= self.budget[node] and edits < reached.get(node, 99):
                reached[node] = edits

        for node, edits in self.sets[state]:
            reach(node, edits + 1)
            for other, child in self.children[node].items():
                reach(child, edits + (other != letter))
        found = self._number(reached) if reached else -1
        self.steps[state][letter] = found
        return found

    def match(self, word: str) -> tuple[int, int] | None:
        """The stem a word begins with and the edits it took; fewest edits, then longest."""
        if len(self.sets) > self.MOST_STATES:
            self._forget()
        state, best = self.start, None
        for letter in word:
            following = self.steps[state].get(letter)
            state = self._step(state, letter) if following is None else following
            if state < 0:
                break
            for number, edits in self.accepts[state]:
                if edits and not is_form(word, self.stems[number]):
                    continue
                rank = (edits, -len(self.stems[number]), number)
                if best is None or rank < best:
                    best = rank
        if best is None:
            return None
        return best[2], best[0]


@dataclass
class Lexicon:
    stems: list[str]
    weights: np.ndarray
    """(stems, 2): weight of the exact and of the misspelled form."""
    middle: float = 2.0
    slope: float = 2.0
    _automaton: list = field(default_factory=list)

    @property
    def automaton(self) -> Automaton:
        if not self._automaton:
            self._automaton.append(Automaton(self.stems))
        return self._automaton[0]

    def __getstate__(self):
        return {**self.__dict__, "_automaton": []}

    def score(self, total: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (total - self.middle), -30, 30)))


def _pieces(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """White-space pieces in lower case of all texts, and the first one of each text."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts))
    offsets = split.offsets.to_numpy()
    return split.flatten(), offsets - offsets[0]


def _factor(pieces: list[str], at: int) -> float:
    """From the pieces around the match: lighter if quoted, heavier if it addresses someone."""
    marks = [k for k, piece in enumerate(pieces) for c in piece if c in QUOTES]
    own = pieces[at]
    inside = any(k < at for k in marks) and any(k > at for k in marks)
    inside = inside or (own[0] in QUOTES and any(k >= at for k in marks[1:]))
    inside = inside or (own[-1] in QUOTES and any(k <= at for k in marks[:-1]))
    words = {piece.strip(TRIMMED) for piece in pieces}
    if inside or words & REPORTING:
        return QUOTED
    return ADDRESSED if words & ADDRESSING else 1.0


def _match(automaton: Automaton, piece: str) -> tuple[int, int] | None:
    """The stem that a piece or a run of letters in it begins with; fewest edits, then longest."""
    found = [automaton.match(piece)]
    if not piece.isalpha():
        found += map(automaton.match, _WORD.findall(piece))
    found = [f for f in found if f is not None]
    return min(found, key=lambda f: (f[1], -len(automaton.stems[f[0]]), f[0])) if found else None


def matches(column: pa.Array, lexicon: Lexicon) -> Iterator[list[tuple[int, int, float, str]]]:
    """The matches of each text: stem, edits, context factor, piece before the match."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets = text_bytes(column)
    automaton = lexicon.automaton
    for row, stop in blocks(offsets, 4 << 20):
        pieces, first = _pieces(column.slice(row, stop - row))
        coded = pc.utf8_trim(pieces, TRIMMED).dictionary_encode()
        found = [_match(automaton, piece) for piece in coded.dictionary.to_pylist()]
        hit = np.array([f is not None for f in found], bool)
        index = coded.indices.to_numpy()
        out: list[list] = [[] for _ in range(stop - row)]
        places = np.flatnonzero(hit[index]) if len(index) else np.zeros(0, int)
        for at, text in zip(places, np.searchsorted(first, places, side="right") - 1):
            low, high = max(first[text], at - WINDOW), min(first[text + 1], at + WINDOW + 1)
            around = pieces.slice(low, high - low).to_pylist()
            before = around[at - low - 1] if at > low else ""
            out[text].append((*found[index[at]], _factor(around, at - low), before))
        yield from out


def totals(column: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """Sum of the weights of each text's matches."""
    return np.array(
        [
            sum(lexicon.weights[stem, min(edits, 1)] * factor for stem, edits, factor, _ in found)
            for found in matches(column, lexicon)
        ]
    )


def _candidate_counts(rows: DataFrame) -> DataFrame:
    """Per stem the number of toxic and of other documents with a word that begins with it."""

    def count(batches):
        for batch in batches:
            counts = (Counter(), Counter())
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                words = set(_WORD.findall((text or "").lower()))
                stems = {w[:k] for w in words for k in range(STEM[0], min(len(w), STEM[1]) + 1)}
                counts[label > 0.5].update(stems)
            clean, toxic = counts
            stems = sorted(toxic)
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array([toxic[s] for s in stems], pa.int64()),
                 pa.array([0] * len(stems), pa.int64())],
                names=["stem", "toxic", "clean"],
            )
            stems = sorted(clean)
            yield pa.RecordBatch.from_arrays(
                [pa.array(stems, pa.string()), pa.array([0] * len(stems), pa.int64()),
                 pa.array([clean[s] for s in stems], pa.int64())],
                names=["stem", "toxic", "clean"],
            )

    counted = in_python(rows, count, "stem string, toxic bigint, clean bigint")
    return counted.groupBy("stem").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def choose_stems(counts: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """One stem for each family of nested candidates: the longest nearly as frequent as the
    shortest."""
    by_stem = {stem: (toxic, clean) for stem, toxic, clean in counts}
    families: dict[str, list[str]] = {}
    for stem in sorted(by_stem, key=lambda s: (len(s), s)):
        root = next((stem[:k] for k in range(1, len(stem)) if stem[:k] in families), stem)
        families.setdefault(root, []).append(stem)
    chosen = []
    for root, family in sorted(families.items()):
        near = [s for s in family if by_stem[s][0] >= 0.9 * by_stem[root][0]]
        best = max(near, key=lambda s: (len(s), s))
        chosen.append((best, *by_stem[best]))
    return chosen


def train(df: DataFrame, labels: DataFrame, keep: Column) -> Lexicon:
    """The lexicon and the scale of scores, from labelled rows for which ``keep`` holds."""
    sample = None
    for value in (0, 1):
        part = labelled_sample(labels, "toxic", keep & (F.col("toxic") == value), SAMPLE_ROWS)
        sample = part if sample is None else sample.union(part)
    rows = df.select(df["doc_id"].alias("_id"), df["text"].cast("string").alias("_text"))
    # The sample's size is bounded, so every executor may have it.
    rows = rows.join(F.broadcast(sample), F.col("_id") == F.col("_of"))
    # One text for each id of the sample, however many rows have this id.
    one = F.min_by(F.struct("_label", "_text"), F.struct(F.xxhash64("_text"), "_text"))
    rows = rows.groupBy("_of").agg(one.alias("_row")).select("_row.*")
    # A copied text counts once, or its rare words would look like stems.
    rows = rows.dropDuplicates(["_label", "_text"])
    sizes = {r[0]: r[1] for r in sample.groupBy("_label").count().collect()}
    n_toxic, n_clean = sizes.get(1.0, 0), sizes.get(0.0, 0)
    if not n_toxic or not n_clean:
        return Lexicon(list(SEED_TERMS), np.tile([3.0, 1.5], (len(SEED_TERMS), 1)))

    least = max(LEAST_DOCS, n_toxic // 100)
    ratio = (F.col("toxic") / n_toxic) / ((F.col("clean") + 0.5) / n_clean)
    # A toxic document has a bounded number of stems and each counts ``least`` documents, so
    # the candidates are bounded by the sample.
    candidates = _candidate_counts(rows).filter((F.col("toxic") >= least) & (ratio >= LEAST_RATIO))
    chosen = choose_stems([tuple(r) for r in candidates.collect()])
    if not chosen:
        chosen = [(term, 1, 0) for term in SEED_TERMS]
    stems = [stem for stem, _, _ in chosen]

    def found(batches):
        lexicon = Lexicon(stems, np.zeros((len(stems), 2)))
        for batch in batches:
            columns = ([], [], [], [])
            labels = batch.column(0).to_pylist()
            for text, hits in enumerate(matches(batch.column(1), lexicon)):
                for stem, form, before in {(s, min(e, 1), b) for s, e, _, b in hits}:
                    for values, value in zip(columns, (labels[text], stem, form, before)):
                        values.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(columns, (pa.float64(), pa.int64(), pa.int64(), pa.string()))],
                names=["label", "stem", "form", "before"],
            )

    # What counts are different pieces before a match: near copies of one text have the same.
    seen = in_python(rows, found, "label double, stem bigint, form bigint, before string")
    by_form = {
        (r["stem"], r["form"], r["label"] > 0.5): r["n"]
        for r in seen.groupBy("stem", "form", "label").agg(F.countDistinct("before").alias("n")).collect()
    }
    kept = [k for k in range(len(stems)) if by_form.get((k, 0, True), 0) >= least]
    by_form = {(kept.index(s), f, t): n for (s, f, t), n in by_form.items() if s in kept}
    stems = [stems[k] for k in kept] or list(SEED_TERMS)
    weights = np.zeros((len(stems), 2))
    for stem in range(len(stems)):
        for form in (0, 1):
            toxic, clean = (by_form.get((stem, form, t), 0) for t in (True, False))
            odds = np.log((toxic + 0.1) / (clean + 0.5) * n_clean / n_toxic)
            if form and clean == 0 and toxic < LEAST_DOCS:
                odds = 0.6 * weights[stem, 0]  # too rare to tell: a share of the exact form
            weights[stem, form] = np.clip(odds, 0, 6)
    lexicon = Lexicon(stems, weights)

    def summed(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(totals(batch.column(1), lexicon), pa.float64())],
                names=["label", "total"],
            )

    table = in_python(rows, summed, "label double, total double").toPandas()
    lexicon.middle = _middle(table["total"].to_numpy(), table["label"].to_numpy() > 0.5)
    lexicon.slope = 4 / lexicon.middle
    return lexicon


def _middle(total: np.ndarray, toxic: np.ndarray) -> float:
    """The total that parts the classes best (both count alike); the middle of the best gap."""
    order = np.argsort(total, kind="stable")
    total, toxic = total[order], toxic[order]
    below_clean = np.append(0, np.cumsum(~toxic)) / max((~toxic).sum(), 1)
    below_toxic = np.append(0, np.cumsum(toxic)) / max(toxic.sum(), 1)
    edges = np.concatenate([[0.0], (total[1:] + total[:-1]) / 2, [total[-1] + 1]])
    gain = below_clean - below_toxic
    gain[1:-1][total[1:] == total[:-1]] = -1
    gain[edges <= 0] = -1
    return float(max(edges[gain.argmax()], 0.5))


def classify(df: DataFrame, lexicon: Lexicon, held_out: Column, id_column: str = "doc_id") -> DataFrame:
    schema = pa.schema(
        [("_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("n_matches", pa.int64())]
    )

    def scored(batches):
        for batch in batches:
            found = list(matches(batch.column(2), lexicon))
            total = np.array(
                [sum(lexicon.weights[s, min(e, 1)] * f for s, e, f, _ in hits) for hits in found], float
            )
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(lexicon.score(total)),
                 pa.array([len(hits) for hits in found], pa.int64())],
                schema=schema,
            )

    rows = df.select(
        df[id_column].cast("bigint").alias("_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"),
        df["text"].cast("string").alias("_text"),
    )
    out = in_python(rows, scored, "_id bigint, held_out boolean, score double, n_matches bigint")
    predicted = (F.col("score") >= 0.5).cast("int")
    return out.select(F.col("_id").alias(id_column), "held_out", "score", predicted.alias("predicted"), "n_matches")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    held_out = fold_of(F.col("doc_id"), 5) == 0
    return classify(docs, train(docs, labels, ~held_out), held_out)


QUERIES = {"op7_toxicity": op7_toxicity}
ORACLE: dict[str, str] = {}
