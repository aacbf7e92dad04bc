"""Quality rules: one table of thresholds compiled into a Spark projection.

Everything is a built-in expression over the text, so the rules run inside the scan stage,
without a shuffle and without Python.  Each statistic is a column; each rule compares one
statistic with a bound and holds only for documents of at least ``from_words`` words.

Defined results: a null text counts as empty; a text without words has zero in every
statistic and fails (fewer than ten words).  Rows are judged alone: repeated rows are kept
and judged alike.  Input columns stay in place under their names; a statistic whose name an
input column already bears takes the place of that column in ``quality_report`` only,
``keep_good`` returns the input columns untouched.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from appcensus.llm.tables import documents, quoted, SPACES, WORDS

WINDOW = 5

# Frequent function words of the languages the corpus is written in.
STOP_WORDS = (
    "a and are as at be by for from he in is it of on that the this to was were with "
    "au avec ce dans de des du elle en est et il la le les ou par pas pour que qui sur un une "
    "auf das dem den der die ein eine für ist mit nicht sich und von zu im "
    "como con del el es esta las los no para por se su y una"
).split()


@dataclass(frozen=True)
class Rule:
    """``name`` fails when ``value`` (SQL over the statistics) leaves ``[low, high]``."""

    name: str
    value: str
    low: float | None = None
    high: float | None = None
    from_words: int = 1


RULES = (
    Rule("word_length", "word_chars / n_words", 1.5, 20.0, 10),
    Rule("symbol_ratio", "n_symbols / n_words", None, 0.2, 10),
    Rule("shout_ratio", "n_shouts / n_words", None, 0.2, 10),
    Rule("stop_word_ratio", "n_stop_words / n_words", 0.02, None, 50),
    Rule("dup_line_ratio", "n_dup_lines / n_lines", None, 0.5, 10),
    Rule("bullet_line_ratio", "n_bullet_lines / n_lines", None, 0.9, 50),
)
"""Production thresholds.  The two fixed rules of the base verdict are in ``base_failed``."""

COUNTS = (
    "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_bullet_lines",
    "n_stop_words", "n_shouts", "n_repeat_words",
)


def _with_statistics(df: DataFrame, text: str) -> DataFrame:
    """Add ``COUNTS``.  Steps are separate projections so that no array is built twice."""
    space_only = SPACES.replace("]", "]*")
    df = df.withColumn("_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("_w", F.array_remove(F.split("_text", SPACES + "+"), ""))
    df = df.withColumn(
        "_l",
        F.filter(F.split("_text", "\n"), lambda line: ~line.rlike(f"^{space_only}$")),
    )
    # A window is known by a hash of its words; equal windows have equal hashes.
    df = df.withColumn("_h", F.transform("_w", lambda word: F.xxhash64(word)))
    windows = F.expr(
        f"case when size(_h) < {WINDOW} then cast(array() as array<bigint>) else"
        f" transform(sequence(0, size(_h) - {WINDOW}),"
        f" i -> xxhash64({', '.join(f'_h[i + {k}]' for k in range(WINDOW))})) end"
    )
    df = df.withColumn("_win", windows)
    # Most texts repeat no window: the hash set tells, and only the others are sorted.
    # Sorted by (hash, place), a window is repeated if a neighbour has its hash.  A word is
    # covered if the nearest repeated window at or before it starts under WINDOW words away.
    df = df.withColumn(
        "_sorted",
        F.expr(
            "case when size(array_distinct(_win)) = size(_win)"
            " then cast(array() as array<struct<h: bigint, i: int>>)"
            " else array_sort(transform(_win, (h, i) -> struct(h, i))) end"
        ),
    )
    df = df.withColumn(
        "_starts",
        F.expr(
            "array_sort(transform(filter(_sorted, (x, k) ->"
            " (k > 0 and _sorted[greatest(k - 1, 0)].h = x.h) or"
            " (k < size(_sorted) - 1 and _sorted[least(k + 1, size(_sorted) - 1)].h = x.h)),"
            " x -> x.i))"
        ),
    )
    repeated = F.expr(
        "cast(aggregate(transform(_starts, (p, k) -> case when k = size(_starts) - 1"
        f" then {WINDOW} else least({WINDOW}, _starts[least(k + 1, size(_starts) - 1)] - p) end),"
        " 0, (a, x) -> a + x) as bigint)"
    )
    stop = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))
    long = lambda column: column.cast("bigint")
    # A filter on the statistics must not be pushed below them: it would carry a copy of every
    # step with it, and each copy copies the steps below.  It stops at a column that claims to
    # depend on the row's place.
    repeated = F.when(F.monotonically_increasing_id() >= 0, repeated)
    return df.withColumns(
        {
            "n_words": long(F.size("_w")),
            "word_chars": long(F.length(F.array_join("_w", ""))),
            "n_symbols": long(F.regexp_count("_text", F.lit("[#*$%&|<>]"))),
            "n_lines": long(F.size("_l")),
            "n_dup_lines": long(F.size("_l") - F.size(F.array_distinct("_l"))),
            "n_bullet_lines": long(
                F.size(F.filter("_l", lambda line: line.rlike(f"^{space_only}[-*•]")))
            ),
            "n_stop_words": long(F.expr(f"size(filter(_w, x -> lower(x) in ({stop})))")),
            "n_shouts": long(F.regexp_count("_text", F.lit("!!"))),
            "n_repeat_words": repeated,
        }
    )


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """Names of the rules a document breaks, as one array column."""
    broken = []
    for rule in rules:
        value = F.expr(rule.value)
        outside = F.lit(False)
        if rule.low is not None:
            outside = outside | (value < rule.low)
        if rule.high is not None:
            outside = outside | (value > rule.high)
        applies = F.col("n_words") >= max(rule.from_words, 1)
        broken.append(F.when(applies & outside, F.lit(rule.name)))
    if not broken:
        return F.expr("cast(array() as array<string>)")
    return F.array_compact(F.array(*broken))


BASE_FAILED = "n_words < 10 or 100 * n_repeat_words > 20 * n_words"


def quality_report(
    df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", id_column: str = "doc_id"
) -> DataFrame:
    """Statistics and verdict of every row: id, ``COUNTS``, ``base_failed``, ``broken``, ``kept``."""
    rows = df.select(F.col(id_column).alias("_id"), F.col(text).alias("_raw"))
    stats = _with_statistics(rows, "_raw").select(F.col("_id").alias(id_column), *COUNTS)
    return (
        stats.withColumn("base_failed", F.expr(BASE_FAILED))
        .withColumn("broken", verdict(rules))
        .withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))
    )


def keep_good(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """The rows that pass, with their columns, whatever these are called."""
    row = F.struct(*[df[quoted(c)] for c in df.columns])
    packed = df.select(row.alias("_row"), df[text].alias("_raw"))
    judged = _with_statistics(packed, "_raw").filter(
        ~F.expr(BASE_FAILED) & (F.size(verdict(rules)) == 0)
    )
    return judged.select("_row.*")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept",
    )


_STOP_SQL = ", ".join(f"'{word}'" for word in sorted(set(STOP_WORDS)))

OP10_SQL = rf"""
with d as (
  select doc_id, coalesce(text, '') as t,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') as w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: regexp_matches(x, '{WORDS}')) as l
  from documents
), win as (
  select doc_id, i, array_to_string(w[i:i + 4], ' ') as g
  from (select doc_id, w, unnest(range(1, len(w) - 3)) as i from d where len(w) >= 5)
), again as (
  select doc_id, i from win
  qualify count(*) over (partition by doc_id, g) > 1
), covered as (
  select doc_id, sum(least(5, coalesce(next - i, 5))) as n
  from (select doc_id, i, lead(i) over (partition by doc_id order by i) as next from again)
  group by doc_id
), s as (
  select d.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars,
         len(regexp_extract_all(t, '[#*$%&|<>]')) as n_symbols,
         len(regexp_extract_all(t, '!!')) as n_shouts,
         len(l) as n_lines, len(l) - len(list_distinct(l)) as n_dup_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•]'))) as n_bullet_lines,
         len(list_filter(w, lambda x: lower(x) in ({_STOP_SQL}))) as n_stop_words,
         cast(coalesce(c.n, 0) as bigint) as n_repeat_words
  from d left join covered c on c.doc_id = d.doc_id
), v as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from s
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed
       and not (word_chars / n_words < 1.5 or word_chars / n_words > 20.0)
       and n_symbols / n_words <= 0.2 and n_shouts / n_words <= 0.2
       and not (n_words >= 50 and n_stop_words / n_words < 0.02)
       and n_dup_lines / n_lines <= 0.5
       and not (n_words >= 50 and n_bullet_lines / n_lines > 0.9) as kept
from v
"""

QUERIES = {"op10_quality_rules": op10_quality_rules}
ORACLE = {"op10_quality_rules": OP10_SQL}
