"""Text expressions.  All are JVM built-ins; none needs a Python worker."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that Unicode counts as white space.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
TRUE_WORDS = ("1", "true", "yes")


def _bare(text: Column) -> Column:
    """Do both ends hold visible ASCII, so that there is nothing to strip?  Null for null."""
    return F.ascii(text).between(33, 126) & F.ascii(F.substring(text, -1, 1)).between(33, 126)


def strip(text: Column) -> Column:
    """Remove white space of any kind from both ends (``trim`` knows only U+0020).

    Trimming with a list of characters copies a text character by character, so texts that
    have nothing to strip are passed on.
    """
    return F.when(_bare(text), text).otherwise(F.btrim(text, F.lit(WHITESPACE)))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(WHITESPACE))


def clean(text: Column) -> Column:
    """Stripped text; null when nothing is left."""
    stripped = F.btrim(text, F.lit(WHITESPACE))
    return F.when(_bare(text), text).when(stripped != "", stripped)


def decoded(data: Column) -> Column:
    """Captured bytes as text; bytes that are not UTF-8 become U+FFFD."""
    return F.make_valid_utf8(data.cast("string"))


def folded(text: Column) -> Column:
    """Lower-cased stripped text, empty for null: the form used in keys."""
    return F.lower(strip(F.coalesce(text, F.lit(""))))


def folded_path(text: Column) -> Column:
    """``folded`` for a folder: trailing separators do not count."""
    return F.rtrim(folded(text), F.lit("\\/"))


def is_true_word(text: Column) -> Column:
    return F.coalesce(F.lower(strip(text)).isin(*TRUE_WORDS), F.lit(False))


def cell(text: Column, width: int) -> Column:
    """Fixed-width cell: padded with blanks, or cut with an ellipsis."""
    value = F.coalesce(text, F.lit(""))
    long = F.substring(value, 1, width) if width <= 1 else F.concat(
        F.substring(value, 1, width - 1), F.lit("…")
    )
    return F.when(F.length(value) > width, long).otherwise(F.rpad(value, width, " "))


def markdown_cell(text: Column) -> Column:
    value = F.coalesce(text, F.lit(""))
    value = F.replace(value, F.lit("|"), F.lit("\\|"))
    return F.replace(value, F.lit("\n"), F.lit(" "))


def json_value(value: Column) -> Column:
    """One value as JSON text; null becomes ``null``."""
    wrapped = F.to_json(F.array(value))
    return F.substring(wrapped, F.lit(2), F.length(wrapped) - 2)


def json_object(fields: list[tuple[str, Column]]) -> Column:
    """A compact JSON object of already rendered values, in the given order."""
    parts = [F.concat(F.lit(f'"{name}":'), value) for name, value in fields]
    return F.concat(F.lit("{"), F.concat_ws(",", *parts), F.lit("}"))


def quoted(value: Column) -> Column:
    """A text as Python prints it in ``repr``; null prints as ``None``."""
    body = F.replace(value, F.lit("\\"), F.lit("\\\\"))
    for raw, shown in (("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        body = F.replace(body, F.lit(raw), F.lit(shown))
    single = F.concat(F.lit("'"), F.replace(body, F.lit("'"), F.lit("\\'")), F.lit("'"))
    double = F.concat(F.lit('"'), body, F.lit('"'))
    use_double = F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"'))
    plain = F.concat(F.lit("'"), body, F.lit("'"))
    shown = F.when(use_double, double).when(F.contains(value, F.lit("'")), single).otherwise(plain)
    return F.coalesce(shown, F.lit("None"))
