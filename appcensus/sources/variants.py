"""Reading of loosely typed JSON values."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from appcensus.functions.text import clean, is_true_word


def worked_out(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a column that later expressions read instead of working it out again.

    The optimizer folds a plain projection into what uses it, once per use, which for
    parsed JSON costs far more than the row a generator makes.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def json_value(text: Column) -> Column:
    """The value of a text that is one JSON value and nothing else.

    The parser leaves alone what follows a value.  So the text becomes the first item of a list
    whose second one no text can give by chance.
    """
    mark = F.xxhash64(text)
    pair = F.try_parse_json(F.concat(F.lit("["), text, F.lit(","), mark.cast("string"), F.lit("]")))
    pairs = F.filter(
        F.array(F.try_variant_get(pair, "$", "array<variant>")),
        lambda p: (F.size(p) == 2) & (F.try_variant_get(F.get(p, F.lit(1)), "$", "bigint") == mark),
    )
    return F.get(F.get(pairs, F.lit(0)), F.lit(0))


def kind(value: Column) -> Column:
    """Schema name of a JSON value, such as ``OBJECT<...>`` or ``BIGINT``."""
    return F.coalesce(F.schema_of_variant(value), F.lit("VOID"))


def is_object(value: Column) -> Column:
    """Only an object can be read as a struct.  (``kind`` would work out the schema of all it holds.)"""
    return F.try_variant_get(value, "$", "struct<a:variant>").isNotNull()


def is_array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>").isNotNull()


def field(value: Column, name: str) -> Column:
    return F.try_variant_get(value, f"$.{name}", "variant")


def as_text(value: Column, name: str) -> Column:
    return shown_text(field(value, name), F.try_variant_get(value, f"$.{name}", "string"))


def fields_of(value: Column, names) -> tuple[Column, Column]:
    """All the named fields at once, as raw values and as text."""
    raw = ",".join(f"{name}:variant" for name in names)
    text = ",".join(f"{name}:string" for name in names)
    return (
        F.try_variant_get(value, "$", f"struct<{raw}>"),
        F.try_variant_get(value, "$", f"struct<{text}>"),
    )


def shown_text(raw: Column, text: Column) -> Column:
    """A field as cleaned text.  Truth values read ``True`` and ``False``."""
    # The kind of a value is looked up only where its text leaves it open.
    truth = text.isin("true", "false") & (kind(raw) == "BOOLEAN")
    return F.when(truth, F.initcap(text)).otherwise(clean(text))


def is_truthy(raw: Column, text: Column) -> Column:
    """Words for yes in text; otherwise anything but zero, false and nothing."""
    shape = kind(raw)
    return F.coalesce(
        F.when(shape == "STRING", is_true_word(text))
        .when(shape == "BOOLEAN", text == "true")
        .when(F.startswith(shape, F.lit("ARRAY")), text != "[]")
        .when(F.startswith(shape, F.lit("OBJECT")), text != "{}")
        .otherwise(text.try_cast("double") != 0),
        F.lit(False),
    )


def as_filled_text(value: Column, name: str) -> Column:
    """A field as cleaned text where empty, zero and false count as missing."""
    shape = kind(field(value, name))
    empty = F.coalesce(
        F.when(shape == "BOOLEAN", ~F.try_variant_get(value, f"$.{name}", "boolean")).when(
            shape != "STRING", F.try_variant_get(value, f"$.{name}", "double") == 0
        ),
        F.lit(False),
    )
    return F.when(~empty, as_text(value, name))
