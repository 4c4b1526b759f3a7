"""What makes a JSON line acceptable beyond what ``from_json`` checks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from joblog.schema import CORRUPT

# Standard JSON only; a record with any unreadable field keeps its text in CORRUPT.
READ_OPTIONS = {
    "mode": "PERMISSIVE",
    "columnNameOfCorruptRecord": CORRUPT,
    "allowNonNumericNumbers": "false",
    "allowSingleQuotes": "false",
}


SHAPE = "__shape"


def with_shape(parsed: DataFrame, schema: T.StructType, texts: Iterable[str]) -> DataFrame:
    """Add SHAPE: ``sound`` (one JSON object and nothing else) and the JSON type of each top-level key in ``texts``.

    A line that its fields, as ``schema`` has read them, give back byte by byte
    is sound, and its texts are texts. So are the lines that this package and
    others like it write; they need no second parse. Any other line is parsed
    again, as the middle of an array between two marks. The JSON parser stops
    after one value, so a second value, or brackets that end the array early,
    show as a mark out of place; repeated keys and loose syntax give no value at
    all. Keys inside nested objects play no part.
    """
    texts = list(dict.fromkeys(texts))
    again = F.to_json(F.struct(*[c for c in schema.names if c != CORRUPT]), {"ignoreNullFields": "true"})
    marked = compute_once(parsed, "__plain", F.coalesce(again == F.col("value"), F.lit(False)))
    read = F.when(~F.col("__plain"), F.try_parse_json(F.concat(F.lit("[0,"), F.col("value"), F.lit(",1]"))))
    whole = compute_once(marked, "__json", read)
    kind = lambda path: F.schema_of_variant(F.try_variant_get("__json", path, "variant"))
    sound = (
        F.is_valid_utf8("value")
        & F.col("value").rlike(r"^\s*\{")
        & F.coalesce(F.try_variant_get("__json", "$[2]", "int") == 1, F.lit(False))
        & F.try_variant_get("__json", "$[3]", "variant").isNull()
        & kind("$[1]").startswith("OBJECT")
    )
    fields = [F.coalesce(sound, F.lit(False)).alias("sound"), *(kind(f"$[1].{k}").alias(k) for k in texts)]
    known = F.struct(F.lit(True).alias("sound"), *(F.lit(None).cast("string").alias(k) for k in texts))
    shape = F.when(F.col("__plain"), known).otherwise(F.struct(*fields))
    return compute_once(whole, SHAPE, shape).drop("__json", "__plain")


def sound() -> Column:
    return F.col(SHAPE)["sound"]


def not_text(keys: Iterable[str]) -> Column:
    """True when a key that must hold text holds another JSON type (``from_json`` would convert it)."""
    wrong = F.lit(False)
    for key in keys:
        wrong = wrong | F.coalesce(~F.col(SHAPE)[key].isin("STRING", "VOID"), F.lit(False))
    return wrong


def finite(column: Column) -> Column:
    return column.isNull() | (~F.isnan(column) & (F.abs(column) < float("inf")))


def parse_once(lines: DataFrame, schema: T.StructType) -> DataFrame:
    """The fields of the JSON in ``value`` as columns, next to the columns of ``lines``.

    A generator, not a projection: filters on the fields would be pushed below a
    projection together with the parse, once per use of a field. They stay above
    a generator, so each line is parsed one time.
    """
    return lines.select("*", F.inline(F.array(F.from_json("value", schema, READ_OPTIONS))))


def compute_once(df: DataFrame, name: str, column: Column) -> DataFrame:
    """Add a costly column that later filters use without computing it again."""
    return df.select("*", F.explode(F.array(column)).alias(name))
