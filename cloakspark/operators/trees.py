"""JSON texts of any shape: a map and a fold over their string values. Keys, numbers and structure stay as they are.

A JSON text is cut at its string literals. A literal before a colon is a key; every other one is a value, which is
decoded, mapped and encoded again, so quotes and escapes in replacements can't break the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import text as T

_LITERAL = r'"[^"\\]*+(?:\\.[^"\\]*+)*+"(?:\s*:)?+'
#: What a literal holds that isn't what it says: escapes, and characters that JSON doesn't allow.
_CODED = r"[\\\x00-\x1f]"


def _decoded(literal: Column) -> Column:
    parsed = F.get(F.from_json(F.concat(F.lit("["), literal, F.lit("]")), "array<string>"), 0)
    return F.when(literal.rlike(_CODED), parsed).otherwise(F.substring(literal, F.lit(2), F.length(literal) - 2))


def _may_hold(literal: Column, needs: str) -> Column:
    return literal.contains(needs) | literal.rlike(_CODED)


def _encoded(value: Column) -> Column:
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def string_values(json: Column, needs: str = "") -> Column:
    """All string values of a JSON text in order, repeats included; an empty array for null. Values without the text `needs` may be left out."""
    values = F.filter(F.regexp_extract_all(json, F.lit(_LITERAL), 0), lambda x: ~x.endswith(":") & _may_hold(x, needs) if needs else ~x.endswith(":"))
    return F.coalesce(F.transform(values, _decoded), F.array().cast("array<string>"))


def mapped_values(json: Column, each: Callable[[Column], Column], needs: str = "") -> Column:
    """The JSON text with every string value replaced by `each` of it; values it leaves alone keep their spelling. `each` leaves values without the text `needs` alone."""

    def one(literal: Column) -> Column:
        value = _decoded(literal)
        new, kept = each(value), literal.endswith(":")
        kept = kept | ~_may_hold(literal, needs) if needs else kept
        return F.when(kept | new.eqNullSafe(value), literal).otherwise(_encoded(new))

    return T.stitched(json, _LITERAL, one)


def tokens_of(json: Column) -> Column:
    """All placeholders in the string values of a JSON text, repeats included."""
    return F.flatten(F.transform(string_values(json, "<"), T.tokens_in))


def token_counts(df: DataFrame, json_col: str) -> DataFrame:
    """placeholder, n over the string values of all JSON texts."""
    return df.select(F.explode_outer(tokens_of(F.col(json_col))).alias("placeholder")).where("placeholder is not null").groupBy("placeholder").agg(F.count("*").alias("n"))
