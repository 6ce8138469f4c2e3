"""Column functions: tokens, and replacement of matches by a function of the match.

Replacement splits a text into the gaps between matches and the matches, and stitches them together again. A
pattern must match at least one character.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions.patterns import ANGLE_TOKEN, CATEGORY_SHAPES, PLACEHOLDER, STRICT_BODY, java


def lowered(text: Column) -> Column:
    """Lower case, also of the letters that match i, s and k when case is ignored, in Unicode."""
    for letter, plain in (("\u0130", "i"), ("\u017f", "s"), ("\u212a", "k")):
        text = F.replace(text, F.lit(letter), F.lit(plain))
    return F.lower(text)


def holds_any(low: Column, words: tuple[str, ...]) -> Column:
    """Whether a text in lower case holds one of the words."""
    return reduce(lambda a, b: a | b, [low.contains(w) for w in words])


def is_ascii(text: Column) -> Column:
    """Whether every character of a text is one byte."""
    return F.octet_length(text) == F.length(text)


def plainly_lowered(text: Column) -> Column:
    """Lower case of a text in ASCII, where a letter matches no other than itself in either case; null for any other text."""
    return F.when(is_ascii(text), F.lower(text))


def may_hold(low: Column, words: tuple[str, ...]) -> Column:
    """False for a text (as `plainly_lowered` gives it) that holds none of the words; true for one that may, ignoring case."""
    return F.coalesce(holds_any(low, words), F.lit(True))


def once(df: DataFrame, value: Column, name: str, *kept: str) -> DataFrame:
    """The kept columns and `value`, worked out once for each row, also where rows are filtered by it.

    The optimiser would push a filter below the projections that make its columns, and work out their whole chain again
    for every mention of one. It doesn't push one below an outer explode.
    """
    return df.select(*kept, F.explode_outer(F.array(value)).alias(name))


def label_norm(label: Column) -> Column:
    """Upper case, runs of non-word characters as one underscore; PII if nothing is left."""
    return F.coalesce(F.nullif(F.btrim(F.regexp_replace(F.upper(F.btrim(label)), java(r"\W+"), "_"), F.lit("_")), F.lit("")), F.lit("PII"))


def value_norm(value: Column) -> Column:
    """White space at the ends goes, runs of it become one space; case stays."""
    return F.btrim(F.regexp_replace(value, java(r"\s+"), " "))


def placeholder(run_id: str, label: str | Column, value: Column, extra: Column | None = None, digits: int = 10) -> Column:
    """<LABEL_hhhhhhhhhh>: a hash of run, label and value, null for a null value; `extra` tells colliding values apart."""
    return token_of(run_id, label_norm(label if isinstance(label, Column) else F.lit(label)), value, extra, digits)


def token_of(run_id: str, label: Column, value: Column, extra: Column | None = None, digits: int = 10) -> Column:
    """The placeholder under a label as `label_norm` gives it."""
    parts = [F.lit(run_id), label, value_norm(value), *([extra] if extra is not None else [])]
    token = F.concat(F.lit("<"), label, F.lit("_"), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, digits), F.lit(">"))
    return F.when(value.isNotNull(), token)


def is_token(value: Column) -> Column:
    """Between angle brackets."""
    return value.startswith("<") & value.endswith(">")


def is_blank(value: Column) -> Column:
    """Nothing, or a word for nothing."""
    return F.lower(F.btrim(value)).isin("", "nan", "none", "null")


def only_tokens(value: Column) -> Column:
    """Nothing but placeholders, brackets and white space."""
    return value.rlike(f"^{PLACEHOLDER}$") | (F.btrim(F.regexp_replace(value, PLACEHOLDER, ""), F.lit(" <>\t\r\n")) == "")


def quoted(value: Column) -> Column:
    r"""A pattern that matches exactly this value, also if it holds \E."""
    return F.concat(F.lit(r"\Q"), F.replace(value, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))


def value_pattern(value: Column) -> Column:
    """Ignoring case; at an alphanumeric end no word character may follow."""
    edge = lambda side, end: F.when(F.regexp_like(value, F.lit(java(end))), side).otherwise("")
    return F.concat(F.lit("(?diuU)"), edge(r"(?<!\w)", r"^[\p{L}\p{N}]"), quoted(value), edge(r"(?!\w)", r"[\p{L}\p{N}]\z"))


#: Stands around what a pattern found, until the text is cut there.
_MARK = "\u0001"


def _cut_at_marks(text: Column, pattern: Column, found: str, each: Callable[[Column], Column], searched: Column) -> Column:
    """The text with the marked part of every match replaced by `each` of it, in one search; `searched` does it for a text that holds a mark of its own."""
    pieces = F.split(F.regexp_replace(text, pattern, F.lit(found)), _MARK, -1)
    new = F.array_join(F.transform(pieces, lambda x, i: F.when(i % 2 == 1, each(x)).otherwise(x)), "")
    return F.when(text.contains(_MARK), searched).otherwise(new)


def stitched(text: Column, pattern: str | Column, each: Callable[[Column], Column]) -> Column:
    """The text with every match replaced by `each` of it."""
    pattern = pattern if isinstance(pattern, Column) else F.lit(pattern)
    pairs = F.zip_with(F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, 0), lambda gap, m: F.concat(gap, F.when(m.isNull(), "").otherwise(each(m))))
    return _cut_at_marks(text, pattern, f"{_MARK}$0{_MARK}", each, F.array_join(pairs, ""))


def stitched_parts(text: Column, before: str, value: str, after: str, ignore_case: bool, each: Callable[[Column], Column]) -> Column:
    """The text with the value part of every match replaced by `each` of it."""
    pattern = F.lit(java(f"({before})({value})({after})", ignore_case))
    groups = F.arrays_zip(*(F.regexp_extract_all(text, pattern, k).alias(f"g{k}") for k in (1, 2, 3)))
    pairs = F.zip_with(F.split(text, pattern, -1), groups, lambda gap, g: F.concat(gap, F.when(g.isNull(), "").otherwise(F.concat(g["g1"], each(g["g2"]), g["g3"]))))
    return _cut_at_marks(text, pattern, f"$1{_MARK}$2{_MARK}$3", each, F.array_join(pairs, ""))


def stitched_outside(text: Column, pattern: Column, each: Callable[[Column], Column]) -> Column:
    """As stitched, but placeholders in the text stay whole: only the gaps between them are searched."""
    gaps = F.split(text, PLACEHOLDER, -1)
    held = F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)
    return F.array_join(F.zip_with(gaps, held, lambda g, p: F.concat(stitched(g, pattern, each), F.coalesce(p, F.lit("")))), "")


def replaced_values(text: Column, values: Column, each: Callable[[Column, Column], Column]) -> Column:
    """Fold over array<struct<label, value>>, in its order: every occurrence of each value becomes each(label, match). Plain letters that don't hold the value aren't searched, as each value is a pattern of its own."""

    def one(t: Column, v: Column) -> Column:
        absent = is_ascii(t) & is_ascii(v["value"]) & ~F.lower(t).contains(F.lower(v["value"]))
        return F.when((F.coalesce(v["value"], F.lit("")) == "") | absent, t).otherwise(stitched(t, value_pattern(v["value"]), lambda m: each(v["label"], m)))

    return F.aggregate(values, text, one)


def replaced_candidates(text: Column, values: Column, each: Callable[[Column], Column]) -> Column:
    """Every occurrence of any of the values, the longest first, ignoring case, becomes `each` of the match."""
    usable = F.filter(values, lambda v: (v != "") & ~is_token(v))
    ordered = F.array_sort(usable, lambda a, b: F.when(F.length(a) > F.length(b), -1).when(F.length(a) < F.length(b), 1).when(a < b, -1).when(a > b, 1).otherwise(0))
    pattern = F.concat(F.lit(r"(?diuU)(?<!\w)(?:"), F.array_join(F.transform(ordered, quoted), "|"), F.lit(r")(?!\w)"))
    return F.when(F.size(usable) == 0, text).otherwise(stitched(text, pattern, each))


def tokens_in(text: Column) -> Column:
    """All placeholders of a text, repeats included."""
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), 0)


def strict_token(token: Column) -> Column:
    """<BODY> if the token is a well-formed body between any number of brackets, else null."""
    body = F.btrim(token, F.lit("<>"))
    return F.when(body.rlike(f"^{STRICT_BODY}$"), F.concat(F.lit("<"), body, F.lit(">")))


def without_known(text: Column, known: Column | None = None) -> Column:
    """The text without well-formed tokens; of those only the ones in `known`, if given."""
    ok = lambda t: strict_token(t).isNotNull() & (F.lit(True) if known is None else F.array_contains(known, strict_token(t)))
    return F.when(text.contains("<"), stitched(text, ANGLE_TOKEN, lambda t: F.when(F.coalesce(ok(t), F.lit(False)), "").otherwise(t))).otherwise(text)


def unknown_tokens(text: Column, known: Column | None = None) -> Column:
    """Number of angle tokens that `without_known` leaves."""
    ok = lambda t: strict_token(t).isNotNull() & (F.lit(True) if known is None else F.array_contains(known, strict_token(t)))
    n = F.size(F.filter(F.regexp_extract_all(text, F.lit(ANGLE_TOKEN), 0), lambda t: ~F.coalesce(ok(t), F.lit(False))))
    return F.when(~text.contains("<"), 0).otherwise(n)


def bracketed(token: Column) -> Column:
    """The token with a missing bracket at either end added."""
    t = F.when(token.startswith("<"), token).otherwise(F.concat(F.lit("<"), token))
    return F.when(t.endswith(">"), t).otherwise(F.concat(t, F.lit(">")))


def category_key(category: Column) -> Column:
    """Upper case with underscores, no fallback."""
    return F.btrim(F.regexp_replace(F.upper(F.btrim(category)), java(r"\W+"), "_"), F.lit("_"))


def shaped_category(category: Column, value: Column) -> Column:
    """The category that the shape of the value gives, else the given one; a medical reference without its shape is health context."""
    out = F.when(category == "MEDICAL_REFERENCE", "HEALTH_CONTEXT").otherwise(category)
    for name, pattern in reversed(CATEGORY_SHAPES):
        out = F.when(value.rlike(java(pattern, True)), name).otherwise(out)
    return out


def percentage(part: Column, whole: Column) -> Column:
    """Share with four decimals, or a note where there is nothing to share."""
    return F.when(whole == 0, "Not applicable").otherwise(F.format_string("%.4f%%", part * 100.0 / whole))
