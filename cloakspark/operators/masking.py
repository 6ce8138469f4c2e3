"""Masking of table cells, notes and free text. All of it is row-local: nothing is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.sources.policy import Policy


def static_columns(df: DataFrame, run_id: str, fields=P.STATIC_FIELDS) -> DataFrame:
    """Every cell of the named columns, blank ones too, becomes a placeholder; missing columns are skipped."""
    return df.withColumns({c: T.placeholder(run_id, label, F.coalesce(F.col(c), F.lit(""))) for c, label in fields if c in df.columns})


def index_columns(df: DataFrame, row_id: str, fields) -> DataFrame:
    """Cells become <LABEL_n> with the row's number."""
    return df.withColumns({c: F.concat(F.lit(f"<{label}_"), F.col(row_id).cast("string"), F.lit(">")) for c, label in fields if c in df.columns})


def hashed_cells(df: DataFrame, fields) -> DataFrame:
    """Whole cells become <LLM_LABEL_hhhhhh> by md5 of label and value; blank cells and tokens stay."""
    return df.withColumns(
        {
            c: F.when((F.col(c) == "") | F.col(c).startswith("<"), F.col(c)).otherwise(F.concat(F.lit(f"<LLM_{label}_"), F.substring(F.md5(F.concat(F.lit(label + "|"), F.col(c))), 1, 6), F.lit(">")))
            for c, label in fields
            if c in df.columns
        }
    )


def masked_text(text: Column, run_id: str, label: str, pattern: str) -> Column:
    """Plain text after one pattern."""
    return T.stitched(text, P.java(pattern), lambda m: F.when(T.is_token(m), m).otherwise(T.placeholder(run_id, label, m)))


def masked_in_steps(df: DataFrame, column: str, run_id: str, rules=P.TEXT_PATTERNS) -> DataFrame:
    """The ordered patterns (label, pattern), one projection each: nested in one expression, each step would repeat all before it several times.

    With the fixed patterns a text without a character that every pattern needs is read once and skips all steps.
    """
    df = df.withColumn("__any", F.col(column).rlike(P.java(P.TEXT_NEEDS)) if rules in (P.TEXT_PATTERNS, P.ASCII_TEXT_PATTERNS) else F.col(column).isNotNull())
    for label, pattern in rules:
        df = df.withColumn(column, F.when(F.col("__any"), masked_text(F.col(column), run_id, label, pattern)).otherwise(F.col(column)))
    return df.drop("__any")


def masked_supplemental(df: DataFrame, column: str, run_id: str, rules=P.SUPPLEMENTAL_PATTERNS) -> DataFrame:
    """Values that stand in a telling context: only the value part of a match is replaced. With the fixed patterns a text without any word that a match holds isn't searched."""
    for label, before, value, after in rules:
        text = T.stitched_parts(F.col(column), before, value, after, True, lambda v, label=label: F.when((v == "") | T.is_token(v), v).otherwise(T.placeholder(run_id, label, v)))
        if rules is P.SUPPLEMENTAL_PATTERNS:
            df = df.withColumn("__low", T.lowered(F.col(column)))
            text = F.when(T.holds_any(F.col("__low"), P.SUPPLEMENTAL_NEEDS[label]), text).otherwise(F.col(column))
        df = df.withColumn(column, text)
    return df.drop("__low")


def _found(text: Column, before: str, value: str, after: str, ignore_case: bool) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(P.java(f"({before})({value})({after})", ignore_case)), 2), F.btrim)


def masked_names(df: DataFrame, column: str, run_id: str, rules=P.NAME_CONTEXTS) -> DataFrame:
    """Names found by their context anywhere in a text are replaced everywhere in it."""
    found = F.array_distinct(F.concat(*[_found(F.col(column), b, v, a, i) for b, v, a, i in rules], F.array().cast("array<string>")))
    return df.withColumn("__names", found).withColumn(column, T.replaced_candidates(F.col(column), F.col("__names"), lambda m: T.placeholder(run_id, "NAME", m))).drop("__names")


def masked_entities(df: DataFrame, column: str, run_id: str, rules=P.ENTITY_CONTEXTS) -> DataFrame:
    """Places, organisations and workplaces found by their context are replaced everywhere in the text, label by label."""
    by_label: dict[str, list[Column]] = {}
    for label, b, v, a, i in rules:
        by_label.setdefault(label, []).append(_found(F.col(column), b, v, a, i))
    df = df.withColumns({f"__{label}": F.array_distinct(F.concat(*found)) for label, found in by_label.items()})
    for label in by_label:
        df = df.withColumn(column, T.replaced_candidates(F.col(column), F.col(f"__{label}"), lambda m, label=label: T.placeholder(run_id, label, m)))
    return df.drop(*[f"__{label}" for label in by_label])


def masked_document(df: DataFrame, column: str, run_id: str, policy: Policy | None = None) -> DataFrame:
    """The whole static phase of plain text, by the fixed patterns or by those of a policy."""
    steps, names, entities = (P.TEXT_PATTERNS, P.NAME_CONTEXTS, P.ENTITY_CONTEXTS) if policy is None else (policy.text_patterns, policy.name_contexts, policy.entity_contexts)
    df = masked_supplemental(masked_in_steps(df, column, run_id, steps), column, run_id)
    return masked_entities(masked_names(df, column, run_id, names), column, run_id, entities)


def masked_rows(df: DataFrame, run_id: str, policy: Policy, known: Column | None = None) -> DataFrame:
    """The whole static phase of a table by a policy: a row's known values and the note patterns in its note fields, then its static fields."""
    notes = [c for c in policy.note_fields if c in df.columns]
    if known is not None:
        df = masked_known(df, notes, known, run_id)
    return static_columns(masked_notes(df, notes, run_id, policy.note_patterns), run_id, policy.static_fields)


def replaced_plainly(df: DataFrame, column: str, run_id: str, rules=P.TEXT_PATTERNS) -> DataFrame:
    """Patterns in order: the distinct matches of each, the longest first, are replaced as plain substrings, wherever they stand."""
    for label, pattern in rules:
        found = F.array_distinct(F.regexp_extract_all(column, F.lit(P.java(pattern)), 0))
        ordered = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
        df = df.withColumn(column, F.aggregate(ordered, F.col(column), _plain(run_id, label)))
    return df


def _plain(run_id: str, label: str):
    return lambda t, v: F.replace(t, v, T.placeholder(run_id, label, v, digits=8))


def pseudonymised_text(df: DataFrame, column: str, run_id: str) -> DataFrame:
    """Names in context first, then the patterns as plain substrings."""
    return replaced_plainly(pseudonymised_names(df, column, run_id), column, run_id)


def known_values(first: str, last: str, email: str, phone: str, address: str) -> Column:
    """array<struct<label, value>> of what a row is known to hold, the longest first."""
    c = lambda n: F.btrim(F.coalesce(F.col(n), F.lit("")))
    name = F.btrim(F.concat_ws(" ", F.nullif(c(first), F.lit("")), F.nullif(c(last), F.lit(""))))
    pairs = [("ADDRESS", c(address)), ("EMAIL", c(email)), ("PHONE_NUMBER", c(phone)), ("NAME", name)]
    values = F.array(*[F.struct(F.lit(label).alias("label"), v.alias("value"), F.lit(k).alias("at")) for k, (label, v) in enumerate(pairs)])
    return F.array_sort(values, lambda a, b: F.when(F.length(a["value"]) != F.length(b["value"]), F.length(b["value"]) - F.length(a["value"])).otherwise(a["at"] - b["at"]))


def masked_known(df: DataFrame, columns: list[str], known: Column, run_id: str) -> DataFrame:
    """A row's own known values in its notes become placeholders."""
    df = df.withColumn("__known", known)
    return df.withColumns({c: T.replaced_values(F.col(c), F.col("__known"), lambda label, m: T.placeholder(run_id, label, m)) for c in columns}).drop("__known")


def masked_notes(df: DataFrame, columns: list[str], run_id: str, rules=P.NOTE_PATTERNS) -> DataFrame:
    """Note patterns: values found outside placeholders are replaced everywhere in the note, the longest first."""
    for label, pattern in rules:
        for c in columns:
            gaps = F.split(F.col(c), P.PLACEHOLDER, -1)
            found = F.array_distinct(F.flatten(F.transform(gaps, lambda g: F.regexp_extract_all(g, F.lit(P.java(pattern, True)), 0))))
            ordered = F.array_sort(found, lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0))
            df = df.withColumn("__found", F.transform(ordered, lambda v: F.struct(F.lit(label).alias("label"), v.alias("value"))))
            df = df.withColumn(c, T.replaced_values(F.col(c), F.col("__found"), lambda label, m: T.placeholder(run_id, label, m))).drop("__found")
    return df


def pseudonymised_names(df: DataFrame, column: str, run_id: str) -> DataFrame:
    """Names in context: the first word becomes a FIRSTNAME token, the rest a LASTNAME token."""

    def tokens(name: Column) -> Column:
        parts = F.split(name, P.java(r"\s+"), 2)
        last = F.when(F.size(parts) > 1, F.concat(F.lit(" "), T.placeholder(run_id, "LASTNAME", F.get(parts, F.lit(1)), digits=8))).otherwise("")
        return F.concat(T.placeholder(run_id, "FIRSTNAME", parts[0], digits=8), last)

    for before, name, after, ignore_case in P.NAME_CONTEXTS:
        df = df.withColumn(column, T.stitched_parts(F.col(column), before, name, after, ignore_case, tokens))
    return df
