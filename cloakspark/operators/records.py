"""Numbered records of a text, batches of records, and detections."""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators.values import replaced
from cloakspark.sources.session import with_package

MAX_CHARACTERS = 12_000


def split_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, number, text: a text cut at lines that start with a number and a point; each record keeps its marker.

    Position 0 is what stands before the first marker, with no number. A text without markers is one record, number 1; a
    blank one is no record, only such a position 0.
    """
    starts = F.col(text_col).rlike(P.java(r"^\d+\.\s"))
    parts = F.split(text_col, P.java(r"(?m)(?=^\d+\.\s)"), -1)
    blank = F.btrim(F.col(text_col), F.lit(" \t\r\n")) == ""
    rows = df.select(id_col, F.posexplode(parts).alias("i", "text"), starts.alias("starts"), ((F.size(parts) == 1) & ~blank).alias("alone"))
    pos = F.when(F.col("starts") | F.col("alone"), F.col("i") + 1).otherwise(F.col("i"))
    number = F.when(F.col("alone") & ~F.col("starts"), 1).otherwise(F.nullif(F.regexp_extract("text", P.java(r"^(\d+)\.\s"), 1), F.lit("")).try_cast("int"))
    return rows.select(id_col, pos.alias("pos"), number.alias("number"), "text")


def bare_records(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, pos, number, text of the records without their markers, trimmed; white space may stand before a marker, what stands before the first is left out."""
    marked = split_records(df.withColumn(text_col, F.regexp_replace(text_col, P.java(r"(?m)^\s*(\d+\.)(\s|$)"), "$1$2")), id_col, text_col).where("number is not null")
    return marked.withColumn("text", F.btrim(F.regexp_replace("text", P.java(r"^\d+\.\s"), ""), F.lit(" \t\r\n")))


def record_count(text: Column) -> Column:
    """Number of records of a text: its markers, or one for a text without any that isn't blank."""
    marks = F.regexp_count(text, F.lit(P.java(r"(?m)^\d+\.\s")))
    return F.when(marks > 0, marks).otherwise((F.btrim(text, F.lit(" \t\r\n")) != "").cast("int"))


def joined_records(records: DataFrame, id_col: str) -> DataFrame:
    """The texts that split_records cut."""
    return records.groupBy(id_col).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda r: r["text"]), "").alias("text"))


def fixed_batches(df: DataFrame, row_id: str, size: int) -> DataFrame:
    """batch_id and position (from 1) by a dense row number from 0: no global order is needed."""
    return df.withColumns({"batch_id": F.floor(F.col(row_id) / size).cast("long"), "position": (F.col(row_id) % size + 1).cast("int")})


def merged_detections(df: DataFrame, key: str, ord_: str, category: str, value: str) -> DataFrame:
    """key, category, values: values of a category in order of appearance, each once; nulls dropped."""
    firsts = df.where(F.col(value).isNotNull()).groupBy(key, category, value).agg(F.min(ord_).alias("o"))
    return firsts.groupBy(key, category).agg(F.transform(F.array_sort(F.collect_list(F.struct("o", F.col(value).alias("v")))), lambda x: x["v"]).alias("values"))


def accepted(df: DataFrame, category: str, value: str, notes: bool = True) -> DataFrame:
    """Detections that may be replaced: two characters or more, or digits, and no tokens.

    In notes, digits need four unless the category names an id, and a token is what stands between brackets. In plain text
    any digits count, and a token is a value of nothing but placeholders.
    """
    digits = F.col(value).rlike(r"^\d+$")
    long = (F.length(value) >= 2) | digits
    if not notes:
        return df.where((F.col(value) != "") & ~T.only_tokens(F.col(value)) & long)
    return df.where(~T.is_token(F.col(value)) & long & ~(digits & (F.length(value) < 4) & ~F.col(category).isin(*P.ID_CATEGORIES)))


def canonical(category: Column, aliases: dict[str, str] = P.NOTE_ALIASES) -> Column:
    """The category under its common name."""
    known = F.create_map(*[F.lit(x) for kv in aliases.items() for x in kv])
    return F.coalesce(F.element_at(known, category), category)


def applied_detections(
    rows: DataFrame, detections: DataFrame, batch: str, text_col: str | list[str], run_id: str, aliases: dict[str, str] = P.NOTE_ALIASES, notes: bool = True, applied: str | None = None, tasks: int | None = None
) -> DataFrame:
    """Rows with every accepted detection of their batch replaced in the text columns, outside placeholders; by category, the longest first.

    detections: batch, category, value. They are gathered per batch, which is bounded by the batch size. `applied` names a
    further column, if given: array<struct<category, value>> of the detections that replaced something in the row.
    `tasks`, if given, deals the batches out over that many tasks.
    """
    named = detections.withColumn("category", canonical(T.category_key(F.col("category")), aliases)).withColumn("value", F.btrim("value"))
    some = accepted(named, "category", "value", notes)
    keyed = (some.repartition(tasks, batch) if tasks else some).groupBy(batch).agg(F.array_sort(F.collect_set(F.struct("category", (-F.length("value")).alias("k"), "value"))).alias("found"))
    # the label is worked out per value, not per match
    label = lambda v: T.label_norm(T.shaped_category(v["category"], v["value"])).alias("label")
    values = keyed.select(batch, F.transform("found", lambda v: F.struct(v["category"].alias("category"), v["value"].alias("value"), label(v))).alias("found"))
    columns = [text_col] if isinstance(text_col, str) else text_col
    done = replaced(rows, values, batch, columns, lambda v, m: T.token_of(run_id, v["label"], m), applied, tasks)
    return done.withColumn(applied, F.transform(applied, lambda v: F.struct(v["category"].alias("category"), v["value"].alias("value")))) if applied else done


def applied_count(rows: DataFrame, by: list[str], applied: str = "applied") -> DataFrame:
    """n: distinct detections that replaced something, each once per `by`: the batch in notes, the record in plain text."""
    return rows.select(*by, F.explode(applied).alias("d")).select(*by, "d.category", "d.value").distinct().agg(F.count("*").alias("n"))


def scattered(rows: DataFrame, recovered: DataFrame, key: str, column: str) -> DataFrame:
    """Rows with the recovered ones in place of their originals."""
    new = recovered.select(key, F.col(column).alias("__new"))
    return rows.join(new, key, "left").withColumn(column, F.coalesce("__new", column)).drop("__new")


_BRACES = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)


def objects_in(reply: str) -> list[str]:
    """The JSON objects of a reply as texts, whatever stands around them (words, code fences); ValueError if there is none.

    Braces are paired off outside of strings; a pair that isn't JSON is looked into.
    """
    out, at = [], 0
    while (start := reply.find("{", at)) >= 0:
        depth, at = 0, start + 1
        for m in _BRACES.finditer(reply, start):
            depth += {"{": 1, "}": -1}.get(m[0], 0)
            if not depth:
                try:
                    json.loads(reply[start : m.end()])
                except ValueError:
                    break
                out.append(reply[start : m.end()])
                at = m.end()
                break
    if not out:
        raise ValueError("no JSON object in the reply")
    return out


def values_of_objects(df: DataFrame, keys: list[str], objects: str) -> DataFrame:
    """keys, ord, category, value of all that the objects of a row hold, in order: items of arrays, or single values; nulls dropped."""
    each = df.select(*keys, F.posexplode(objects).alias("i", "o"))
    fields = each.select(*keys, "i", F.posexplode(F.map_entries(F.from_json("o", "map<string,string>"))).alias("j", "e"))
    items = F.when(F.col("e.value").startswith("["), F.from_json("e.value", "array<string>")).otherwise(F.array("e.value"))
    values = fields.select(*keys, "i", "j", F.col("e.key").alias("category"), F.posexplode(items).alias("k", "value"))
    return values.where("value is not null").select(*keys, F.struct("i", "j", "k").alias("ord"), "category", "value")


def parsed_replies(df: DataFrame, column: str) -> DataFrame:
    """The frame with `objects`, the JSON objects of a reply as texts; null for a reply without one."""

    @F.pandas_udf("array<string>")
    def parse(replies: pd.Series) -> pd.Series:
        def one(r):
            try:
                return objects_in(r or "")
            except ValueError:
                return None

        return replies.map(one)

    with_package(df.sparkSession)
    return df.withColumn("objects", parse(column))
