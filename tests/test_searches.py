"""Replacement searches a text once, and gives the same for texts that hold the mark it cuts at."""

from __future__ import annotations

from pyspark.sql import functions as F

from cloakspark.functions import text as T

TEXTS = ["a1b22c", "1", "22x", "none", "", None, "$1 \\2 é3\U0001f6004"]


def test_a_text_is_searched_once(spark, capsys):
    df = spark.range(9).selectExpr("cast(id as string) as t")
    for new in (T.stitched(F.col("t"), r"\d+", F.upper), T.stitched_parts(F.col("t"), "", r"\d+", "", False, F.upper)):
        df.select(new.alias("n")).explain(True)
        plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
        # all but one search stand in the branch of texts with a mark of their own
        other = plan[plan.index("ELSE array_join(transform(") :]
        assert other.count("regexp_replace(") == 1 and not any(f in other for f in ("regexp_extract_all(", "rlike", "regexp_like("))


def test_texts_with_the_mark(spark):
    each = lambda m: F.concat(F.lit("<"), m, F.lit(">"))
    for mark in ("\u0001", "\u0001\u0001", "x\u00019\u0001"):
        df = spark.createDataFrame([(t, None if t is None else t + mark, mark) for t in TEXTS], "t string, marked string, mark string")
        for make in (lambda c: T.stitched(c, r"\d+", each), lambda c: T.stitched_parts(c, "", r"\d+", "", False, each)):
            tail = make(F.col("mark"))
            rows = df.select(F.concat(make(F.col("t")), tail).alias("a"), make(F.col("marked")).alias("b")).collect()
            assert [r["a"] for r in rows] == [r["b"] for r in rows] and rows[0]["a"].startswith("a<1>b<22>c")
