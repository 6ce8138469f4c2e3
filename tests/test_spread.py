"""Work on derived tables: spread by rows, and done once for each row."""

from __future__ import annotations

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from cloakspark.functions import patterns as P
from cloakspark.operators import masking as K
from cloakspark.plans import fixtures as X

FOLDER = "/root/testdata/sf0.001"


def test_customers_of_one_split_are_spread(spark, tmp_path):
    spark.range(9000).selectExpr("id as c_custkey").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    got = X.fixture(spark, str(tmp_path), X.NUMBERED)
    sizes = [r["n"] for r in got.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) == 3 and sum(sizes) == 9000 and max(sizes) <= X.ROWS_A_TASK


@pytest.mark.parametrize("name", ["residual_rows", "residual_records", "residual_note_rows"])
def test_detectors_stand_in_no_filter(spark, capsys, name):
    __spark_entry__.queries()[name](spark, FOLDER).explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1]
    filters = [line for line in plan.splitlines() if re.search(r"\bFilter\b", line)]
    assert filters and not any(re.search("regexp_(extract_all|count)", line) for line in filters)


def test_supplemental_patterns_with_and_without_their_words(spark):
    texts = ["EMPLOYEE ID ab-12, paſſport number: k1234567 and paſsport number K1234567", "travel booking id: ABCD; Transaction TXN-12345", "medical ref: MED-99999, 12 poundſ", "₹ 5.00 and €3", "aſthma treatment, ETF advice", "nothing", "", None]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "id int, text string")
    everywhere = K.masked_supplemental(df, "text", "r", list(P.SUPPLEMENTAL_PATTERNS))
    assert sorted(map(tuple, K.masked_supplemental(df, "text", "r").collect())) == sorted(map(tuple, everywhere.collect()))
