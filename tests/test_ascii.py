"""Documents with letters beyond ASCII at the edges of values: queries as their SQL."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__
from cloakspark.functions import patterns as P
from cloakspark.operators import masking as K

TEXTS = ["Einung +1 (447) 555-1735 enst. Stß st enß", "é123456789012é", "mail a.b@mail.orgé 12 Oak Stä, 1234 5678", "12 Oaké Street", "4111 1111 1111 1111é"]


@pytest.mark.parametrize("name", ["mask_text_patterns", "mapping_first_seen", "placeholder_counts", "unresolved_count", "integrity_full_outer"])
def test_edges_as_in_sql(spark, tmp_path, name):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    db = duckdb.connect()
    db.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    want = db.execute(f"select {', '.join(got.columns)} from ({__spark_entry__.oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_masking_itself_takes_unicode_edges(spark):
    df = spark.createDataFrame([("é123456789012é",)], "text string")
    assert K.masked_in_steps(df, "text", "r").first()[0] == "é123456789012é"
    assert "<ACCOUNT_" in K.masked_in_steps(df, "text", "r", P.ASCII_TEXT_PATTERNS).first()[0]
