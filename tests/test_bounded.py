"""What a task holds at once doesn't grow with the table."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from cloakspark.operators import numbering, trees, values
from cloakspark.operators.restoration import restored_json
from cloakspark.plans import fixtures as X


def test_partitions_of_packed_rows(spark, monkeypatch):
    rows = spark.range(3000).selectExpr("'all' as g", "id as k", "1L + id % 7 as size")
    whole = numbering.greedy_batches(rows, "g", "k", "size", 25, 60).collect()
    monkeypatch.setattr(numbering, "ROWS_A_PART", 100)
    got = numbering.greedy_batches(rows, "g", "k", "size", 25, 60)
    sizes = [r["count"] for r in got.groupBy(F.spark_partition_id()).count().collect()]
    assert len(sizes) > 20 and max(sizes) < 400 and sorted(got.collect()) == sorted(whole)


def test_pieces_are_handed_on(spark, monkeypatch):
    rows = spark.createDataFrame([(k % 7 or None, k, None if k % 5 == 0 else f"ann{k} met Ann, bob and {'x' * k}", "bob") for k in range(60)], "b long, k long, t string, u string").coalesce(1)
    found = spark.createDataFrame([(b, [("ann",), ("BOB",)]) for b in range(1, 6)], "b long, found array<struct<value:string>>")
    want = [(k, None if k % 5 == 0 else f"ann{k} met [Ann], [bob] and {'x' * k}" if (k % 7) in range(1, 6) else f"ann{k} met Ann, bob and {'x' * k}", "[bob]" if (k % 7) in range(1, 6) else "bob") for k in range(60)]
    for most in (1, 7, 20_000):
        monkeypatch.setattr(values, "PIECES_AT_ONCE", most)
        got = values.replaced(rows, found, "b", ["t", "u"], lambda v, m: F.concat(F.lit("["), m, F.lit("]")), "did")
        assert sorted((r["k"], r["t"], r["u"]) for r in got.collect()) == want


def test_conversations_are_spread(spark, tmp_path):
    spark.range(9000).selectExpr("id as conv_id").coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    assert X.fixture(spark, str(tmp_path), "select conv_id from {conversations}").rdd.getNumPartitions() == 3


def test_only_values_that_need_it_are_parsed(spark, capsys):
    payloads = ['{"a":"<T_1>","<T_1>" : "plain","n":[1,"\\u003cT_1>"],"e":"q\\"<T_1>"}', '{"a":"\\u0041b","b":"<T_9>"}', '["<T_1>","line\nbreak"]', "", None, '{"a":"é\U0001f600 <T_1>\\n"}']
    df = spark.createDataFrame(list(enumerate(payloads)), "id long, p string")
    mapping = spark.createDataFrame([("<T_1>", 'v"1')], "placeholder string, original_value string")
    got = {r["id"]: r["p"] for r in restored_json(df, "id", "p", mapping).collect()}
    assert json.loads(got[0]) == {"a": 'v"1', "<T_1>": "plain", "n": [1, 'v"1'], "e": 'q"v"1'}
    assert json.loads(got[5]) == {"a": 'é\U0001f600 v"1\n'} and [got[k] for k in (1, 2, 3, 4)] == payloads[1:5]
    spark.range(3).selectExpr("cast(id as string) as p").select(trees.tokens_of(F.col("p")).alias("n")).explain(True)
    assert "rlike" in capsys.readouterr().out.lower()
