"""Many values in one pass against the fold over single expressions; numbers and batches against plain walks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from cloakspark.functions import text as T
from cloakspark.functions.finder import Finder
from cloakspark.operators import records as R
from cloakspark.operators.numbering import greedy_batches, numbered
from cloakspark.operators.values import replaced
from cloakspark.sources.handoff import read_table

RUN = "r"
SIGNS = ["a", "A", "b", "ab", "Ab", "é", "É", "ß", "σ", "ς", "İ", "_", "-", ".", "1", "12", " ", " ", "<A_1>", "<", ">", "😀", "́", "k", "K", "ﬁ", "\n", "\\E", "("]


def token(value, match):
    return T.placeholder(RUN, value["category"], match)


def folded(rows, values):
    """One expression after the other, as the definition says."""
    text = F.aggregate("found", F.col("text"), lambda t, d: F.when(d["value"] == "", t).otherwise(T.stitched_outside(t, T.value_pattern(d["value"]), lambda m: token(d, m))))
    return rows.join(values, "batch", "left").withColumn("text", F.when(F.col("found").isNull(), F.col("text")).otherwise(text)).drop("found")


@pytest.mark.parametrize("seed", range(4))
def test_one_pass_equals_the_fold(spark, seed):
    rng = random.Random(seed)
    rows = [(rng.randrange(6), k, "".join(rng.choices(SIGNS, k=rng.randrange(25)))) for k in range(150)] + [(None, 999, "ab"), (0, 1000, None)]
    values = [(b, [("NAME" if rng.random() < 0.5 else "ID", "".join(rng.choices(SIGNS, k=rng.randrange(1, 4)))) for _ in range(12)]) for b in range(5)]
    rows, values = spark.createDataFrame(rows, "batch int, id int, text string"), spark.createDataFrame(values, "batch int, found array<struct<category:string,value:string>>")
    got = replaced(rows, values, "batch", ["text"], token)
    assert got.columns == rows.columns
    got, want = ({r["id"]: r["text"] for r in df.collect()} for df in (got, folded(rows, values)))
    assert got == want and any(v and "<NAME_" in v for v in want.values())


def test_thousand_values_a_batch(spark):
    words = [f"Name{k}" for k in range(1000)]
    rows = spark.createDataFrame([(k % 3, k, f"{words[k * 7 % 1000]} met {words[k].lower()}, not x{words[k]}") for k in range(300)], "batch int, id int, text string")
    found = spark.createDataFrame([(b, "person names", w) for b in range(2) for w in words], "batch int, category string, value string")
    out = {r["id"]: r for r in R.applied_detections(rows, found, "batch", "text", RUN, notes=False, applied="did").collect()}
    assert all(out[k]["text"].count("<") == (2 if k % 3 < 2 else 0) and f"x{words[k]}" in out[k]["text"] for k in range(300))
    assert [d["value"] for d in out[3]["did"]] == ["Name21", "Name3"]  # the longest first


def test_spans_by_turn():
    assert Finder(["ab", "abc"]).spans("abc ab") == [(4, 6, 0), (0, 3, 1)][::-1]
    assert Finder(["b-", "c"]).spans("ab- c b-c") == [(4, 5, 1), (6, 8, 0), (8, 9, 1)]  # what follows a replaced value stands at an edge
    assert Finder(["aa", ""]).spans("aaa aa") == [(4, 6, 0)] and Finder([]).spans("x") == [] and Finder(["x"]).pieces(None) is None
    assert Finder(["A_1"]).spans("<A_1> A_1") == [(6, 9, 0)]


def test_counts_of_what_was_replaced(spark):
    rows = spark.createDataFrame([(1, 1, "Lee and Kim"), (1, 2, "lee"), (2, 3, "Lee 123 <NAME_x>")], "batch int, id int, text string")
    found = spark.createDataFrame([(b, c, v) for b in (1, 2) for c, v in [("person names", "Lee"), ("names", "Kim"), ("names", "nobody"), ("names", "123"), ("x", "<NAME_x>"), ("x", " <A_1> <"), ("x", "<b>")]], "batch int, category string, value string")
    text = R.applied_detections(rows, found, "batch", "text", RUN, notes=False, applied="applied")
    assert {r["id"]: r["text"].count("<") for r in text.collect()} == {1: 2, 2: 1, 3: 3}
    assert R.applied_count(text, ["id"]).first()["n"] == 5 and R.applied_count(text, ["batch"]).first()["n"] == 4
    notes = R.applied_detections(rows, found, "batch", "text", RUN, applied="applied")
    assert "123" in {r["id"]: r["text"] for r in notes.collect()}[3]  # short digits are for plain text only
    assert R.applied_count(notes, ["batch"]).first()["n"] == 3


def test_two_note_columns_at_once(spark):
    rows = spark.createDataFrame([(1, "Kim", None, 7), (1, "x", "Kim Kim", 8)], "batch int, a string, b string, c int")
    found = spark.createDataFrame([(1, "names", "Kim")], "batch int, category string, value string")
    out = sorted(R.applied_detections(rows, found, "batch", ["a", "b"], RUN).collect(), key=lambda r: r["c"])
    assert out[0]["a"].startswith("<") and out[0]["b"] is None and out[1]["a"] == "x" and out[1]["b"].count("<") == 2


def test_numbers_are_dense_and_in_file_order(spark, tmp_path):
    for k, n in enumerate([40, 3, 500, 1]):
        (tmp_path / f"part{k}.csv").write_text("id,v\n" + "".join(f"{k},{i}\n" for i in range(n)))
    rows = numbered(read_table(spark, str(tmp_path)), "row").collect()
    got = [(r["id"], r["v"]) for r in sorted(rows, key=lambda r: r["row"])]
    assert got == [(str(k), str(i)) for k, n in enumerate([40, 3, 500, 1]) for i in range(n)] and sorted(r["row"] for r in rows) == list(range(544))
    batches = R.fixed_batches(numbered(read_table(spark, str(tmp_path)), "row"), "row", 25).groupBy("batch_id").count().collect()
    assert len(batches) == 22 and {r["count"] for r in batches} == {25, 19}
    frame = spark.range(1000, numPartitions=7).selectExpr("id % 3 x")
    assert sorted(r["n"] for r in numbered(frame, "n", 5).collect()) == list(range(5, 1005))
    assert numbered(frame.limit(0)).count() == 0


def plain_batches(rows, most, characters):
    out, state = {}, {}
    for g, o, s in sorted(rows, key=lambda r: (r[0] is not None, r[0] or "", r[1], r[2] or 0)):
        s = s or 0
        batch, n, chars = state.get(g, (0, 0, 0))
        if n and (n >= most or chars + s > characters):
            batch, n, chars = batch + 1, 0, 0
        state[g] = (batch, n + 1, chars + s)
        out[g, o] = batch
    return out


@pytest.mark.parametrize(("seed", "groups", "most", "characters"), [(1, 1, 5, 60), (2, 4, 3, 25), (3, 60, 25, 200), (4, 2, 1, 10), (5, 3, 40, 10**9), (6, 1, 7, 0)])
def test_packing_equals_a_walk(spark, seed, groups, most, characters):
    rng = random.Random(seed)
    rows = [(None if (g := rng.randrange(groups)) == 3 else f"g{g}", k, None if rng.random() < 0.05 else rng.randrange(25)) for k in range(700)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "40")  # short partitions, so that batches and groups go over several
    try:
        df = spark.createDataFrame(rows, "g string, k int, s int")
        got = greedy_batches(df, "g", "k", "s", most, characters)
        assert {(r["g"], r["k"]): r["batch"] for r in got.collect()} == plain_batches(rows, most, characters)
        assert greedy_batches(df.limit(0), "g", "k", "s", most, characters).count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "3")


def test_one_group_is_spread_over_tasks(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = greedy_batches(spark.range(3000).selectExpr("'all' g", "id k", "10 s"), "g", "k", "s", 25)
        assert out.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_the_query_of_many_values_equals_the_fold(spark, tmp_path):
    from cloakspark.functions import patterns as P
    from cloakspark.operators.records import accepted, canonical
    from cloakspark.plans import detecting as Q
    from cloakspark.plans.fixtures import RUN as OWN
    from cloakspark.plans.fixtures import fixture

    rng = random.Random(3)
    words = ["Anna", "anna", "Bell", "of", "the", "The", "étage", "ab-cd", "a", "x1"]
    turns = [(c, t, "user", " ".join(rng.choices(words, k=rng.randrange(12)))) for c in range(4) for t in range(3)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    spark.range(12).withColumnRenamed("id", "c_custkey").write.parquet(f"{tmp_path}/customer.parquet")
    named = fixture(spark, str(tmp_path), Q.WORDS).where("value <> ''").withColumn("category", canonical(T.category_key(F.col("category")), P.NOTE_ALIASES))
    found = accepted(named, "category", "value", False).distinct().groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("category", (-F.length("value")).alias("k"), "value"))).alias("found"))
    text = F.aggregate("found", F.col("text"), lambda t, d: T.stitched_outside(t, T.value_pattern(d["value"]), lambda m: T.placeholder(OWN, T.shaped_category(d["category"], d["value"]), m)))
    want = spark.read.parquet(f"{tmp_path}/conversations.parquet").join(found, "conv_id", "left").select("conv_id", "turn", F.when(F.col("found").isNull(), F.col("text")).otherwise(text).alias("text"))
    assert {tuple(r) for r in Q.apply_many(spark, str(tmp_path)).select("conv_id", "turn", "text").collect()} == {tuple(r) for r in want.collect()}
