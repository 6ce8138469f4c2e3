"""Searches are left out of texts that can't match, and only there."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators import reports as S

RECORDS = [
    "Credit CARD 1", "<LLM_CREDIT_CARD_ab> <CARD_ID_x>", "ACCOUNT  number and account number", "ifsc", "<IFSC_1>", "paſſport", "PASSPORT dıagnosis", "medıcal", "hospitals", "my Hospitaĺ", "residential  address", "<ADDRESS_0>",
    "e-mail contact é", "EMAİL", "emaıl", "<phone_number_1>", "Phone, dob", "é DOB", " hospıtal", "nothing", "", None, "banK card ſ debit card",
]


def test_privacy_types_are_those_of_every_pattern(spark, capsys):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(RECORDS)], "id int, t string")
    each = [F.when(reduce(lambda a, b: a | b, [F.col("t").rlike(P.java(p, True)) for p in ps]), F.lit(name)) for name, _, ps in P.PRIVACY_TYPES]
    want = {r["id"]: r["w"] for r in df.select("id", F.array_compact(F.array(*each)).alias("w")).collect()}
    got = S.privacy_risk(df, "t")
    assert {r["id"]: r["types"] for r in got.collect()} == want and sum(map(bool, want.values())) > 15
    assert {r["id"]: r["types"] for r in df.select("id", S.privacy_types(F.col("t")).alias("types")).collect()} == want
    weights = {name: w for name, w, _ in P.PRIVACY_TYPES}
    assert all((r["score"], r["calculation"]) == (sum(weights[t] for t in r["types"]), " + ".join(str(weights[t]) for t in r["types"]) or "0") for r in got.collect())
    got.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert plan.count("RLIKE") + plan.count("rlike") == len(P.PRIVACY_TYPES)  # a search a type


NOTES = [
    "ref emp-77ab or EMP-77AB, MED-1234", "pnr12345 PNRABCDE", "K1234567", "aſthma review, renal therapy", "Some-long medıcation and medication", "City Care hospital", "City Care Hospital é", "ſpouse of Mia Lee", "emp Ravi Patel; PT Ana Cruz", "Ann Lee works at Acme Ltd, é",
    "WORKS @ Acme under", "spoke with Mia.", "Spoke with Mia.", "travel with Delta Air to New York, flying Alpha to Rome", "a@b.org, 001 555 123 4567", "<<NAME_1111111111>> <b> <name_1>", "<unclosed", "nothing", "", None, "Lee Young flying",
]


def test_notes_are_counted_as_without_words(spark, capsys):
    df = spark.createDataFrame([(k, t, "Mia", "Lee", "") for k, t in enumerate(NOTES)], "id int, t string, first string, last string, address string")
    count = lambda rules: S.note_counts(df, "id", ["t"], "first", "last", "address", rules=rules)
    everywhere = [(n, "(?:)" + p, i) for n, p, i in P.NOTE_RESIDUALS]  # none that has known words
    got = count(P.NOTE_RESIDUALS)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, count(everywhere).collect()))
    assert all(S.note_report(got, "id").where("name <> 'known_address'").select(F.col("n") > 0).toPandas().iloc[:, 0])
    hits = lambda rules: {r["id"] for r in S.contextual_rows(df, "id", ["t"], rules=rules).collect()}
    assert hits(P.NOTE_RESIDUALS) == hits(everywhere)
    got.explain(True)
    plan = capsys.readouterr().out.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert all(f", {w})" in plan for needs in P.NOTE_NEEDS.values() for w in needs or ())


def test_known_values_in_any_letters(spark):
    each = lambda label, m: F.concat(F.lit("<"), label, F.lit(":"), m, F.lit(">"))
    rows = [("KIM ask Kim \u212aim", "kim"), ("kim", "\u212aIM"), ("Ası aſı", "ası"), ("ask mask", "ask"), ("none", "x"), ("a", ""), ("a", None), (None, "a"), ("é kim", "KIM")]
    df = spark.createDataFrame(rows, "t string, v string").withColumn("vs", F.array(F.struct(F.lit("L").alias("label"), F.col("v").alias("value"))))
    got = [r[0] for r in df.select(T.replaced_values(F.col("t"), F.col("vs"), each)).collect()]
    want = ["<L:KIM> ask <L:Kim> <L:\u212aim>", "<L:kim>", "<L:Ası> <L:aſı>", "<L:ask> mask", "none", "a", "a", None, "é <L:kim>"]
    assert got == want
    mine = lambda c: [r[0] for r in df.select(c).collect()]
    assert mine(T.without_known(F.col("t"))) == [t for t, _ in rows] and mine(T.unknown_tokens(F.col("t")))[:3] == [0, 0, 0]
