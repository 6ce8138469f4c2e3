"""The library against Python's re, known small cases and round trips."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from cloakspark.functions import patterns as P
from cloakspark.functions import text as T
from cloakspark.operators import mapping as M
from cloakspark.operators import masking as K
from cloakspark.operators import records as R
from cloakspark.operators import reports as S
from cloakspark.operators.cycles import cycles
from cloakspark.operators.numbering import greedy_batches
from cloakspark.operators.restoration import restored
from cloakspark.sources import handoff as H
from cloakspark.sources.session import checkpoint_folder
from cloakspark.streaming.masking import masked_files

RUN = "r"
TEXT = (
    "Log\n1. Customer Anna Bell (DOB 1980-03-15) mail a.b@mail.org card 4111 1111 1111 1111, account 123456789012\n"
    "2. Mr. Omar Said visited City Care Hospital, passport K1234567 PAN ABCDE1234F IFSC ABCD0123456 at 12 Oak Hill Street\n3. Anna Bell naïve café 98765 43210 é12345678901é"
)


def one(spark, column, **values):
    """The value of a column over one row."""
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("x")).first()["x"]


def counted(spark, name, text):
    df, found = S.with_findings(spark.createDataFrame([(text,)], "t string"), F.col("t"))
    return df.select(found[name]).first()[0]


def token(label, value):
    return f"<{label}_{hashlib.sha256(f'{RUN}|{label}|{re.sub(r"\s+", " ", value).strip()}'.encode()).hexdigest()[:10]}>"


def test_patterns_match_as_in_python(spark):
    text = TEXT
    for label, pattern in P.TEXT_PATTERNS:
        text = re.sub(pattern, lambda m, label=label: token(label, m[0]), text)
    df = spark.createDataFrame([(TEXT,)], "t string")
    assert K.masked_in_steps(df, "t", RUN).first()["t"] == text
    assert "<EMAIL_" in text and "<CREDIT_CARD_" in text and "<PAN_" in text


@pytest.mark.parametrize(("name", "pattern", "ignore"), P.TEXT_RESIDUALS)
def test_residuals_count_as_in_python(spark, name, pattern, ignore):
    samples = [TEXT, "", "Employee ID EMP-1234 of Acme Works Ltd transferred $12.50 and 30 pounds", "spouse of Ann, trip to Rome, thyroid ETF; job title. pt Jones; Dr. Lee attended. TXN 12A"]
    for s in samples:
        assert counted(spark, name, s) == len(re.findall(pattern, re.sub(P.PLACEHOLDER, "", s), re.IGNORECASE if ignore else 0))


def test_round_trip_and_integrity(spark):
    df = spark.createDataFrame([(1, TEXT), (2, "no value"), (3, ""), (4, TEXT + " x@y.org"), (5, None)], "id long, text string")
    masked = K.masked_in_steps(df, "text", RUN)
    mapping = M.first_seen(M.found_in(df, "id", "text", RUN))
    assert mapping.count() == len({r["placeholder"] for r in mapping.collect()}) > 5
    back = {r["id"]: r["text"] for r in restored(masked, "id", "text", mapping).collect()}
    assert back == {r["id"]: r["text"] for r in df.collect()}
    counts = M.token_counts(masked, "text")
    M.check_integrity(M.integrity(counts, M.token_counts(masked.where("id = 1"), "text")))
    with pytest.raises(M.IntegrityError):
        M.check_integrity(M.integrity(M.token_counts(masked.where("id = 1"), "text"), counts))
    with pytest.raises(M.IntegrityError):
        M.check_resolved(masked, "text")


def test_tokens(spark):
    assert one(spark, T.placeholder(RUN, "e mail!", F.col("v")), v=" a  b ") == "<E_MAIL_" + hashlib.sha256(b"r|E_MAIL|a b").hexdigest()[:10] + ">"
    assert one(spark, T.placeholder(RUN, "!", F.col("v")), v="x").startswith("<PII_")
    assert one(spark, T.without_known(F.col("v")), v="<<NAME_1111111111>> a <b>") == " a <b>"
    assert one(spark, T.unknown_tokens(F.col("v"), F.array(F.lit("<NAME_2222222222>"))), v="<<NAME_1111111111>>") == 1
    assert one(spark, T.bracketed(F.col("v")), v="A_1") == "<A_1>"
    assert [one(spark, T.only_tokens(F.col("v")), v=v) for v in ("<A_1>", "<A_1> <", "<A_1> x")] == [True, True, False]
    assert one(spark, T.stitched(F.col("t"), T.value_pattern(F.col("v")), lambda m: F.concat(F.lit("["), m, F.lit("]"))), t=r"a.b A.B ab xa.b $\E(", v="a.b") == r"[a.b] [A.B] ab xa.b $\E("
    assert one(spark, T.stitched(F.col("t"), T.value_pattern(F.col("v")), lambda m: F.lit("Z")), t=r"x $\E( y", v=r"$\E(") == "x Z y"
    assert one(spark, T.replaced_candidates(F.col("t"), F.col("c"), lambda m: F.lit("#")), t="Ann Lee and ann, Annie", c=["Ann", "Ann Lee"]) == "# and #, Annie"
    assert one(spark, T.stitched_outside(F.col("t"), F.lit("(?i)name"), lambda m: F.lit("#")), t="name <NAME_1> Name") == "# <NAME_1> #"


def test_collisions_get_new_tokens(spark):
    found = spark.createDataFrame([("A", str(k), k) for k in range(40)], "label string, raw string, ord int")
    rows = M.resolved_collisions(found, RUN, 2).collect()
    taken, want = set(), {}
    for k in range(40):  # in order of sight, each the first free token
        tries = (hashlib.sha256("|".join([RUN, "A", str(k), *([str(n)] if n else [])]).encode()).hexdigest()[:2] for n in range(300))
        want[str(k)] = next(t for t in tries if t not in taken)
        taken.add(want[str(k)])
    assert {r["norm"]: r["placeholder"] for r in rows} == {k: f"<A_{t}>" for k, t in want.items()} and len(taken) == 40
    with pytest.raises(ValueError):
        M.resolved_collisions(found, RUN, 1)
    assert len({r["placeholder"] for r in M.resolved_collisions(found, RUN).collect()}) == 40


def test_passes_and_cycles(spark):
    mapping = spark.createDataFrame([("<A_1>", "x <A_2>"), ("<A_2>", "y <A_3>"), ("<A_3>", "z"), ("<B_1>", "<B_2>"), ("<B_2>", "<B_1>"), ("<C_1>", "<C_1>")], "placeholder string, original_value string")
    df = spark.createDataFrame([(1, "<A_1>!"), (2, "plain")], "id long, text string")
    assert {(r["id"], r["text"], r["passes"]) for r in restored(df, "id", "text", mapping).collect()} == {(1, "x y z!", 3), (2, "plain", 0)}
    checkpoint_folder(spark)
    roots = spark.createDataFrame([("<A_1>",), ("<B_1>",)], "placeholder string")
    assert {r["placeholder"] for r in cycles(mapping, roots).collect()} == {"<B_1>", "<B_2>"}


def test_records_and_batches(spark):
    df = spark.createDataFrame([(1, "head\n1. a\nmore\n2. b"), (2, "1. a\n"), (3, "none"), (4, "")], "id long, text string")
    rows = R.split_records(df, "id", "text")
    assert {(r["id"], r["pos"], r["number"], r["text"]) for r in rows.collect()} == {(1, 0, None, "head\n"), (1, 1, 1, "1. a\nmore\n"), (1, 2, 2, "2. b"), (2, 1, 1, "1. a\n"), (3, 1, 1, "none"), (4, 0, None, "")}
    assert {r["id"]: r["text"] for r in R.joined_records(rows, "id").collect()} == {r["id"]: r["text"] for r in df.collect()}
    sizes = spark.createDataFrame([("g", k, s) for k, s in enumerate([5, 5, 20, 3, 3, 3])], "g string, k int, s int")
    assert [r["batch"] for r in greedy_batches(sizes, "g", "k", "s", 2, 10).orderBy("k").collect()] == [0, 0, 1, 2, 2, 3]
    many = spark.range(200_000).selectExpr("cast(id % 3 as string) g", "id k", "id % 7 s")
    got = greedy_batches(many, "g", "k", "s", 25, 60).groupBy("g", "batch").count().agg(F.max("count"), F.count("*")).first()
    assert got[0] <= 25 and got[1] > 8000
    texts = spark.createDataFrame([(1, " \n"), (2, "x\n 1. a\n\n2.  b \n"), (3, "plain")], "id long, text string")
    assert {(r["id"], r["number"], r["text"]) for r in R.bare_records(texts, "id", "text").collect()} == {(2, 1, "a"), (2, 2, "b"), (3, 1, "plain")}
    assert [r[0] for r in df.orderBy("id").select(R.record_count(F.col("text"))).collect()] == [2, 1, 1, 0]


def test_replies(spark):
    assert R.objects_in('```json\n{"A": ["}"]}\n``` {no} {"B": {"c": 1}}') == ['{"A": ["}"]}', '{"B": {"c": 1}}']
    with pytest.raises(ValueError):
        R.objects_in("nothing here {")
    df = spark.createDataFrame([(1, '{"A":["x", null]} junk {"A":["y","x"],"B":null,"C":1}'), (2, "none"), (3, None)], "id long, reply string")
    found = R.values_of_objects(R.parsed_replies(df, "reply"), ["id"], "objects")
    merged = {(r["id"], r["category"]): r["values"] for r in R.merged_detections(found, "id", "ord", "category", "value").collect()}
    assert merged == {(1, "A"): ["x", "y"], (1, "C"): ["1"]}


def test_lone_name_after_speaking(spark):
    df = spark.createDataFrame([(0, "after speaking with William."), (1, "<NAME_1111111111> is fine")], "row_id long, notes string")
    assert [r["row_id"] for r in S.contextual_rows(df, "row_id", ["notes"]).collect()] == [0]


def test_fidelity_and_risk(spark):
    a = spark.createDataFrame([(1, "1.0", "x"), (2, "2", "y")], "id int, n string, s string")
    b = spark.createDataFrame([(1, "1.00", "x"), (2, "2", "z")], "id int, n string, s string")
    assert S.fidelity(a, b, "id").first().asDict() == {"exact_field_fidelity": "50.0000%", "semantic_field_fidelity": "75.0000%", "fields_changed": "2", "rows_changed": "2"}
    assert S.fidelity(a, b.where("id = 1"), "id").first()["rows_changed"] == "Not applicable"
    df = spark.createDataFrame([("diagnosis",), ("credit card and email",), ("hello",)], "t string")
    assert [(r["score"], r["risk"], r["calculation"]) for r in S.privacy_risk(df, "t").collect()] == [(9, "Medium", "9"), (12, "High", "10 + 2"), (0, "Low", "0")]


def test_store_sources_and_ledger(spark, tmp_path):
    store = f"{tmp_path}/store"
    rows = spark.createDataFrame([("<A_1>", "x")], "placeholder string, original_value string")
    H.write_stage(rows, store, "d", "r1", "final")
    H.write_stage(rows.unionAll(rows), store, "d", "r2", "final")
    H.write_stage(rows, store, "d", "r2", "final")
    assert H.read_stage(spark, store, "d", "r2").count() == 1
    with pytest.raises(LookupError):
        H.read_stage(spark, store, "d", "none")
    (tmp_path / "a.csv").write_text('﻿id,name,note\n1,"A, ""B""",\n2,NA,x\n', encoding="utf-8")
    assert [tuple(r) for r in H.read_table(spark, f"{tmp_path}/a.csv").orderBy("id").collect()] == [("1", 'A, "B"', ""), ("2", "NA", "x")]
    assert H.newest_file(spark, f"{tmp_path}/a.csv").endswith("a.csv")
    logs = spark.createDataFrame([("a.log", "1"), ("b.log", "2")], "name string, sha256 string")
    ledger = spark.createDataFrame([(["a.log"],)], "included_logs array<string>")
    assert H.anchored(logs, ledger, "z").first()["included_logs"] == ["b.log"]
    assert H.anchored(logs, spark.createDataFrame([(["a.log", "b.log"],)], "included_logs array<string>"), "z").count() == 0


def test_encryption_round_trip(spark):
    rows = spark.createDataFrame([("<A_1>", "geheim ü"), ("<A_2>", "")], "placeholder string, original_value string")
    key = F.lit("0123456789abcdef").cast("binary")
    sealed = M.encrypted(rows.unionAll(rows), key, "k1")
    kept = sealed.collect()
    assert len({r["ciphertext"] for r in kept}) == len({r["wrapped_key"] for r in kept}) == 4 and {r["key_id"] for r in kept} == {"k1"}
    stored = spark.createDataFrame(kept, sealed.schema)
    assert {tuple(r) for r in M.decrypted(stored, key).collect()} == {tuple(r) for r in rows.collect()} and M.key_works(spark, key)
    with pytest.raises(Exception, match="no ciphertext for <A_1>"):
        M.decrypted(stored.withColumn("ciphertext", F.lit("{}")), key).collect()
    with pytest.raises(Exception, match="AES|aes|crypto"):
        M.decrypted(stored, F.lit("another key 1234").cast("binary")).collect()


def test_streamed_masking_equals_batch(spark, tmp_path):
    df = spark.createDataFrame([(k, f"{TEXT} {k}@mail.org") for k in range(5)], "id long, text string")
    df.write.parquet(f"{tmp_path}/in")
    query = masked_files(spark, f"{tmp_path}/in", df.schema, "text", RUN).writeStream.format("memory").queryName("masked").trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in spark.table("masked").collect()} == {tuple(r) for r in K.masked_in_steps(df, "text", RUN).collect()}


def test_all_queries_are_registered():
    import __spark_entry__ as entry

    core = entry._core()[0]
    assert set(core.ORACLES) <= set(core.QUERIES) and len(core.QUERIES) >= 40


def test_numbers_of_the_same_value(spark):
    from decimal import Decimal, InvalidOperation

    texts = ["1", "1.0", "+1", "01.", ".5", "0.50", "5e-1", "1E2", "100", "-0", "0.000", "", ".", "1.2.3", "x1", " 7 ", "7", "9" * 40, "9" * 40 + ".0", "9" * 39 + "8", "1e400", "10e399", "inf", "-Infinity", "nan", "-5", "5", "1e-400", "0e5", "--1"]
    df = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")

    def same(a, b):
        try:
            return Decimal(a) == Decimal(b)
        except InvalidOperation:
            return False

    got = {(r["a"], r["b"]): r["same"] for r in df.withColumn("same", F.coalesce(S.number_key(F.col("a")) == S.number_key(F.col("b")), F.lit(False))).collect()}
    assert got == {(a, b): same(a, b) for a in texts for b in texts}
