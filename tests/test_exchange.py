"""Files for and from an external processor, stores, trees and the gates of restoration."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from cloakspark.operators import rehydration as R
from cloakspark.operators import reports as S
from cloakspark.operators import trees as J
from cloakspark.operators.restoration import restored_json
from cloakspark.sources import exchange as E
from cloakspark.sources import handoff as H
from cloakspark.sources.policy import RunConfig

META = {"run_id": "r1", "policy_id": "p"}


def answered(spark, root, change=None, text="id,v\n1,a\n"):
    """Write what a processor would."""
    folder = f"{root}/inbound/structured/r1"
    E.write_text(spark, f"{folder}/out.csv", text)
    manifest = {"run_id": "r1", "domain": "structured", "status": "completed", "result_file": "out.csv", "result_sha256": E.content_hash(spark, f"{folder}/out.csv"), "output_records": 1}
    E.write_text(spark, f"{folder}/response_manifest.json", json.dumps(manifest | (change or {})))
    return folder


def test_request_and_response(spark, tmp_path):
    root, df = f"{tmp_path}/share", spark.createDataFrame([("1", 'a "q"'), ("2", "")], "id string, v string").repartition(2)
    config = RunConfig(timeout_seconds=5, poll_seconds=1)
    said, rows = E.exchanged(df, root, "structured", "r1", META, config, "handoff", sleep=lambda s: answered(spark, root))
    assert said["status"] == "processed" and said["output_records"] == 1 and [tuple(r) for r in rows.collect()] == [("1", "a")]
    out = f"{root}/outbound/structured/r1"
    request = E.read_json(spark, f"{out}/request_manifest.json")
    assert request["records"] == 2 and request["input_sha256"] == E.content_hash(spark, f"{out}/anonymized.csv") and not E.exists(spark, f"{out}/.writing")
    assert H.read_table(spark, f"{out}/anonymized.csv").count() == 2
    for change, wrong in (({"run_id": "x"}, "run_id"), ({"domain": "x"}, "domain"), ({"status": "failed"}, "status"), ({"result_file": "../out.csv"}, "result_file"), ({"result_file": "no.csv"}, "missing"), ({"result_sha256": "0"}, "sha256")):
        with pytest.raises(E.HandoffError, match=wrong):
            E.accepted(spark, answered(spark, root, change), "structured", "r1")
    clock = iter(range(0, 1000, 3))
    with pytest.raises(E.HandoffError):
        E.awaited(spark, root, "structured", "other", config, sleep=lambda s: None, clock=lambda: next(clock))


def test_other_ways(spark, tmp_path):
    df = spark.createDataFrame([("x",)], "value string")
    go = lambda way, **k: E.exchanged(df, f"{tmp_path}/s", "unstructured", "r1", META, RunConfig(wait_for_result=False), way, **k)
    assert go("skip")[0]["status"] == "skipped" and go("file_drop")[0]["records"] == 1 and go("handoff")[0]["handoff_directory"].endswith("unstructured/r1")
    assert go("call", call=lambda d: d)[1] is df
    with pytest.raises(ValueError):
        go("mail")


def test_writers_and_inputs(spark, tmp_path):
    df = spark.createDataFrame([(1, "a\nb\n"), (2, "")], "id long, text string")
    E.write_table(df.select("id"), f"{tmp_path}/t.csv", META)
    E.write_texts(df, "id", "text", f"{tmp_path}/texts", META)
    assert E.read_json(spark, f"{tmp_path}/t.csv.metadata.json")["artifact"] == "t.csv"
    assert {tuple(r) for r in E.read_texts(spark, f"{tmp_path}/texts", "long").collect()} == {(1, "a\nb\n"), (2, "")}
    many = spark.range(2500, numPartitions=1).selectExpr("id", "'x' text")
    E.write_texts(many, "id", "text", f"{tmp_path}/many", META, rows_per_file=1000)
    assert len(list((tmp_path / "many").glob("part-*"))) == 3 and E.read_texts(spark, f"{tmp_path}/many").count() == 2500
    E.write_report(spark, f"{tmp_path}/report.json", META, {"status": "passed"})
    assert E.read_json(spark, f"{tmp_path}/report.json")["status"] == "passed"
    with pytest.raises(FileNotFoundError):
        E.input_path(spark, str(tmp_path), "unstructured")
    (tmp_path / "a.log").write_text("x")
    assert E.logs_of(spark, str(tmp_path), f"{tmp_path}/none.log")[0].endswith("a.log") and E.logs_of(spark, str(tmp_path), f"{tmp_path}/a.log") == [f"{tmp_path}/a.log"]
    (tmp_path / "in.csv").write_text("id,n\n1,2.50\n2,\n")
    assert [tuple(r) for r in H.read_table_inferred(spark, f"{tmp_path}/in.csv").orderBy("id").collect()] == [("1", "2.5"), ("2", "nan")]


def test_mapping_stores(spark, tmp_path):
    rows, kept = spark.createDataFrame([("A_1", "x")], "placeholder string, original_value string"), []
    for stage in ("static", "final"):
        H.store_mapping(rows, "d", "r1", stage, "both", f"{tmp_path}/m", kept.append)
    assert len(kept) == 1 and H.read_mapping(spark, f"{tmp_path}/m", "d", "r1").first()["placeholder"] == "<A_1>"
    assert H.database_mapping(kept[0], "r1").first()["placeholder"] == "<A_1>"
    with pytest.raises(LookupError):
        H.database_mapping(kept[0], "r2")
    with pytest.raises(ValueError):
        H.store_mapping(rows, "d", "r1", "final", "elsewhere")


def test_values_of_trees(spark):
    text = '{"k <X_1>": "a <X_1> \\"q\\" \\u00e9", "n": [1, "<Y_2>", null, {"b" : ""}], "t": true}'
    df = spark.createDataFrame([(1, text), (2, None), (3, "[]")], "id long, j string")
    got = {r["id"]: r["v"] for r in df.select("id", J.string_values(F.col("j")).alias("v")).collect()}
    assert got == {1: ['a <X_1> "q" é', "<Y_2>", ""], 2: [], 3: []}
    mapping = spark.createDataFrame([("<X_1>", 'say "hi" \\ <Y_2>'), ("<Y_2>", "line\nbreak")], "placeholder string, original_value string")
    out = {r["id"]: (r["j"], r["passes"]) for r in restored_json(df, "id", "j", mapping).collect()}
    assert json.loads(out[1][0]) == {"k <X_1>": 'a say "hi" \\ line\nbreak "q" é', "n": [1, "line\nbreak", None, {"b": ""}], "t": True} and out[1][1] == 2
    assert out[2] == (None, 0) and out[3] == ("[]", 0)
    assert {r["placeholder"]: r["n"] for r in J.token_counts(df, "j").collect()} == {"<X_1>": 1, "<Y_2>": 1}


def test_gates_of_restoration(spark):
    mapping = spark.createDataFrame([("<A_1>", "x"), ("<B_1>", "<C_1>"), ("<C_1>", "<B_1>")], "placeholder string, original_value string")
    expected = spark.createDataFrame([("<A_1>", 1), ("<B_1>", 1), ("<Z_1>", 1)], "placeholder string, n long")

    def run(*payloads, read=lambda: mapping):
        rows = spark.createDataFrame(list(enumerate(payloads)), "id long, j string")
        return R.rehydrated(rows, "id", "j", expected, read)

    report, out = run('{"v": "<A_1>"}')
    assert report["status"] == "completed" and out.first()["j"] == '{"v": "x"}' and report["passes"] == 1
    assert run('["<A_1>", "<A_1>"]')[0]["reason"] == "unexpected_placeholders"
    assert run('["<B_1>"]')[0]["reason"] == "mapping_cycles" and run('["<Z_1>"]')[0]["reason"] == "unresolved_placeholders"
    never = lambda: pytest.fail("the mapping is read")
    assert run('{"status": "skipped"}', read=never)[0]["status"] == "not_run_external_processing_skipped"
    assert run("{}", '{"errorType": "x", "v": "<A_1>"}', read=never)[0]["third_party_status"] == "failed"
    assert run('{"v": 1}', read=never)[0]["status"] == "not_required_no_placeholders_returned"


def test_report_of_notes(spark):
    rows = [(0, "call ann LEE at 1 Oak Road", "<NAME_1111111111>", "Ann", "Lee", "1 Oak Road"), (1, "fine", "", "Bo", "", None), (2, "mail a@b.org, <<NAME_2222222222>>", None, None, None, "")]
    df = spark.createDataFrame(rows, "row_id long, a string, b string, first string, last string, address string")
    counts = S.note_counts(df, "row_id", ["a", "b"], "first", "last", "address", F.array(F.lit("<NAME_1111111111>")))
    report = {r["name"]: r["n"] for r in S.note_report(counts, "row_id").collect() if r["n"]}
    assert report == {"known_name": 1, "known_address": 1, "email": 1, "phone": 1, "malformed_placeholder": 1}
    assert sorted(r["row"] for r in S.affected_rows(counts, "row_id").collect()) == [1, 3]
    assert tuple(S.report_status(counts, "row_id").first()) == ("completed_with_warnings", 5, 2) and S.report_status(counts.limit(0), "row_id").first()["status"] == "passed"
