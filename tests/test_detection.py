"""Detectors, replies, policy, metrics and audit."""

from __future__ import annotations

import json
import uuid

import pytest
from pyspark.sql import functions as F

from cloakspark.operators import detection as D
from cloakspark.operators.reports import contextual_rows
from cloakspark.sources import audit as A
from cloakspark.sources import handoff as H
from cloakspark.sources import policy as C

POLICY = {"structured": {"static_fields": [{"field": "a", "label": "A"}], "dynamic_fields": []}, "unstructured": {"regex_patterns": {}}}
LIFECYCLE = {"policy_id": "p", "version": "1", "status": "active", "runtime_flags": {}, "mapping_storage": {"mode": "both"}}


def test_malformed_reply_is_asked_again():
    replies = iter(["nothing", '{"NAME": ["William"]}'])
    assert D.called(lambda p: next(replies), "x") == ['{"NAME": ["William"]}']
    with pytest.raises(ValueError):
        D.called(lambda p: "nothing", "x")


def test_transient_errors_wait():
    waits, calls = [], iter([TimeoutError(), ConnectionError(), None])

    def detector(prompt):
        if error := next(calls):
            raise error
        return "{}"

    assert D.called(detector, "x", sleep=waits.append) == ["{}"] and len(waits) == 2 and waits[1] > 10
    with pytest.raises(RuntimeError):
        D.called(lambda p: (_ for _ in ()).throw(RuntimeError()), "x")


def test_malformed_batches_are_split():
    detector = lambda p: "no" if len(json.loads(p)["records"]) > 2 else json.dumps({"N": [r["text"] for r in json.loads(p)["records"]]})
    found = [json.loads(o)["N"] for o in D.bisected(detector, [{"record_number": k, "text": f"t{k}"} for k in range(5)])]
    assert [v for vs in found for v in vs] == [f"t{k}" for k in range(5)]
    with pytest.raises(ValueError):
        list(D.bisected(lambda p: "no", [{"text": "x"}]))


def test_prompts_and_formats(spark):
    df = spark.createDataFrame([(1, "x", "nan", "<A_1>", None)], "k long, a string, b string, c string, d string")
    row = json.loads(df.select(F.to_json(D.note_rows("k", ["a", "b", "c", "d"]))).first()[0])
    assert row == {"row": 1, "fields": {"a": "x"}} and "standalone aliases" in D.prompt([row], D.RECOVERY_TASK)
    assert D.request_body("u", C.RunConfig(model="m"))["model"] == "m" and D.request_body("u", C.RunConfig(request_format="text"), "s")["prompt"] == "s\n\nu"
    assert D.reply_text({"choices": [{"message": {"content": "x"}}]}, "openai_chat") == "x" and D.reply_text({"output": 1}, "text") == "1" and D.reply_text("t", "raw_text") == "t" and D.reply_text([1], "json") == "[1]"
    for bad in (({}, "openai_chat"), ({"choices": []}, "openai_chat"), ({}, "text"), ({}, "other")):
        with pytest.raises(ValueError):
            D.reply_text(*bad)
    with pytest.raises(ValueError):
        D.detector_of(C.RunConfig(provider="nobody", detector_url="x"))
    assert D.detector_of(C.RunConfig(detector_url="http://x")).url == "http://x"


def counting(folder, values):
    """A detector that leaves a file per call."""
    inner = D.dictionary_detector(values)

    def detector(said):
        (folder / uuid.uuid4().hex).write_text(said)
        return inner(said)

    return detector


def test_two_phases(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"row {k} met with Jordan, ref <NAME_x>. Lee") for k in range(50)], "row_id long, notes string")
    detector = counting(tmp_path, {"companies": [], "money": ["Jordan"], "names": ["Lee"]})
    out = D.two_phases(rows, "row_id", "notes", "r", detector, lambda df: contextual_rows(df, "row_id", ["notes"]))
    assert out.count() == 50 and out.where(F.col("notes").contains("Jordan") | F.col("notes").contains("Lee")).count() == 0
    assert out.where(F.col("notes").contains("<NAME_x>") & F.col("notes").contains("<CURRENCY_AMOUNT_")).count() == 50
    assert len(list(tmp_path.iterdir())) == 2  # a call per batch, however often the result is read


def test_note_phases(spark, tmp_path):
    rows = spark.createDataFrame([(k, f"spoke to William{k}.", "spoke with Mia, then" if k == 3 else None, "out") for k in range(30)], "row_id long, a string, b string, c string")
    calls = counting(tmp_path, {"person names": [f"William{k}" for k in range(30)]})
    second = lambda said: json.dumps({"names": ["Mia"]}) if "standalone" in said else calls(said)
    out = D.note_phases(rows, "row_id", ["a", "b", "missing"], "r", second).orderBy("row_id").collect()
    assert all(r["a"].startswith("spoke to <NAME_") and r["c"] == "out" for r in out) and out[3]["b"].startswith("spoke with <NAME_") and out[4]["b"] is None
    assert len(list(tmp_path.iterdir())) == 2 and D.note_phases(rows, "row_id", ["missing"], "r", second) is rows


def test_policy_and_config():
    policy = C.Policy(POLICY, LIFECYCLE)
    assert policy.digest == C.Policy(dict(reversed(POLICY.items())), LIFECYCLE).digest and policy.metadata("r")["policy_id"] == "p"
    for change in ({"status": "draft"}, {"mapping_storage": {"mode": "x"}}, {"mapping_security": {"encryption_provider": "x"}}):
        with pytest.raises(ValueError):
            C.Policy(POLICY, LIFECYCLE | change)
    with pytest.raises(ValueError):
        C.Policy({"structured": {}}, LIFECYCLE)
    assert len(C.faults({}, {})) > 8 and "lifecycle.status must be active" in C.faults(POLICY, LIFECYCLE | {"status": "x"})
    nested = C.RunConfig.load({"external_processing": {"mode": "skip", "poll_interval_seconds": 3}, "rehydration": {"max_passes": 9}}, {})
    assert (nested.external_mode, nested.poll_seconds, nested.max_rehydration_passes) == ("skip", 3.0, 9)
    assert C.in_context(r"(?P<p>a[)(]\()(?P<v>b(?:c)+)(?P<s>d)", "v") == (r"(?:a[)(]\()", "b(?:c)+", "(?:d)")
    config = C.RunConfig.load({"batch_size": 7, "max_rehydration_passes": 0}, {"CLOAKSPARK_BATCH_SIZE": "9", "CLOAKSPARK_ENCRYPT_MAPPING": "Yes"})
    assert (config.batch_size, config.max_rehydration_passes, config.encrypt_mapping) == (9, 1, True)


def test_metrics_and_audit(spark, tmp_path):
    m = A.run_metrics({"Records": 1}, {"anonymization": 2.0, "rehydration": 3.0})
    assert m["Core rehydration (excluding mapping retrieval)"] == "3.000s" and "Rehydration" not in m and m["Placeholder restoration fidelity"] == "100%"
    assert A.restoration_fidelity("skipped", 0, 0) == "Not applicable" and A.restoration_fidelity("processed", 1, 0) == "Incomplete"
    (tmp_path / "a.log").write_text("x")
    full = A.run_metrics({"passes": 2, "unresolved": 1}, {"static": 1.5}, fidelity={"rows_changed": "3"})
    assert full["Rehydration passes"] == 2 and full["Static anonymization"] == "1.500s" and full["Rows changed"] == "3" and full["Placeholder restoration fidelity"] == "Incomplete"
    ticks = iter(range(100))
    watch = A.Stopwatch(lambda: next(ticks))
    for name in ("static", "dynamic", "waits", "static"):
        with watch.phase(name):
            pass
    assert watch.seconds["static"] == 2 and watch.without_waits("static", "dynamic") == 2
    bundle = A.bundled([str(tmp_path / "a.log")], str(tmp_path / "z.zip"))
    entry = A.ledger_entry(bundle, {"run_id": "r"}, "structured", C.RunConfig(anchor_ledger=True), lambda digest: {"tx_hash": "t" + digest, "block_number": 1})
    assert entry["blockchain_tx_hash"] == "t" + bundle["sha256"] and entry["included_logs"] == ["a.log"]
    A.appended(spark, f"{tmp_path}/ledger", entry)
    A.appended(spark, f"{tmp_path}/ledger", entry | {"zip_name": "gone.zip"})
    got = A.audited(spark.read.parquet(f"{tmp_path}/ledger"), H.file_hashes(spark, f"{tmp_path}/z.zip"))
    assert {tuple(r) for r in got.collect()} == {("z.zip", True, True), ("gone.zip", False, False)}
    A.write_metrics(spark, m, {"run_id": "r"}, f"{tmp_path}/m")
    assert json.loads((tmp_path / "m.json").read_text())["metrics"]["Records"] == 1
    A.record_artifact(spark, f"{tmp_path}/artifacts", "m.json", {"run_id": "r"})
    assert spark.read.parquet(f"{tmp_path}/artifacts").count() == 1
