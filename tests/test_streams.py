"""Streams against one run over everything, with restarts; responses with good, wrong and late manifests."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from cloakspark.functions import text as T
from cloakspark.operators import mapping as M
from cloakspark.operators import masking as K
from cloakspark.sources import exchange as E
from cloakspark.sources import handoff as H
from cloakspark.streaming import mapping as S
from cloakspark.streaming import responses as R
from cloakspark.streaming.masking import mask_available

RUN = "r"
DOCS = "id long, text string"


def arrived(spark, folder, rows):
    spark.createDataFrame(rows, DOCS).coalesce(1).write.mode("append").parquet(folder)


def stream(spark, tmp_path, digits=10):
    at = str(tmp_path)
    S.mask_stream(spark, f"{at}/in", spark.createDataFrame([], DOCS).schema, "id", "text", RUN, f"{at}/out", f"{at}/store", f"{at}/checkpoint", 1, digits).awaitTermination()
    return spark.read.parquet(f"{at}/out"), spark.read.parquet(f"{at}/store")


def settled_in_order(values, digits):
    """Of (label, norm) in order of sight, each the first free token."""
    taken, out = set(), {}
    for label, norm in values:
        if (label, norm) not in out:
            n = 0
            while (t := f"<{label}_{hashlib.sha256('|'.join([RUN, label, norm, *([str(n)] if n else [])]).encode()).hexdigest()[:digits]}>") in taken:
                n += 1
            taken.add(t)
            out[label, norm] = t
    return out


def test_values_are_first_seen_over_the_whole_stream(spark, tmp_path):
    parts = [[(1, "mail a@x.org and b@x.org"), (2, None)], [(3, "mail c@x.org, a@x.org"), (4, "none")], [(5, "b@x.org d@x.org")]]
    for k, part in enumerate(parts):
        arrived(spark, f"{tmp_path}/in", part)
        if k == 1:
            stream(spark, tmp_path)
    out, store = stream(spark, tmp_path)
    whole = spark.createDataFrame([r for p in parts for r in p], DOCS)
    assert {(r["id"], r["text"]) for r in out.collect()} == {tuple(r) for r in K.masked_in_steps(whole, "text", RUN).collect()}
    want = {(r["placeholder"], r["original_value"]) for r in M.first_seen(M.found_in(whole, "id", "text", RUN)).collect()}
    assert {(r["placeholder"], r["raw"]) for r in store.collect()} == want and store.count() == len(want)
    before = sorted(map(str, out.collect()))
    out, _ = stream(spark, tmp_path)  # nothing new: a restart changes nothing
    assert sorted(map(str, out.collect())) == before


def test_colliding_values_get_tokens_of_their_own(spark, tmp_path):
    mails = [f"u{k}@x.org" for k in range(12)]
    parts = [[(100 * b + k, f"to {mails[(5 * b + k) % 12]}") for k in range(8)] for b in range(3)]
    for part in parts:
        arrived(spark, f"{tmp_path}/in", part)
        out, store = stream(spark, tmp_path, digits=1)
    want = settled_in_order([("EMAIL", t.split()[1]) for part in parts for _, t in part], 1)
    got = {(r["label"], r["norm"]): r["placeholder"] for r in store.collect()}
    assert len(set(got.values())) == len(got) == store.count()
    assert got == want
    with pytest.raises(ValueError):
        S.settled(spark.createDataFrame([("A", str(k), k) for k in range(17)], "label string, raw string, ord int"), store.limit(0).select(*[c for c in store.columns if c != "epoch"]), RUN, 1)
    assert {(r["id"], r["text"]) for r in out.collect()} == {(i, f"to {got['EMAIL', t.split()[1]]}") for p in parts for i, t in p}


def test_a_batch_done_again_writes_the_same(spark, tmp_path):
    known = spark.createDataFrame([("EMAIL", "a@x.org", "a@x.org", "<EMAIL_1>", "<EMAIL_1>")], S.STATE)
    S.write_epoch(known, f"{tmp_path}/store", 0)
    S.write_epoch(known.withColumn("norm", F.lit("later")), f"{tmp_path}/store", 5)
    assert [r["norm"] for r in S.known_before(spark, f"{tmp_path}/store", 5).collect()] == ["a@x.org"]
    assert S.known_before(spark, f"{tmp_path}/store", 0).count() == 0 == S.known_before(spark, f"{tmp_path}/none", 3).count()
    found = spark.createDataFrame([("EMAIL", "a@x.org", 1), ("EMAIL", "z@x.org", 2), ("EMAIL", "z@x.org", 3)], "label string, raw string, ord int")
    first, second = (sorted(map(str, S.settled(found, S.known_before(spark, f"{tmp_path}/store", 5), RUN).collect())) for _ in range(2))
    assert first == second and len(first) == 1 and "z@x.org" in first[0]


def test_settled_equals_a_walk(spark):
    rng = random.Random(2)
    values = [f"v{rng.randrange(40)}" for _ in range(120)]
    want = settled_in_order([("A", v) for v in values], 2)
    known = spark.createDataFrame([], S.STATE)
    for b in range(3):
        found = spark.createDataFrame([("a", v, 40 * b + k) for k, v in enumerate(values[40 * b : 40 * b + 40])], "label string, raw string, ord int")
        known = spark.createDataFrame(known.unionByName(S.settled(found, known, RUN, 2)).collect(), S.STATE)
    assert {(r["label"], r["norm"]): r["placeholder"] for r in known.collect()} == want


def test_available_files_are_masked(spark, tmp_path):
    arrived(spark, f"{tmp_path}/in", [(1, "a@x.org"), (2, "none")])
    at = str(tmp_path)
    mask_available(spark, f"{at}/in", spark.createDataFrame([], DOCS).schema, "id", "text", RUN, f"{at}/out", f"{at}/store", f"{at}/checkpoint").awaitTermination()
    assert {r["text"] for r in spark.read.parquet(f"{at}/out").collect()} == {spark.range(1).select(T.placeholder(RUN, "EMAIL", F.lit("a@x.org"))).first()[0], "none"}
    assert spark.read.parquet(f"{at}/store").count() == 1


def respond(spark, root, domain, run, change=None, text="id,v\n1,a\n", manifest=True):
    folder = f"{root}/inbound/{domain}/{run}"
    E.write_text(spark, f"{folder}/out.csv", text)
    said = {"run_id": run, "domain": domain, "status": "completed", "result_file": "out.csv", "result_sha256": hashlib.sha256(text.encode()).hexdigest(), "output_records": 1}
    if manifest:
        E.write_text(spark, f"{folder}/response_manifest.json", change if isinstance(change, str) else json.dumps(said | (change or {})))


def test_responses_go_two_ways_once(spark, tmp_path):
    root = f"{tmp_path}/share"
    respond(spark, root, "structured", "good")
    respond(spark, root, "unstructured", "text", {"processor": "p"})
    for run, change in [("status", {"status": "failed"}), ("sha256", {"result_sha256": "0"}), ("missing", {"result_file": "none.csv"}), ("result_file", {"result_file": "../x"}), ("run_id", "no json"), ("domain", {"domain": "text"})]:
        respond(spark, root, "structured", run, change)
    respond(spark, root, "structured", "late", manifest=False)
    at = str(tmp_path)

    def go():
        R.sorted_responses(spark, root, f"{at}/good", f"{at}/bad", f"{at}/checkpoint", 3).awaitTermination()
        return {r["own_run"] for r in spark.read.parquet(f"{at}/good").collect()}, {(r["own_run"], r["error"]) for r in spark.read.parquet(f"{at}/bad").collect()}

    good, bad = go()
    assert good == {"good", "text"} and bad == {(e, e) for e in ("status", "sha256", "missing", "result_file", "run_id", "domain")}
    respond(spark, root, "structured", "late")
    good, again = go()
    assert good == {"good", "text", "late"} and again == bad and spark.read.parquet(f"{at}/good").count() == 3
    row = spark.read.parquet(f"{at}/good").where("own_run = 'late'").first()
    assert [tuple(r) for r in R.result_rows(spark, row["own_domain"], row["result_path"]).collect()] == [("1", "a")]


def test_hashes_of_files_longer_than_a_piece(spark, tmp_path, monkeypatch):
    rng = random.Random(1)
    (tmp_path / "f").mkdir()
    data = {f"f/{k} x.bin": rng.randbytes(n) for k, n in enumerate([5, 10, 25_000_000])}
    for name, d in data.items():
        (tmp_path / name).write_bytes(d)
    want = {name.split("/")[1]: hashlib.sha256(d).hexdigest() for name, d in data.items()}
    assert {r["name"]: r["sha256"] for r in H.file_hashes(spark, f"{tmp_path}/f").collect()} == want
    whole = hashlib.sha256("".join(want[n] for n in sorted(want)).encode()).hexdigest()
    assert E.content_hash(spark, f"{tmp_path}/f") == whole == H.content_digest(f"file:{tmp_path}/f")
    assert E.content_hash(spark, f"{tmp_path}/f/1 x.bin") == want["1 x.bin"] and E.content_hash(spark, f"{tmp_path}/g") is None is H.content_digest(f"file:{tmp_path}/g")
    monkeypatch.setattr(H, "OPENED", ())
    assert {r["name"]: r["sha256"] for r in H.file_hashes(spark, f"{tmp_path}/f").collect()} == want


def test_verified_entries(spark):
    ledger = spark.createDataFrame([("a.zip", "1"), ("b.zip", "2"), ("c.zip", "3")], "zip_name string, sha256 string")
    files = spark.createDataFrame([("a.zip", "1"), ("b.zip", "0")], "name string, sha256 string")
    assert {tuple(r) for r in H.verified(ledger, files).collect()} == {("a.zip", True), ("b.zip", False), ("c.zip", False)}


@pytest.mark.parametrize("encrypt", [False, True])
def test_runs_count_what_they_write(spark, tmp_path, encrypt):
    from cloakspark.sources.policy import RunConfig
    from cloakspark.sources.runs import Run, masked_run, restored_run, run_log

    key = F.lit("0123456789abcdef").cast("binary")
    run = Run(spark, "unstructured", f"{tmp_path}/run", RunConfig(encrypt_mapping=encrypt, mapping_key_id="k"), "r7", {"policy_id": "p"})
    docs = spark.createDataFrame([(1, "a@x.org b@x.org"), (2, "a@x.org"), (3, None)], DOCS)
    with run_log(spark, f"{tmp_path}/logs", "unstructured", "r7") as path:
        masked, metrics = masked_run(run, docs, "id", "text", key)
    assert (metrics["Records"], metrics["Sensitive values detected"], metrics["Mappings created"], metrics["Expected placeholders"]) == (3, 3, 2, 3)
    assert E.read_json(spark, f"{tmp_path}/run/metrics_r7.json")["metrics"]["Records"] == 3 and E.read_json(spark, f"{tmp_path}/run/traced.metadata.json")["policy_id"] == "p"
    lines = (tmp_path / "logs").joinpath(path.rpartition("/")[2]).read_text().splitlines()
    assert "begins" in lines[0] and lines[-1].endswith("ends") and any("static took" in line for line in lines)
    payloads = masked.where("text is not null").select("id", F.to_json(F.struct("text")).alias("j"))
    back = Run(spark, "unstructured", f"{tmp_path}/run", run.config, "r7")
    rows, said = restored_run(back, payloads, "id", "j", M.token_counts(masked, "text"), key)
    assert {json.loads(r["j"])["text"] for r in rows.collect()} == {"a@x.org b@x.org", "a@x.org"}
    assert (said["Records"], said["Returned placeholders"], said["Rehydration passes"], said["Placeholder restoration fidelity"]) == (2, 2, 1, "100%")
    kept = spark.read.parquet(f"{tmp_path}/run/mapping")
    assert ("ciphertext" in kept.columns) == encrypt
    quiet = Run(spark, "unstructured", f"{tmp_path}/quiet", RunConfig(metrics=False, provenance=False), "r8")
    assert masked_run(quiet, docs, "id", "text")[1] == {} and not list((tmp_path / "quiet").glob("*.json"))
    with pytest.raises(ValueError):
        Run(spark, "x", str(tmp_path), RunConfig(encrypt_mapping=True)).keep_mapping(kept, "final")


def test_a_failed_run_is_logged(spark, tmp_path):
    from cloakspark.sources.runs import run_log

    with pytest.raises(KeyError), run_log(spark, f"{tmp_path}/logs", "d", "r"):
        raise KeyError("x")
    assert "fails: KeyError" in next((tmp_path / "logs").glob("*.log")).read_text()
