"""Batches of a detector are dealt out over tasks, and records are carried through their packing."""

from __future__ import annotations

import json
import uuid

from pyspark import TaskContext
from pyspark.sql import functions as F

from cloakspark.operators import detection as D
from cloakspark.operators import numbering as N
from cloakspark.operators import records as R
from cloakspark.sources.policy import RunConfig


def test_small_batches_are_more_than_one_task(spark, tmp_path):
    def detector(said):
        (tmp_path / f"{TaskContext.get().partitionId()}-{uuid.uuid4().hex}").write_text(said)
        return json.dumps({"names": ["Lee", "Mia"] if "before" in said else ["Lee"]})

    rows = spark.createDataFrame([(k, f"row {k} Lee Mia") for k in range(40)], "k long, t string")
    out = D.two_phases(rows, "k", "t", "r", detector, lambda df: df.where(F.col("t").contains("Mia")), RunConfig(batch_size=2, delay_seconds=0.0), applied="did")
    got = out.collect()
    assert len(got) == 40 and all("Lee" not in r["t"] and "Mia" not in r["t"] and [d["value"] for d in r["did"]] == ["Lee", "Mia"] for r in got)
    calls = [p.name.split("-")[0] for p in tmp_path.iterdir()]
    assert len(calls) == 40 and len(set(calls)) > 1


def test_packing_keeps_each_record_once(spark, monkeypatch):
    rows = spark.createDataFrame([("g", 1, "aa"), ("g", 1, "b"), ("g", None, "c"), (None, 2, None), ("h", 1, "aa")], "g string, k long, t string")
    want = sorted(map(str, rows.select("k", "g", "t").collect()))
    for size in (N.SIZE_A_PART, 1):
        monkeypatch.setattr(N, "SIZE_A_PART", size)
        got = D.packed_batches(rows, "g", "k", "t", 2, 100)
        assert got.columns == ["k", "g", "t", "batch_id"] and sorted(map(str, got.select("k", "g", "t").collect())) == want
        assert got.groupBy("batch_id").count().agg(F.max("count"), F.count("*")).first() == (2, 4)


def test_repeated_detections_in_one_batch(spark):
    rows = spark.createDataFrame([(1, "Lee and lee EMP-1234"), (2, "Lee"), (3, None)], "b long, t string")
    found = spark.createDataFrame([(1, "names", "Lee"), (1, "NAME", " Lee "), (1, "names", "Lee"), (1, "ref", "EMP-1234"), (1, "names", None), (3, "names", "x y")], "b long, category string, value string")
    for tasks in (None, 3):
        out = {r["b"]: r for r in R.applied_detections(rows, found, "b", "t", "r", applied="did", tasks=tasks).collect()}
        assert [tuple(d) for d in out[1]["did"]] == [("NAME", "Lee"), ("REF", "EMP-1234")] and "<EMPLOYEE_ID_" in out[1]["t"] and "ee" not in out[1]["t"].replace("EMPLOYEE", "")
        assert (out[2]["t"], out[2]["did"], out[3]["t"]) == ("Lee", [], None)
