"""The residual counters over documents and pages, against Python's re."""

from __future__ import annotations

import re

import __spark_entry__
from cloakspark.functions import patterns as P

FOLDER = "/root/testdata/sf0.001"


def test_all_counters(spark):
    got = {r["name"]: r["n"] for r in __spark_entry__.queries()["residual_counts"](spark, FOLDER).collect()}
    tables = (("documents", "text"), ("pages", "html"))
    texts = [re.sub(P.PLACEHOLDER, "", r[0] or "") for t, c in tables for r in spark.read.parquet(f"{FOLDER}/{t}.parquet").select(c).collect()]
    want = {n: sum(len(re.findall(p, t, re.I if i else 0)) for t in texts) for n, p, i in P.TEXT_RESIDUALS}
    assert len(got) == 17 and {n: got[n] for n in want} == want and want["phone"] > 0
