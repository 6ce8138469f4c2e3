"""Tokens that run out, against the sequence."""

from __future__ import annotations

import hashlib

from cloakspark.operators import mapping as M


def test_more_values_than_tokens(spark):
    n, tries = 60, 5
    found = spark.createDataFrame([(label, str(k), k) for label in "AB" for k in range(n if label == "A" else 12)], "label string, raw string, ord int")
    for limit in (tries, 300):
        want, taken = {}, set()
        for label, k in [(x, k) for k in range(n) for x in "AB" if x == "A" or k < 12]:
            tokens = (f"<{label}_{hashlib.sha256('|'.join(['r', label, str(k), *([str(i)] if i else [])]).encode()).hexdigest()[:1]}>" for i in range(limit))
            want[label, str(k)] = next((t for t in tokens if t not in taken), None)
            taken.add(want[label, str(k)])
        rows = M.resolved_collisions(found, "r", 1, limit).collect()
        assert len(rows) == n + 12 and {(r["label"], r["norm"]): r["placeholder"] for r in rows} == want
        assert None in want.values() and len(taken) > 16
