"""Cycles of any length, and nothing but cycles."""

from __future__ import annotations

import pytest

from cloakspark.operators import cycles


def ring(n, name):
    token = [f"<{name}_{i}>" for i in range(n)]
    return token, [(token[i], f"see {token[(i + 1) % n]}") for i in range(n)]


@pytest.mark.parametrize("length", [2, 40, 100])
def test_cycles_are_found_whole(spark, length):
    token, rows = ring(length, "RING")
    other, more = ring(3, "OTHER")
    rows += more + [("<IN_1>", token[0]), ("<BRIDGE_1>", f"to {other[0]}"), ("<LEAF_1>", "plain")]
    rows[0] = (rows[0][0], rows[0][1] + " and <BRIDGE_1>")  # a path from one cycle to another is on neither
    m = spark.createDataFrame(rows, "placeholder string, original_value string")
    some = m.where("placeholder like '%0>'").select("placeholder")
    assert {r["placeholder"] for r in cycles.cycles(m, some).collect()} == {*token, *other}
    assert cycles.cycles(m, m.where("placeholder = '<LEAF_1>'").select("placeholder")).count() == 0
