"""Restoration and cycles against plain loops over small mappings, and on long chains."""

from __future__ import annotations

import json
import random
import re

import pytest

from cloakspark.functions import patterns as P
from cloakspark.operators import cycles as C
from cloakspark.operators import restoration as R

TOKEN = re.compile(P.PLACEHOLDER)
SCHEMA = "placeholder string, original_value string"


def in_passes(text, mapping, most):
    """The text after passes over it, and how many changed it."""
    for n in range(most):
        new = TOKEN.sub(lambda m: mapping.get(m[0], m[0]), text)
        if new == text:
            return text, n
        text = new
    return text, most


def in_tree(value, mapping, most):
    if isinstance(value, dict):
        done = {k: in_tree(v, mapping, most) for k, v in value.items()}
        return {k: v for k, (v, _) in done.items()}, max((n for _, n in done.values()), default=0)
    if isinstance(value, list):
        done = [in_tree(v, mapping, most) for v in value]
        return [v for v, _ in done], max((n for _, n in done), default=0)
    return in_passes(value, mapping, most) if isinstance(value, str) else (value, 0)


def random_mapping(rng, n, odd):
    """Values of text and tokens; odd ones with cycles, tokens of their own, and brackets left open."""
    pieces = [" ", "x", "value ", 'q"', "\\", "\n", "é"] + (["<", ">", "<T_", "1>", "_"] if odd else [])
    out = {}
    for k in range(n):
        inner = [f"<T_{rng.randrange(n if odd else max(k, 1)) if k or odd else 'none'}>" for _ in range(rng.choice([0, 0, 1, 1, 2]))]
        out[f"<T_{k}>"] = "".join(rng.sample(inner + rng.choices(pieces, k=2), len(inner) + 2))
    return out


def random_texts(rng, n, many, odd):
    pieces = [" see ", ".", "", "<X_1>", "\n"] + (["<", "<T_", ">", "0>"] if odd else [])
    return ["".join(rng.choice(pieces) + (f"<T_{rng.randrange(n)}>" if rng.random() < 0.6 else "") for _ in range(rng.randrange(5))) for _ in range(many)]


@pytest.mark.parametrize(("seed", "odd", "most"), [(1, False, 5), (2, True, 5), (3, True, 3), (4, True, 1), (5, False, 2), (6, True, 8)])
def test_restored_equals_passes(spark, seed, odd, most):
    rng = random.Random(seed)
    mapping = random_mapping(rng, 25, odd)
    texts = random_texts(rng, 25, 120, odd)
    known = spark.createDataFrame(list(mapping.items()), SCHEMA)
    # ids repeat and are null
    df = spark.createDataFrame([(k % 7 if k % 5 else None, t) for k, t in enumerate(texts)] + [(1, None)], "id long, text string")
    got = sorted([tuple(r) for r in R.restored(df, "id", "text", known, most).collect()], key=str)
    want = [(k % 7 if k % 5 else None, *in_passes(t, mapping, most)) for k, t in enumerate(texts)] + [(1, None, 0)]
    assert got == sorted(want, key=str)


@pytest.mark.parametrize(("seed", "odd"), [(7, False), (8, True)])
def test_restored_json_equals_passes(spark, seed, odd):
    rng = random.Random(seed)
    mapping = random_mapping(rng, 15, odd)
    texts = random_texts(rng, 15, 60, odd)
    trees = [{"a": t, "<T_1>": [texts[k - 1], k, {"b": texts[k - 2], "c": None}]} for k, t in enumerate(texts)]
    df = spark.createDataFrame([(k % 4, json.dumps(t)) for k, t in enumerate(trees)] + [(None, None), (2, "[]")], "id long, j string")
    got = sorted([(r["id"], None if r["j"] is None else json.loads(r["j"]), r["passes"]) for r in R.restored_json(df, "id", "j", spark.createDataFrame(list(mapping.items()), SCHEMA)).collect()], key=str)
    want = [(k % 4, *in_tree(t, mapping, 5)) for k, t in enumerate(trees)] + [(None, None, 0), (2, [], 0)]
    assert got == sorted(want, key=str)


def test_values_that_would_grow_too_long_stay_in_the_texts(spark, monkeypatch):
    monkeypatch.setattr(R, "LONGEST", 40)
    mapping = {f"<A_{k}>": f"<A_{k + 1}><A_{k + 1}>" for k in range(4)} | {"<A_4>": "0123456789"}
    known = spark.createDataFrame(list(mapping.items()), SCHEMA)
    df = spark.createDataFrame([(k, f"<A_{k}>") for k in range(5)], "id long, text string")
    assert {(r["id"], r["text"], r["passes"]) for r in R.restored(df, "id", "text", known).collect()} == {(k, "0123456789" * 2 ** (4 - k), 5 - k) for k in range(5)}


def test_empty_inputs(spark):
    none = spark.createDataFrame([], SCHEMA)
    df = spark.createDataFrame([(1, "<A_1>"), (2, "")], "id long, text string")
    assert {tuple(r) for r in R.restored(df, "id", "text", none).collect()} == {(1, "<A_1>", 0), (2, "", 0)}
    assert R.restored(df.limit(0), "id", "text", none).count() == 0
    nulls = spark.createDataFrame([("<A_1>", None), (None, "x"), ("<A_2>", "<A_1>")], SCHEMA)
    assert {tuple(r) for r in R.restored(df, "id", "text", nulls).collect()} == {(1, "<A_1>", 0), (2, "", 0)}
    assert C.cycles(none, none.select("placeholder")).count() == 0


def plain_cycles(mapping, roots):
    ways = {k: {t for t in TOKEN.findall(v) if t in mapping} for k, v in mapping.items()}

    def after(start):
        seen, todo = set(), list(start)
        while todo:
            for t in ways.get(todo.pop(), ()):
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return seen

    reached = after(roots) | (set(roots) & set(mapping))
    return {t for t in reached if t in after([t])}


@pytest.mark.parametrize("seed", range(6))
def test_cycles_equal_plain_search(spark, seed):
    rng = random.Random(seed)
    n = 40
    mapping = {f"<T_{k}>": " ".join(f"<T_{rng.randrange(n + 5)}>" for _ in range(rng.choice([0, 1, 1, 1, 2] if seed % 2 else [0, 1, 1, 2, 3]))) for k in range(n)}
    roots = [f"<T_{rng.randrange(n + 3)}>" for _ in range(3)]
    got = C.cycles(spark.createDataFrame(list(mapping.items()), SCHEMA), spark.createDataFrame([(r,) for r in roots], "placeholder string"))
    assert {r["placeholder"] for r in got.collect()} == plain_cycles(mapping, roots)


def long_ones(spark, n):
    chain = spark.range(n).selectExpr("concat('<A_', id, '>') placeholder", "concat('x <A_', id + 1, '>') original_value")
    ring = spark.range(n).selectExpr("concat('<B_', id, '>') placeholder", f"concat('<B_', (id + 1) % {n}, '>') original_value")
    ends = spark.createDataFrame([("<C_1>", "<A_0> and <B_17>"), ("<C_2>", "<A_5> or <C_2>")], SCHEMA)
    return chain.union(ring).union(ends).repartition(3)


def test_a_chain_and_a_cycle_of_100000(spark):
    got = C.cycles(long_ones(spark, 100_000), spark.createDataFrame([("<C_1>",), ("<A_3>",)], "placeholder string"))
    assert got.count() == 100_000 and got.where("placeholder not like '<B%'").count() == 0


def test_roots_that_reach_no_cycle_or_their_own(spark):
    whole = long_ones(spark, 500)
    assert C.cycles(whole, spark.createDataFrame([("<A_0>",)], "placeholder string")).count() == 0
    assert {r[0] for r in C.cycles(whole, spark.createDataFrame([("<C_2>",)], "placeholder string")).collect()} == {"<C_2>"}
