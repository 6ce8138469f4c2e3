"""Vector codes against plain loops over Python integers."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pytest

from cloakspark.llm import codes, simhash

SCHEMA = "vec_id long, embedding array<float>, label int, code int, key string, vector string"


def plain_codes(rows, parts=8, entries=16, rounds=6):
    """(vec_id, code, error, label) of each kept row, and the codebooks, one row and entry after the other."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    width = -(-max((len(r[1]) for r in kept), default=0) // parts) * parts
    step = width // parts
    whole = [[math.floor(4096 * float(np.float32(x))) for x in r[1]] + [0] * (width - len(r[1])) for r in kept]
    first = {}
    for r, v in sorted(zip(kept, whole, strict=True), key=lambda p: (p[0][0] is None, p[0][0] or 0, p[1])):
        first.setdefault(r[0], v)
    start = list(first.values())[:entries]
    books = [[v[p * step : (p + 1) * step] for v in start] for p in range(parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    own = lambda: [[min(range(len(books[p])), key=lambda e: (far(v[p * step : (p + 1) * step], books[p][e]), e)) for p in range(parts)] for v in whole]
    for _ in range(rounds):
        at = own()
        for p in range(parts):
            for e in range(len(books[p])):
                mine = [v[p * step : (p + 1) * step] for v, a in zip(whole, at, strict=True) if a[p] == e]
                if mine:
                    books[p][e] = [sum(c) // len(mine) for c in zip(*mine, strict=True)]
    out = []
    for r, v, a in zip(kept, whole, own(), strict=True):
        out.append((r[0], "".join(f"{i:02x}" for i in a), sum(far(v[p * step : (p + 1) * step], books[p][a[p]]) for p in range(parts)), r[2]))
    sums = {}
    for _, _, d, label in out:
        sums[label] = sums.get(label, 0) + d
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted([(i, c, d, sums[label], sha) for i, c, d, label in out], key=str)


def got(spark, rows):
    return sorted([tuple(r) for r in codes.coded(spark.createDataFrame([(*r, 1, "k", "v") for r in rows], SCHEMA)).collect()], key=str)


def random_rows(n, width, seed=0, scale=0.2):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, scale, (9, width))
    return [(int(rng.integers(10**6)), [float(x) for x in (centres[rng.integers(9)] + rng.normal(0, scale / 4, width)).astype("f4")], int(rng.integers(4))) for _ in range(n)]


@pytest.mark.parametrize(("n", "width"), [(120, 16), (90, 64), (7, 8), (60, 12)])
def test_codes_equal_plain_loops(spark, n, width):
    rows = random_rows(n, width)
    assert got(spark, rows) == plain_codes(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(simhash, "JOIN_ROWS", 5)  # labels of many rows are spread
    rows = random_rows(50, 16, 3)
    rows += [(1, None, 1), (2, [0.5] * 15 + [None], 1), (3, [float("nan")] * 16, 2), (4, [float("inf")] * 16, 2)]  # left out
    rows += [(5, [0.25] * 16, None), (6, [0.25] * 16, None), (None, [0.1] * 16, 1), (7, [-0.3] * 16, 3), (7, [-0.4] * 16, 3), (7, [-0.3] * 16, 3), (8, [1.0] * 9, 0), (9, [], 0)]
    assert got(spark, rows) == plain_codes(rows)
    assert got(spark, [(1, None, 1)]) == [] and got(spark, []) == []


def test_ties_go_to_the_lower_index(spark):
    rows = [(k, [float(k % 2), 0.0] * 8, k % 3) for k in range(20)] + [(30, [0.5, 0.0] * 8, 1)]
    assert got(spark, rows) == plain_codes(rows)


def test_large_components_stay_exact(spark):
    rows = [(k, [1e9 * (k % 5) + k] * 8, 1) for k in range(30)]
    expected = plain_codes(rows)
    beyond = lambda d: d if d < 2**63 else None
    assert got(spark, rows) == [(i, c, beyond(d), beyond(s), sha) for i, c, d, s, sha in expected]


def test_partial_search_equals_all_distances():
    rng = np.random.default_rng(5)
    for _ in range(40):
        width, entries = int(rng.integers(1, 12)), int(rng.integers(1, 17))
        book, x = rng.integers(-4, 5, (entries, width)), rng.integers(-4, 5, (50, width))
        index, distance = codes.nearest(x, book)
        all_ = ((x[:, None, :] - book[None]) ** 2).sum(axis=2)
        assert (index == all_.argmin(axis=1)).all() and (distance == all_.min(axis=1)).all()
    assert codes.variance_order(np.array([[0, 5, 1], [0, -5, 2]])).tolist() == [1, 2, 0]
