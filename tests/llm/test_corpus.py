"""Operators over the whole corpus, against brute force on small tables with planted cases."""

from __future__ import annotations

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from cloakspark.llm import decontaminate, neighbours, simhash, substrings
from cloakspark.llm.suffix_array import suffix_array

SCHEMA = "doc_id long, text string, fp string, component_id string"


def words(rng, n):
    return " ".join("".join(rng.choice(["th", "an", "er", "io", "ne", "sta"]) for _ in range(rng.randrange(1, 5))) for _ in range(n))


def corpus(seed=1, n=60):
    """Documents with exact and near copies, shared passages, periodic and odd texts, a null id and repeated rows."""
    rng = random.Random(seed)
    base, passage = words(rng, 120), words(rng, 60)
    texts = [words(rng, rng.randrange(1, 150)) for _ in range(n)]
    texts += [base] * 5 + [base.replace(" ", "  ", 3)] * 2 + [base.upper()] + [base[:-9] + words(rng, 2) for _ in range(6)]
    texts += [f"{words(rng, 10)} {passage} {words(rng, 10)}" for _ in range(8)] + ["ab " * 200, "é" * 180, "xyz" * 90 + passage, "", " ", None, "one", "one two", "a" * 99, "b" * 100, "b" * 101]
    order = list(range(len(texts)))
    rng.shuffle(order)
    rows = [(i, t, "x", "y") for i, t in zip(order, texts, strict=True)]
    return [*rows, rows[3], (None, base, None, None), (None, None, None, None), (order[0], "same id, " + passage, "x", "y")]


def fingerprint(t):
    low = "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""])
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    s = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    hs = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs)) if hs else 0


def linked(fps):
    """Smallest id by fingerprint, by union of all pairs at 3 or fewer bits. fps: (id, fingerprint)."""
    nodes = sorted({f for _, f in fps})
    root = {f: f for f in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(nodes):
        for b in nodes[i + 1 :]:
            if (a ^ b).bit_count() <= 3:
                root[find(b)] = find(a)
    least = {}
    for i, f in fps:
        if i is not None:
            least[find(f)] = min(i, least.get(find(f), i))
    return {f: least.get(find(f)) for f in nodes}


@pytest.mark.parametrize("rows_of_a_key", [simhash.JOIN_ROWS, 3])
def test_simhash_by_brute_force(spark, rows_of_a_key, monkeypatch):
    monkeypatch.setattr(simhash, "JOIN_ROWS", rows_of_a_key)
    rows = [*corpus(), (2000, "very long text " * 30_000, "x", "y")]
    fps = [(r[0], fingerprint(r[1])) for r in rows]
    least = linked(fps)
    got = simhash.grouped(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(repr((i, format(f, "016x"), least[f])) for i, f in fps)
    assert simhash.grouped(spark.createDataFrame([], SCHEMA)).count() == 0
    kept = simhash.kept(spark.createDataFrame(rows, SCHEMA))
    ids = [r["doc_id"] for r in kept.collect() if r["doc_id"] is not None]
    assert sorted(ids) == sorted(set(least.values()))
    again = simhash.kept(spark.createDataFrame(rows, SCHEMA).repartition(7))
    assert sorted(map(repr, map(tuple, again.collect()))) == sorted(map(repr, map(tuple, kept.collect())))


def dense(n, seed):
    """Fingerprints in a few tight groups, and some at random: many links, few buckets."""
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(3)]
    out = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 6))) for c in centres for _ in range(n)}
    return list(out | {rng.getrandbits(64) for _ in range(50)})


@pytest.mark.parametrize("limit", [simhash.BUCKET, 40])
def test_pigeonhole_loses_no_link(spark, limit, monkeypatch):
    monkeypatch.setattr(simhash, "BUCKET", limit)
    fps = dense(150, 3)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    nodes = spark.createDataFrame([(s,) for s in signed], "fp long")
    for parts in ([([*range(32)], 1), ([*range(32, 64)], 1)], simhash.plan(nodes)):
        roots = {r["v"]: r["root"] for r in simhash.components(simhash.forest_edges(nodes, parts)).collect()}
        least = linked([(s, f) for s, f in zip(signed, fps, strict=True)])
        assert {s: roots.get(s, s) for s in signed} == {s: least[f] for s, f in zip(signed, fps, strict=True)}


def test_forest_both_ways(monkeypatch):
    fps = np.array(sorted(dense(100, 5)), np.uint64)
    small = simhash.forest(fps)
    monkeypatch.setattr(simhash, "AT_ONCE", 1 << 20)
    assert all((a == b).all() for a, b in zip(small, simhash.forest(fps), strict=True))


def test_thresholds_are_the_cheapest():
    from itertools import product

    rng = random.Random(4)
    for m in (2, 3, 4, 5):
        costs = [[0.0, *sorted(rng.random() for _ in range(4))] for _ in range(m)]
        got, chosen = simhash.allocated(costs, 4 - m)
        assert sum(chosen) == 4 - m and abs(got - min(sum(c[t + 1] for c, t in zip(costs, ts, strict=True)) for ts in product(range(-1, 4), repeat=m) if sum(ts) == 4 - m)) < 1e-12


def cut_by_force(rows):
    """Expected digests: order by id (null last), then hash of the text is free as ids with two texts aren't compared."""
    seen, out = {}, []
    for n, (i, t) in enumerate(rows):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if seen.setdefault(raw[p : p + 100], (n, p)) != (n, p):
                gone[p : p + 100] = True
        left = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        runs = int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(raw) else 0
        out.append((i, len(raw), int(gone.sum()), runs, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize(("hot", "large"), [(substrings.HOT, substrings.LARGE), (1, substrings.LARGE), (1, 150)])
def test_substrings_by_brute_force(spark, hot, large, monkeypatch):
    for name, value in (("HOT", hot), ("LOCAL", min(hot, substrings.LOCAL)), ("LARGE", large)):
        monkeypatch.setattr(substrings, name, value)
    rows = [r for r in corpus(2) if r[0] is not None][:-1]  # ids with one text; a repeated row stays
    rng, line = random.Random(12), words(random.Random(13), 18)
    rows += [(1000 + k, f"{words(rng, rng.randrange(30))} {line} {words(rng, rng.randrange(30))}", "x", "y") for k in range(40)]  # a line of many documents
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    want = cut_by_force(sorted([r[:2] for r in rows], key=lambda r: r[0]))
    assert sorted(map(tuple, substrings.digests(df).collect())) == sorted(want)


def test_substrings_of_odd_tables(spark):
    df = spark.createDataFrame(corpus(3), SCHEMA)
    assert substrings.digests(df).count() == df.count()
    assert substrings.digests(df.limit(0)).count() == 0
    cut = substrings.cut(df)
    assert cut.columns == df.columns and cut.count() == df.count()
    assert cut.where("text is null").count() == df.where("text is null").count()
    long = [(1, "q" * 30 + words(random.Random(9), 400_000), None, None), (2, words(random.Random(9), 50_000), None, None)]
    got = {r["doc_id"]: r for r in substrings.digests(spark.createDataFrame(long, SCHEMA)).collect()}
    assert got[2]["n_removed"] == got[2]["n_bytes"] > 200_000


def test_suffix_arrays():
    rng = random.Random(6)
    for _ in range(1500):
        s = [rng.randrange(rng.choice([1, 2, 4])) for _ in range(rng.randrange(0, 50))]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i: s[i:])


QUESTION = "If Anna buys 12 kg of apples in the old market and then sells 5 kg to her friend Omar, how many are left for the next day? The answer is a whole number."


def test_decontamination(spark):
    rng = random.Random(8)
    filler = lambda: words(rng, 80)
    changed = QUESTION.replace("Anna", "Vera").replace("Omar", "Ivan").replace("12", "40").replace(" 5 ", " 31 ")
    mixed = "If Anna buys 1 of 1 and 1 to Bob then 2 kg to Eve and 3 kg. " * 3
    docs = [(1, f"{filler()} {QUESTION} {filler()}", "a", "b"), (2, f"{filler()}. {changed} {filler()}", "a", "b"), (3, filler(), None, None), (4, QUESTION[:60] + filler(), None, None), (5, None, None, None), (None, QUESTION, None, None), (1, filler(), None, None), (6, mixed, None, None), (7, "", None, None)]
    items = spark.createDataFrame([(10, QUESTION, "x"), (11, words(random.Random(99), 30), "x"), (12, None, "x"), (13, "", "x"), (None, QUESTION, "x")], "item_id long, text string, doc_id string")
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id string, share string")
    got = decontaminate.leaks(df, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == {(1, 10), (2, 10)}
    kept = decontaminate.kept(df, items)
    assert kept.columns == df.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 4, 5, 6, 7]
    assert decontaminate.leaks(df.limit(0), items).count() == 0 and decontaminate.leaks(df, items.limit(0)).count() == 0


def test_decontamination_equals_sql(spark):
    c = duckdb.connect()
    for t in ("documents", "benchmark"):
        c.execute(f"create view {t} as select * from '/root/testdata/sf0.01/{t}.parquet'")
    want = c.execute(decontaminate.ORACLES["op10_decontaminate"]).fetchall()
    assert sorted(want) == sorted(map(tuple, decontaminate.op10_decontaminate(spark, "/root/testdata/sf0.01").collect())) and len(want) > 20


def vectors(n, seed, spread):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(40, 24))
    return (centres[rng.integers(0, 40, n)] + spread * rng.normal(size=(n, 24))) * rng.uniform(0.5, 2, (n, 1))


@pytest.mark.parametrize(("spread", "boxes"), [(0.1, 100), (5.0, 100), (5.0, 0)])
def test_neighbours_against_brute_force(spark, monkeypatch, spread, boxes):
    for name, small in (("BLOCK", 64), ("WINDOW", 100), ("GROUP", 500), ("PACK", 16), ("SAMPLE", 1000), ("CALIBRATION", 20)):
        monkeypatch.setattr(neighbours, name, small)
    monkeypatch.setattr(neighbours, "BOXES", boxes)
    x = vectors(3000, 1, spread).astype("f4").astype(float)
    x[1000:1400] = x[1000]
    rows = [(i, v.tolist(), "a") for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank string").repartition(5)
    got, report = {}, {}
    for r in neighbours.searched(df, report).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 3000, 20):
        s = x @ x[q]
        best = [i for i in np.lexsort((np.arange(3000), -np.round(s, 12))) if i != q][:20]
        found = sorted(got[q])
        assert [r[0] for r in found] == list(range(1, 21)) and q not in [r[1] for r in found]
        assert all(abs(r[2] - s[r[1]]) < 1e-9 for r in found) and [r[2] for r in found] == sorted([r[2] for r in found], reverse=True)
        hits += len({r[1] for r in found} & set(best))
    assert hits / (150 * 20) >= 0.9
    assert (report["searched_on"] > report["queries"] / 2) == (spread > 1)  # most queries of clusters need the windows alone
    assert [r[1] for r in sorted(got[1020])] == [i for i in range(1000, 1021) if i != 1020] or abs(sorted(got[1020])[0][2] - x[1000] @ x[1000]) > 1e-9


def test_neighbours_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.5, 0.5]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0]), (None, [1.0, 1.0]), (1, [2.0, 1.0]), (40, [0.0, 0.0]), (60, [None, 1.0]), (80, [nan, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in neighbours.searched(df).collect()}
    # a shorter vector is zero where it ends; queries with a null or zero vector take no part
    assert got == {(0, 1, 1, 2.0), (0, 2, 7, 1.0), (0, 3, 20, 0.5), (20, 1, 1, 1.5), (20, 2, 0, 0.5), (20, 3, 7, 0.5)}
    assert neighbours.searched(df.limit(0)).count() == 0
    assert neighbours.searched(df.where("vec_id = 0")).count() == 0


def test_hilbert_keys_are_a_walk():
    cells = np.array([(a, b) for a in range(8) for b in range(8)])
    walk = cells[np.argsort(neighbours.hilbert(cells, 3))]
    assert sorted(neighbours.hilbert(cells, 3).tolist()) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_pipeline_stages(spark):
    import corpus_pipeline as pipeline
    from cloakspark.llm import bpe, quality

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    trees = quality.fitted(spark, folder)
    have = {r["doc_id"]: r["text"] for r in docs.collect()}
    good = {i: t for i, t in have.items() if trees.score(np.array([quality.statistics(t)]))[0] >= quality.KEEP_FROM}
    least = linked([(i, fingerprint(t)) for i, t in good.items()])
    single = {i: t for i, t in good.items() if least[fingerprint(t)] == i}
    first = pipeline.keep_quality(spark, docs, folder)
    assert {r["doc_id"] for r in first.collect()} == set(good) and first.columns == docs.columns
    second = pipeline.keep_one_of_near_duplicates(spark, first, folder)
    assert {r["doc_id"] for r in second.collect()} == set(single)
    third = {r["doc_id"]: r["text"] for r in pipeline.cut_repeated_passages(spark, second, folder).collect()}
    expected = cut_by_force(sorted(single.items()))
    assert {i: len(t.encode()) for i, t in third.items()}.keys() == {e[0] for e in expected}
    assert all(abs(len(third[e[0]].encode()) - (e[1] - e[2])) <= 6 * e[3] for e in expected)
    rows = pipeline.run(spark, folder).collect()
    own = bpe.Bpe(bpe.vocabulary_path())
    assert rows and all(r["ids"] == own.ids_of(third[r["doc_id"]]) for r in rows) and len(pipeline.STAGES) == 5
