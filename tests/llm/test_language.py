"""Language-model scores: counts against plain loops, probabilities against one-token-at-a-time sums, learning on held-out texts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cloakspark.llm import language as L

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def class_of(key):
    return int(L.rest_classes([key])[0])


def tokens_of(text):
    return [*WORD.findall((text or "").translate(LOWER)), "\n"]


def is_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def plain_base(rows):
    """doc_id, held_out, n_tokens, n_known, N, base of each row."""
    c = Counter(w for i, t in rows if not is_out(i) for w in tokens_of(t))
    total, distinct = sum(c.values()), len(c)
    return [(i, is_out(i), len(v), sum(c[w] > 0 for w in v), total, sum(math.log10((c[w] + 1) / (total + distinct + 1)) for w in v)) for i, t in rows for v in [tokens_of(t)]]


def texts_in_two_languages(n, seed=1):
    """Words of one half of a vocabulary or the other, and a pair of words that always stand together."""
    rng = random.Random(seed)
    pools = [[f"a{k}xe" for k in range(60)], [f"Ö{k}zu" for k in range(60)]]
    out = []
    for k in range(n):
        words = rng.choices(pools[k % 2], weights=[1 / (j + 1) for j in range(60)], k=rng.randrange(5, 60))
        words = [w for x in words for w in ([x, "pair", "mate"] if x.startswith(("a3", "Ö3")) else [x])]
        out.append(" ".join(words) + (f" rare{k}{rng.randrange(9)}" if k % 3 == 0 else ""))
    return out


def check_base(got, rows):
    want = plain_base(rows)
    key = lambda r: (r[0] is None, r[0] or 0, *r[2:4], round(r[5], 6))
    for g, w in zip(sorted([tuple(r) for r in got], key=key), sorted(want, key=key), strict=True):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9)
        assert g[6] < 0 or g[4] == 0


@pytest.mark.parametrize(("head", "pack"), [(L.HEAD, L.PACK_BYTES), (200, 2000)])
def test_counts_and_learning(spark, monkeypatch, head, pack):
    monkeypatch.setattr(L, "HEAD", head)  # 200: most tokens' counts come by the join
    monkeypatch.setattr(L, "PACK_BYTES", pack)
    rows = list(enumerate(texts_in_two_languages(900)))
    got = L.scored(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    check_base(got, rows)
    out = [r for r in got if r["held_out"]]
    n = sum(r["n_tokens"] for r in out)
    assert sum(r["score"] for r in out) / n > sum(r["base_score"] for r in out) / n + 0.2


def test_odd_rows(spark):
    long = "X" * 5000 + " word " + "é" * 70_000
    rows = [(1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, long), (5, long), (None, "no id"), (7, "same"), (7, "same"), (8, "A a   \x1c b"), (9, "İ ſ K")] + [(k, "held or not") for k in range(20, 60)]
    df = spark.createDataFrame([(*r, "x", True, "k") for r in rows], "doc_id long, text string, keys string, held boolean, slice string")
    check_base(L.scored(df).collect(), rows)
    assert L.scored(df.limit(0)).collect() == []
    out = [k for k in range(60) if is_out(k)][:3]
    untaught = L.scored(spark.createDataFrame([(k, "only held out rows") for k in out], "doc_id long, text string")).collect()
    assert [(r["n_known"], r["train_tokens"], r["base_score"]) for r in untaught] == [(0, 0, 0.0)] * 3 and all(np.isfinite(r["score"]) for r in untaught)


def small_model():
    """A vocabulary, a pack with all its counts, and tables with random weights."""
    texts = texts_in_two_languages(120)
    number, ids, sizes = {}, [], []
    for t in texts:
        words = [*L.words(t.encode()), L.END]
        ids += [number.setdefault(w, len(number)) for w in words]
        sizes.append(len(words))
    counts = Counter(ids)
    ranked = sorted(number, key=lambda w: (-counts[number[w]], w))
    rest = ranked[L.CLASSES * L.SIZE :]
    total, distinct = np.zeros(L.REST, int), np.zeros(L.REST, int)
    for w in rest:
        total[class_of(w)] += counts[number[w]]
        distinct[class_of(w)] += 1
    v = L.Vocabulary(len(ids), len(number), ranked, np.array([counts[number[w]] for w in ranked]), total, distinct)
    row = {"keys": list(number), "ids": np.array(ids, "<i4").tobytes(), "sizes": sizes}
    tables = L.Tables.of_counts(v)
    rng = np.random.default_rng(4)
    tables.classes[:] = rng.normal(0, 0.5, tables.classes.shape)
    tables.words[:] = rng.normal(0, 0.5, tables.words.shape)
    return texts, v, L.Pack(row, v, {k: i for i, k in enumerate(v.keys)}), tables


def plain_scores(texts, v, tables):
    """log10 of every token's probability, one token at a time."""
    rank = {k: i for i, k in enumerate(v.keys)}
    own = L.CLASSES * L.SIZE
    out = []
    for t in texts:
        before = [own + L.REST] * 2
        for w in [*L.words(t.encode()), L.END]:
            r = rank[w]
            known = r if r < own else own + class_of(w)
            cls = r // L.SIZE if r < own else L.CLASSES + class_of(w)
            a, b = before
            f = [a * 5 + 1, b * 5 + 2, (a * 8191 + b) * 5 + 3]
            z = tables.class_bias.astype(float) + sum(tables.classes[(x * 2654435761 % 2**32) >> (32 - L.CLASS_BITS)].astype(float) for x in f)
            p = z[cls] - np.log(np.exp(z).sum())
            if r < own:
                z = tables.word_bias[cls].astype(float) + sum(tables.words[((x * 64 + cls + 1) * 2246822519 % 2**32) >> (32 - L.WORD_BITS)].astype(float) for x in f)
                p += z[r % L.SIZE] - np.log(np.exp(z).sum())
                out.append(p / math.log(10))
            else:
                k = class_of(w)
                out.append(p / math.log(10) + math.log10((v.counts[r] + 1) / (v.rest_total[k] + v.rest_distinct[k] + 1)))
            before = [known, a]
    return out


@pytest.fixture
def few_classes(monkeypatch):
    monkeypatch.setattr(L, "CLASSES", 2)
    monkeypatch.setattr(L, "BATCH", 256)


def test_scores_equal_plain_sums(few_classes):
    texts, v, p, tables = small_model()
    assert np.allclose(L.scores(p, tables, v, L.nets_of(tables)), plain_scores(texts, v, tables), rtol=1e-4, atol=1e-4)


def test_all_tokens_share_one(few_classes):
    """Classes sum to one, members of a class too, and the seen tokens of a class of others with one unseen token's share."""
    _, v, p, tables = small_model()
    net = L.nets_of(tables)
    _, e, total = net[0].powers(tables.class_bias, None, p.class_rows[:, :50])
    assert np.allclose((e / total[:, None]).sum(axis=1), 1, atol=1e-5)
    others = [(w, c) for w, c in zip(v.keys, v.counts, strict=True) if v.keys.index(w) >= v.own]
    for k in range(L.REST):
        mine = [c for w, c in others if class_of(w) == k]
        assert math.isclose(sum((c + 1) / (v.rest_total[k] + v.rest_distinct[k] + 1) for c in mine) + 1 / (v.rest_total[k] + v.rest_distinct[k] + 1), 1)


def test_gradient_step_equals_plain_one(few_classes):
    rng = np.random.default_rng(2)
    weights, squares = rng.normal(0, 0.1, (1 << 6, 8)).astype("f4"), np.full(1 << 6, L.FIRST, "f4")
    net = L.Softmax(weights.copy(), squares.copy())
    rows, aim, bias = (rng.zipf(1.5, (L.FEATURES, 200)) % 64).astype(np.uint16), rng.integers(0, 8, 200), np.zeros(8, "f4")
    _, e, total = net.powers(bias, None, rows)
    net.learn(e, total, aim, rows)
    z = weights[rows].sum(axis=0).astype(float)
    g = np.exp(z) / np.exp(z).sum(axis=1, keepdims=True)
    g[np.arange(200), aim] -= 1
    sums = np.zeros(weights.shape)
    for r in rows:
        np.add.at(sums, r, g)
    met = np.bincount(rows.ravel(), minlength=64)
    new = squares + (sums**2).mean(axis=1)
    want = np.where(met[:, None] > 0, weights - L.RATE / np.sqrt(new)[:, None] * sums, weights)
    assert np.allclose(net.weights, want, atol=1e-4) and (net.met == met).all() and np.allclose(net.squares, np.where(met > 0, new, squares), rtol=1e-3)


def test_classes_of_others_agree_with_the_counts(spark):
    rows = [(k, f"w{k} x é{k} {chr(200 + k)}") for k in range(50)]
    packs = L.packed(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "false held_out", "cast(text as binary) text"))
    counts = L.counted(packs)
    kept, L.CLASSES = L.CLASSES, 0
    try:
        v = L.vocabulary(counts)
    finally:
        L.CLASSES = kept
    total = Counter()
    for r in counts.collect():
        total[class_of(bytes(r["key"]))] += r["c"]
    assert [total[k] for k in range(L.REST)] == v.rest_total.tolist() and v.total == sum(total.values())
