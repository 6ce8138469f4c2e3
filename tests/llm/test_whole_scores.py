"""The two classifiers against plain walks over single rows, and the pipeline's stages on odd tables."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest

from cloakspark.llm import quality, toxicity

ODD = [(1, "same words in a row " * 9), (2, None), (3, ""), (2, "another text under an id"), (None, "no id " * 30), (4, "same words in a row " * 9), (4, "same words in a row " * 9), (5, "long " * 60_000)]


def test_trees_by_walking():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, len(quality.STATISTICS))).round(1)
    y = (x[:, 2] + x[:, 5] * x[:, 7] + rng.normal(0, 0.3, 300) > 0).astype(float)
    trees = quality.fit(x, y)
    got = trees.score(x[:40])
    inner = trees.feature.shape[1]
    for row, score in zip(x[:40], got, strict=True):
        z = trees.base
        for f, t, leaf in zip(trees.feature, trees.threshold, trees.leaf, strict=True):
            at = 0
            while at < inner:
                at = 2 * at + (2 if row[f[at]] > t[at] else 1)
            z += leaf[at - inner]
        assert math.isclose(score, 1 / (1 + math.exp(-z)), rel_tol=1e-9)
    assert ((trees.score(x) > 0.5) == (y > 0.5)).mean() > 0.95


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(4)
    x, y = rng.integers(0, 9, (120, len(quality.STATISTICS))).astype(float), rng.integers(0, 2, 120).astype(float)
    trees = quality.fit(x, y)
    p = 1 / (1 + math.exp(-trees.base))
    g, h = y - p, np.full(120, p * (1 - p))

    def gain(f, t):
        sides = [x[:, f] <= t, x[:, f] > t]
        if any(h[s].sum() < quality.LEAST_WEIGHT for s in sides):
            return 0.0
        return sum(g[s].sum() ** 2 / (h[s].sum() + quality.SHRINK) for s in sides) - g.sum() ** 2 / (h.sum() + quality.SHRINK)

    most = max(gain(f, t) for f in range(x.shape[1]) for t in range(9))
    assert math.isclose(gain(trees.feature[0, 0], trees.threshold[0, 0]), most, rel_tol=1e-9)


def small_network():
    rng = random.Random(5)
    pool = [f"word{k}" for k in range(60)]
    texts = [" ".join(rng.choices(pool, k=rng.randrange(3, 20)) + (["vile", "scum"] if k % 3 == 0 else [])) for k in range(400)]
    ids = [toxicity.buckets(toxicity.word_hashes(t)) for t in texts]
    return toxicity.fit(ids, np.array([k % 3 == 0 for k in range(400)], float)), texts


def plain_probability(net, ids):
    """Of one text: the sum of a word's rows, every filter at every place up to the first padding, the largest of each."""
    words = [net.embedding[net.row[r]].astype(float).sum(axis=0) for r in ids] + [np.zeros(toxicity.DIM)] * max(toxicity.FILTERS)
    top = []
    for width, w in net.filters.items():
        values = [sum(words[at + k] @ w[k * toxicity.DIM : (k + 1) * toxicity.DIM].astype(float) for k in range(width)) for at in range(len(ids) + 1)]
        top += np.max(values, axis=0).tolist()
    z = np.maximum(np.array(top) + net.bias, 0) @ net.weight + net.offset
    return 1 / (1 + math.exp(-z))


def test_network_by_plain_sums():
    net, texts = small_network()
    some = ["", "vile scum word1", "word1 word2", *texts[:30], "vile", "", "scum scum scum scum"]
    ids = [toxicity.buckets(toxicity.word_hashes(t)) for t in some]
    got = net.probability(ids, net.table())
    assert np.allclose(got, [plain_probability(net, i) for i in ids], atol=1e-5)
    # a score doesn't depend on the texts beside it
    assert np.allclose(got, [net.probability([i], net.table())[0] for i in ids], atol=1e-6)
    assert np.allclose(got, net.probability(ids[::-1], net.table())[::-1], atol=1e-6)


@pytest.mark.parametrize("stage", [1, 2, 3])
def test_stages_of_odd_tables(spark, stage):
    import corpus_pipeline as pipeline

    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in ODD], "doc_id long, text string, fp string, component_id string")
    run = pipeline.STAGES[stage][1]
    got = run(spark, docs, "/root/testdata/sf0.001")
    rows = [(r["doc_id"], r["text"]) for r in got.collect()]
    assert got.columns == docs.columns and run(spark, docs.limit(0), "/root/testdata/sf0.001").count() == 0
    # of near-duplicates (null and empty texts are one group) one row of an id stays, and rows without an id; the others drop no such rows
    ids = sorted((i for i, _ in rows), key=lambda i: (i is None, i))
    assert ids == ([1, 2, 5, None] if stage == 1 else [1, 2, 2, 3, 4, 4, 5, None])
    if stage == 2:  # copies go; of the first one a period stays, as its other 100-byte strings also start earlier
        assert sorted(len(t or "") for i, t in rows if i == 4) == [0, 0] and dict(rows)[1] == "same words in a row "
