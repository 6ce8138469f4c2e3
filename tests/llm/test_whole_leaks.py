"""Leaks that the pooled reading of a document misses."""

from __future__ import annotations

import random

from cloakspark.llm import decontaminate

REPEATS = "At noon Tom has 3 apples and Ann has 5 apples and Bob has 7 apples and Eve has 9 apples in total."
TRAIN = "The train leaves London with 120 people at 9 and reaches Paris after 340 km of travel in the night."
OTHER_TRAIN = "The train leaves Madrid with 77 people at 4 and reaches Rome after 901 km of travel in the night."


def held(spark, items, docs):
    items = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    docs = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    return {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, items).collect()}


def test_each_occurrence_is_judged_by_itself(spark):
    docs = [REPEATS, f"{TRAIN} {OTHER_TRAIN}", f"{REPEATS} and so on {REPEATS}", "At noon Tom has 3 apples and then he went home to sleep."]
    assert held(spark, [REPEATS, TRAIN], docs) == {(0, 0), (1, 1), (2, 0)}


def test_names_at_sentence_starts_and_short_items(spark):
    ask = "Tom has 3 apples. Ann gives him 5 more apples. Tom eats 2 of them. How many apples are left?"
    again = "Bob has 4 apples. Eve gives him 8 more apples. Bob eats 1 of them. How many apples are left?"
    other = "Bob has 4 apples. Bob gives Eve 8 of them. How many are in the house of the man then?"
    docs = [again, f"so they say that {again}", other, "we all know that Paris beats Rome these days", "a longer text with xyzzy plugh in it", "a longer text with xyzzy and plugh", "xyzzy plugh"]
    assert held(spark, [ask, "Paris beats Rome", "xyzzy plugh"], docs) == {(0, 0), (1, 0), (3, 1), (4, 2), (6, 2)}


def test_anchor_words_lose_no_leak(spark, monkeypatch):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefg") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    vocabulary += [v.title() for v in vocabulary[:12]] + ["12", "3.5", "km", ".", "?"]
    sentence = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [sentence(rng.randrange(1, 25)) for _ in range(12)]
    items = [f"{i} abc" for i in items]
    docs = [f"{sentence(20)} {' '.join([w for w in i.split() if rng.random() > p])} {sentence(20)}" for i in items for p in (0, 0.03, 0.1)] + [sentence(200) for _ in range(20)]
    want = None
    for limit in (-1, 0, 5000):  # without anchors, joined, constant
        monkeypatch.setattr(decontaminate, "CONSTANT_ANCHORS", max(limit, 0))
        if limit < 0:
            with monkeypatch.context() as m:
                m.setattr(decontaminate, "anchors", lambda benchmark: None)
                want = held(spark, items, docs)
        else:
            assert held(spark, items, docs) == want
    assert decontaminate.anchors(spark.createDataFrame(list(enumerate(items)), "item_id long, text string")) is not None
    assert len(want) > 15


def test_very_long_texts_repeated_rows_and_hot_placeholder_windows(spark):
    numbers = " ".join(str(k) for k in range(30))
    long = "word " * 50_000 + TRAIN + " word" * 50_000
    docs = [long, long, numbers, numbers + " and more", "", TRAIN]
    got = held(spark, [TRAIN, " ".join(str(k + 7) for k in range(12))], docs)
    assert {(0, 0), (1, 0), (5, 0)} <= got and {d for d, i in got if i == 0} == {0, 1, 5}


def test_windows_that_repeat_count_by_place(spark):
    run = " ".join(str(k) for k in range(1, 21))
    lists = "Tom has 3 apples and Ann has 3 apples and Ann has 3 apples and Ann has 3 apples and Ann has 3 apples now"
    other_run = " ".join(str(3 * k + 100) for k in range(1, 21))
    docs = ["call us at 40 77 12 9 63 now or later", f"list: {run} end", f"list: {other_run} end", "Tom has 3 apples and Ann has 3 apples and that is all", f"well {lists}", "so Bob has 8 apples and Eve has 8 apples and Eve has 8 apples and Eve has 8 apples and Eve has 8 apples now"]
    assert held(spark, [run, lists], docs) == {(1, 0), (2, 0), (4, 1), (5, 1)}
    short = [" ".join(str(k) for k in range(12))] * 3  # the same row three times is one text
    items = spark.createDataFrame([(0, run)], "item_id long, text string")
    assert decontaminate.leaks(spark.createDataFrame([(1, t) for t in short], "doc_id long, text string"), items).count() == 0
