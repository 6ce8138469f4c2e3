"""Spans of every notice in a range of neighbouring ones."""

from __future__ import annotations

import random

import pytest

from cloakspark.llm import licenses

TEXTS = [
    ("Released under the BSD license", "bsd"), ("Released under the ISC license", "isc"), ("Released under the GPL license", "gpl"), ("Licensed under CC BY SA 4.0", "cc-by-sa"), ("Licensed under CC BY ND 4.0", "cc-by-nd"),
    ("Mozilla Public License Version 1.1", ""), ("Apache License, Version 1.1", ""), ("Mozilla Publc License, Version 2.0", "mpl-2"), ("Licensed undr the Apache Licence, Version 2.0", "apache-2"), ("released under the submit license", ""),
]


@pytest.mark.parametrize(("text", "labels"), TEXTS)
def test_names_and_versions_decide_the_label(text, labels):
    assert licenses.digest(text, licenses.Scanner())[5] == labels


def least_edits(notice, joined):
    """Fewest edits with which a notice stands anywhere in a text; deciding words, between spaces, hold none (by dynamic programming)."""
    marks = [(c, False) for c in ""]
    for k, run in enumerate(notice.text.split(" ")):
        exact = run.startswith("*")
        marks += [(" ", exact or notice.text.split(" ")[k - 1].startswith("*"))] if k or exact else []
        marks += [(c, exact) for c in run.strip("*")]
    if notice.text.split(" ")[-1].startswith("*"):
        marks.append((" ", True))
    row = [0] * (len(joined) + 1)
    for i, (c, exact) in enumerate(marks):
        inside = exact and i > 0 and marks[i - 1][1]
        new = [row[0] + 1 if not exact else 99]
        for j, x in enumerate(joined, 1):
            same = row[j - 1] if c == x else 99 if exact else row[j - 1] + 1
            new.append(min(same, 99 if exact else row[j] + 1, 99 if exact or inside else new[j - 1] + 1))
        row = new
    return min(row)


def test_fuzzy_matches_by_brute_force():
    rng = random.Random(4)
    scanner = licenses.Scanner()
    for _ in range(150):
        n = rng.choice(licenses.NOTICES)
        text = n.words
        for _ in range(rng.randrange(0, n.edits + 2)):
            at = rng.randrange(len(text))
            text = rng.choice([text[:at] + text[at + 1 :], text[:at] + rng.choice("xyz ") + text[at:], text[:at] + rng.choice("xyz") + text[at + 1 :]])
        joined, _ = licenses.joined_words(f"some {text} more")
        want = {m.label for m in licenses.NOTICES if least_edits(m, joined) <= m.edits}
        assert {s.notice.label for s in scanner.spans(joined) if not s.notice.exact} == want, joined


def test_many_notices_in_one_text():
    got = licenses.digest("released under the mit license, " * 500, licenses.Scanner())
    assert got[:4] == (2500, 500, 1, 2496) and got[7].count("mit") == 1000


def test_worse_matches_before_the_best_are_kept():
    mit = next(n for n in licenses.NOTICES if n.edits >= 2)
    words = mit.words
    worse = words[: len(words) // 2] + "q" + words[len(words) // 2 + 1 :]
    scanner = licenses.Scanner((mit,))
    joined = f" {worse} {worse} {words} "
    assert [s.edits for s in scanner.spans(joined)] == [1, 1, 0]
