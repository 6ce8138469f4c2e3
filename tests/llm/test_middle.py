"""Fill-in-middle texts against a plain regular expression."""

from __future__ import annotations

import hashlib
import random
import re

from tokenizers import Regex
from tokenizers.pre_tokenizers import Split

from cloakspark.llm import middle

TOKEN = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_row(doc_id, text):
    text = text or ""
    units = TOKEN.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    form, out = ("spm", f"<S>{suf}<P>{pre}<M>{mid}") if h4 % 100 < 80 else ("psm", f"<P>{pre}<S>{suf}<M>{mid}")
    return (doc_id, n, form, len(pre), len(mid), sha(out), sha(text))


def random_texts(n):
    rng = random.Random(7)
    signs = ["a", "Wort", "été", "漢字", "😀", "é", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\x1c", " ", " ", "\x00", "<", "<P", "P>", "\r\n"]
    return ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(n)]


def test_rows_equal_a_plain_expression(spark):
    texts = [*random_texts(300), None, "", "   ", " lead", "trail  ", "has <M> in it", "word " * 40_000, "x" * 200_000, " " * 100_000]
    rows = [(k, t, "clash", "n", 3) for k, t in enumerate(texts)] + [(None, "no id here", "", "", 1), (5, "same id", "", "", 1), (5, "same id", "", "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, form string, output string, n int")
    got = sorted([tuple(r) for r in middle.transformed(df, full=False).collect()], key=str)
    assert got == sorted([plain_row(r[0], r[1]) for r in rows], key=str)
    assert {r[2] for r in got} == {"plain", "spm", "psm"}
    assert middle.transformed(df.limit(0)).count() == 0


def test_outputs_give_the_text_back(spark):
    texts = random_texts(200)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = middle.transformed(df).collect()
    assert len(rows) == 200
    for r in rows:
        assert middle.rebuilt(r["form"], r["output"]) == texts[r["doc_id"]]
        if r["form"] != "plain":
            assert r["prefix"] + r["middle"] + r["suffix"] == texts[r["doc_id"]]


def test_parts_that_look_like_marks_where_they_meet():
    for form in ("psm", "spm"):
        for p, m, s in [("<", "P>", "<S"), ("<S", ">", "<M"), ("", "", ""), ("<P", "<P", "<P")]:
            assert middle.rebuilt(form, middle.written(form, p, m, s)) == p + m + s


def test_offsets_count_code_points():
    splitter = Split(Regex(middle.UNIT), "isolated")
    for text in ["é 😀😀 x", "á b", "\n\n", "漢 字 "]:
        ends, at = [], 0
        for unit in TOKEN.findall(text):
            ends.append(at := at + len(unit))
        assert middle.ends(text, splitter) == ends
