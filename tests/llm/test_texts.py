"""Row-local operators against the libraries, brute force and held-out labels."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from cloakspark.llm import bpe, html_text, licenses, quality, toxicity, urls

DATA = "/root/testdata/sf0.01"
ODD = ["", " ", "a" * 500, "Ünïcode Σίσυφος ΟΔΟΣ İstanbul", "x<|endoftext|>y <|startoftext|>", "it's we'll I'M \x1c foo\x85bar", "中文字符 ½ ²", "é", " 😀😀👍🏽 $$$%%%" * 30, "\x00\x01", "%" * 5000]
SCHEMA = "doc_id long, text string, lang string, score double, source string"


def odd_rows(spark):
    rows = [(k, t, "en", 0.5, "s") for k, t in enumerate(ODD)] + [(None, "null id", None, None, None), (3, None, None, None, None), (3, "again", "en", 1.0, "s"), (3, "again", "en", 1.0, "s"), (99, "long words " * 60_000, "en", 1.0, "s")]
    return spark.createDataFrame(rows, SCHEMA), rows


def test_bpe_equals_the_library(spark):
    path = bpe.vocabulary_path()
    library = Tokenizer.from_file(path)
    df, rows = odd_rows(spark)
    want = []
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest()))
    got = [tuple(r) for r in bpe.encoded(df, path, full=False).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert bpe.encoded(df.limit(0), path).count() == 0
    own = bpe.Bpe(path)
    for row in bpe.encoded(df.where("doc_id < 9"), path).collect():
        assert own.decode(row["ids"]) == row["decoded"]


def test_bpe_ways_of_merging_agree():
    own, rng = bpe.Bpe(bpe.vocabulary_path()), random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("thaneri$%ß") for _ in range(rng.randrange(1, 60)))
        assert own.merge_scanned(own._symbols(word)) == own.merge_heaped(own._symbols(word))


def labelled(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").join(spark.read.parquet("/root/testdata/sf0.1/labels.parquet"), "doc_id").collect()
    return docs


def test_quality_on_held_out_labels(spark):
    rows = labelled(spark)
    x, y = np.array([quality.statistics(r["text"]) for r in rows]), np.array([r["quality"] for r in rows])
    out = np.array([zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in rows])
    kept = quality.fit(x[~out], y[~out].astype(float)).score(x[out]) >= quality.KEEP_FROM
    assert kept[y[out] == 1].mean() > 0.99 and (~kept[y[out] == 0]).mean() > 0.9


def test_quality_of_odd_rows(spark):
    df, rows = odd_rows(spark)
    trees = quality.fit(np.array([quality.statistics("good text here. " * k) for k in range(1, 30)] + [quality.statistics("BAD!! " * k) for k in range(1, 30)]), np.repeat([1.0, 0.0], 29))
    got = quality.scored(df, trees).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert {r["doc_id"]: r["held_out"] for r in got} == {r[0]: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 for r in rows}
    kept = quality.kept(df, trees)
    assert kept.columns == df.columns and kept.count() == sum(r["predicted"] for r in got)
    assert quality.scored(df.limit(0), trees).count() == 0
    assert quality.fit(np.zeros((0, len(quality.STATISTICS))), np.zeros(0)).score(np.zeros((2, len(quality.STATISTICS)))).shape == (2,)


def test_toxicity_on_held_out_labels(spark):
    rows = labelled(spark)
    hashes = [toxicity.word_hashes(r["text"]) for r in rows]
    ids, lang = [toxicity.buckets(h) for h in hashes], np.array([toxicity.language(h) for h in hashes])
    y, out = np.array([r["toxic"] for r in rows], float), np.array([zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in rows])
    net = toxicity.trained([i for i, o in zip(ids, out, strict=True) if not o], y[~out], lang[~out])
    p = net.probability([i for i, o in zip(ids, out, strict=True) if o], net.table())
    flagged = net.score(p, lang[out]) >= toxicity.FLAG_FROM
    assert flagged[y[out] == 1].mean() > 0.9 and flagged[y[out] == 0].mean() < 0.03


def test_toxicity_of_odd_rows(spark):
    df, rows = odd_rows(spark)
    net = toxicity.trained([], np.zeros(0), np.zeros(0, int))
    got = toxicity.scored(df, net).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 for r in got)
    long = "word " * 300_000
    assert len(toxicity.word_hashes(long)) == 300_000 and len(np.unique(toxicity.word_hashes(long)[:, 0])) == 1


def test_licenses_by_brute_force(spark):
    scanner = licenses.Scanner()
    texts = [*ODD, None, "Under the MIT License, under THE mit-license. CC BY NC cc by nc", "Apache License; Version 2", "the mit under license", "Lizensiert: cc by ncx é under the mit license", "Licensed undr the Apache Licence, Version 2.0"]
    df = spark.createDataFrame([(k, t, "x") for k, t in enumerate(texts)], "doc_id long, text string, labels string").select("doc_id", "text")
    for t in texts:
        low = "".join([chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = sorted((k, n.label) for n in licenses.BASE for k in range(len(words)) if words[k : k + len(n.words.split())] == n.words.split())
        got = licenses.digest(t or "", scanner)
        assert got[:5] == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None, ",".join(sorted({p[1] for p in places})))
    assert licenses.digest(texts[-1], scanner)[5] == "apache-2"
    assert licenses.scanned(df).count() == len(texts) and licenses.scanned(df.limit(0)).count() == 0


PAGE = "<html><head><title>T</title></head><body><nav><a>Menu</a></nav><div class='ad'>Buy</div><{0}><h1>Head &amp; more</h1><p>One  <b>two<p>three &lt;b&gt;<br>four<aside>no</aside><section class='comments'>first!</section></{0}><form>f</form><footer>&copy; x</footer></body></html>"


def test_html(spark):
    want = "Head & more\nOne two\nthree <b> four"
    rows = [(k, f"http://{'hot' if k % 3 else 'h' + str(k)}.org/{k}", PAGE.format("article" if k % 2 else "div"), "clash") for k in range(30)] + [(31, None, None, None), (None, "nohost", "plain words", None), (31, "http://x.org", "", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = html_text.extracted(df).collect()
    assert len(got) == len(rows)
    assert {r["text"] for r in got if r["page_id"] is not None and r["page_id"] < 30} == {want}
    assert sorted(r["text"] for r in got if r["page_id"] in (None, 31)) == ["", "", "plain words"]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extracted(df.limit(0)).count() == 0


def test_wrappers_fold_and_align():
    assert html_text.shown(html_text.folded(["h", "p", "p", "p", "f"])) == "h ( p )+ f"
    assert html_text.wrapper_of(["h p f", "h ( p )+ f", "h f"]) in ("h ( ( p )+ )? f", "( h )? ( ( p )+ )? f")
    assert html_text.read("h ( ( p )+ )? f") == ["h", ("?", (("+", ("p",)),)), "f"]


def test_urls_by_brute_force(spark):
    rows = [(k, f"https://{'bad' if k % 4 == 0 else 'ok'}.site.{'com' if k % 3 else 'net'}/{'en' if k % 2 else 'de'}/{k}?q={k % 5}") for k in range(200)]
    rows += [(None, "HTTP://A.EXAMPLE.com/en/71?x"), (1, None), (1, "no url"), (2, "x://example.net/de/8#a"), (2, "x://example.net/de/8#a"), (3, "://"), (4, "http://org/es/")]
    pages = spark.createDataFrame([(*r, "v") for r in rows], "page_id long, url string, verdict string")
    labels = pages.where("page_id < 200 and url like 'https://%'").selectExpr("url", "url like '%://bad.%' as blocked")
    got = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judged(pages, urls.mined(labels, 0.05, 0.9)).collect()}
    want = set()
    for k, u in rows:
        host, path = "", ""
        if u and "://" in u:
            rest = u.split("://", 1)[1]
            host = re.match(r"[^/?#]*", rest)[0].lower()
            path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
        fits = [r for r in urls.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        want.add((k, host, path, best and best[0] + best[1], best[2] if best else "block" if host.startswith("bad.") else "allow"))
    assert got == want
    assert urls.judged(pages.limit(0), urls.mined(labels, 0.05, 0.9)).count() == 0
    assert urls.judged(pages, urls.mined(labels.limit(0))).count() == len(rows)


@pytest.mark.parametrize("name", ["op2_toxicity", "op3_licenses", "op4_bpe", "op5_urls", "op8_html", "op9_quality"])
def test_queries_return_all_rows(spark, name):
    import __spark_entry__ as entry

    table = "pages" if name in ("op5_urls", "op8_html") else "documents"
    assert entry.queries()[name](spark, "/root/testdata/sf0.001").count() == spark.read.parquet(f"/root/testdata/sf0.001/{table}.parquet").count()
