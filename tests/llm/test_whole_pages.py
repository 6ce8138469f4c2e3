"""Article text outside the container that holds most of it."""

from __future__ import annotations

import random
import re

from cloakspark.llm import html_text


def texts(spark, pages):
    rows = [(i, f"http://a.example/{i}", p) for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    return {r["page_id"]: r["text"] for r in html_text.extracted(df).collect()}


def test_no_article_text_is_dropped(spark):
    page = "<body class='single-post no-sidebar'><nav>menu</nav><article><h1>Head {0}</h1><p>intro {0}</p><ul>{1}</ul></article></body>"
    pages = [page.format(i, "".join(f"<li>a long item {i} {k} of many words</li>" for k in range(20))) for i in range(4)]
    other = "<body><article class='entry'><div class='body'><p>other layout</p></div></article><div class='tagline'>tagline</div></body>"
    got = texts(spark, [*pages, other])
    assert all(t.startswith(f"Head {i}\nintro {i}\na long item") and t.endswith("many words") and "menu" not in t for i, t in got.items() if i < 4)
    assert got[4] == "other layout"


def plain(k, head="Site of news"):
    return f"<body><div>{head}</div><div><p>intro {k}</p><p>Summary</p><p>end {k}</p></div><div>all about {'us' if k % 2 else 'us'}</div></body>"


def test_wrapper_tells_template_from_content_without_marks(spark):
    got = texts(spark, [plain(k) for k in range(5)])
    assert got == {k: f"intro {k}\nSummary\nend {k}" for k in range(5)}


def test_an_article_keeps_what_never_varies_on_any_number_of_pages(spark):
    page = "<body><article><h2>Introduction</h2><p>text {0}</p><p>more {0}</p><h3>Conclusion</h3><p>The end.</p></article></body>"
    unmarked = "<body><div><h1>Release notes</h1><p>body {0}</p></div></body>"
    for n in (1, 2, 7, 8, 100):
        assert texts(spark, [page.format(k) for k in range(n)]) == {k: f"Introduction\ntext {k}\nmore {k}\nConclusion\nThe end." for k in range(n)}
    for n in (1, 2, 8):
        assert texts(spark, [unmarked.format(k) for k in range(n)]) == {k: f"Release notes\nbody {k}" for k in range(n)}


def test_names_of_the_articles_own_parts(spark):
    own = ["share-price-analysis", "content-header", "post-header", "login-guide", "header", "ad-hoc-report", "related-work", "search-results-2024 story"]
    others = ["share", "share-buttons", "ad", "ad-slot-1", "comments", "comment-list", "newsletter-signup", "related_links", "cookie-notice"]
    for inside in ("article", "main"):
        pages = [f"<body><{inside}><p>text {k}</p><div class='{c}'><p>Body of the piece</p></div></{inside}></body>" for k, c in enumerate(own + others)]
        assert texts(spark, pages) == {k: f"text {k}" + ("\nBody of the piece" if k < len(own) else "") for k in range(len(pages))}


def test_another_wrapper_gives_another_text(spark):
    rows = [(k, f"http://a.example/{k}", plain(k)) for k in range(5)]
    pages = html_text.with_host(spark.createDataFrame(rows, "page_id long, url string, html string"))
    own = html_text.wrappers(pages).first()["wrapper"]
    content = html_text.decided(html_text.slot_facts(html_text.by_host(pages, html_text.wrappers(pages)))).first()["content"]

    def by(wrapper):
        return html_text.extracted_by(pages, spark.createDataFrame([("a.example", wrapper, content)], "host string, wrapper string, content string")).first()["text"]

    assert by(own) == "intro 0\nSummary\nend 0"
    assert by(" ".join(dict.fromkeys(html_text.slots(html_text.read(own))))) != by(own)


def test_hosts_of_many_layouts_are_aligned_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(html_text, "FAN", 4)
    page = lambda k: "<body><article>" + "".join(f"<{t}>{t} {k}</{t}>" for t in ("h1", "h2", "h3", "h4", "h5", "p") if k >> ord(t[-1]) % 6 & 1) + "</article></body>"
    got = texts(spark, [page(k) for k in range(64)])
    assert all(sorted(t.split("\n")) == sorted(f"{t} {k}" for t in ("h1", "h2", "h3", "h4", "h5", "p") if k >> ord(t[-1]) % 6 & 1) for k, t in got.items() if t)
    assert sum(1 for t in got.values() if not t) == 2


def test_very_long_pages(spark):
    rng = random.Random(3)
    tags = [rng.choice(["p", "h2", "pre"]) for _ in range(30_000)]
    long = "<body><article>" + "".join(f"<{t}>w{k}</{t}>" for k, t in enumerate(tags)) + "</article></body>"
    wide = "<body><article>" + "".join(f"<div><section class='c{chr(97 + k % 26)}{chr(97 + k // 26)}'><p>w{k}</p></section></div>" for k in range(600)) + "</article></body>"
    got = texts(spark, [long, wide])
    assert got[0] == "\n".join(f"w{k}" for k in range(30_000)) and got[1] == "\n".join(f"w{k}" for k in range(600))


def test_matching_by_brute_force():
    rng = random.Random(1)
    plain_ = lambda nodes: "".join([n if isinstance(n, str) else f"(?:{plain_(n[1])}){n[0]}" for n in nodes])
    for _ in range(500):
        streams = [[rng.choice("abc") for _ in range(rng.randrange(9))] for _ in range(rng.randrange(1, 6))]
        wrapper = html_text.wrapper_of([html_text.shown(html_text.folded(s)) for s in streams])
        own, matcher = list(html_text.slots(html_text.read(wrapper))), html_text.Matcher(wrapper)
        for s in streams:
            assert re.fullmatch(plain_(html_text.read(wrapper)), "".join(s)) and [own[i] for i in matcher(s)] == s
