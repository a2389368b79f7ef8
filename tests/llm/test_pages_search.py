import os
import re
import textwrap

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pricelab.llm import htmltext, licenses, topk
from pricelab.llm.license_digests import DIGESTS

from .helpers import docs_frame

PAGE = """<!DOCTYPE html><html><head><title>Title</title><style>p{}</style><script>var a="</p>";</script></head><body class="home comments-open">
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li>About</ul></nav><div class="cookie-notice">We use cookies</div><!-- ad -->
<div id="sidebar"><p>Links and more links</p></div><article><h1>The  head&amp;line</h1><p>First
 paragraph, <b>long enough</b> to count&#33;<br>More.<p>Second one.<div class="ad">Buy this</div><ul><li>item<li>item two</ul>
<form><p>Sign up</p><input></form><p>Last <i>words<p>Ti.</article><section class="comments"><p>I do not agree with this article at all</p></section>
<aside>Related</aside><footer>&copy; me</footer></body></html>"""


def test_article_of_a_page():
    assert htmltext.main_text(PAGE).split("\n") == ["The head&line", "First paragraph, long enough to count! More.", "Second one.", "item", "item two", "Last words", "Ti."]


@pytest.mark.parametrize("html,text", [(None, ""), ("", ""), ("<p>", ""), ("<p>only text</p>", "only text"), ("no markup &lt;at all", "no markup <at all"),
                                       ("<nav>menu</nav>", ""), ("<article></article>", ""), ("<![if broken <p>x", None), ("<article><p>" + "x" * 200_000 + "</article>", "x" * 200_000)])
def test_odd_pages(html, text):
    got = htmltext.main_text(html)
    assert text is None or got == text


@pytest.mark.parametrize("section", ["<![foo bar]>", "<![ ", "<![1]>", "<![if !IE>", "<![endif]>", "<![CDATA[ a > b ]]>", "<![CDATA[ open", "<![RCDATA[ open", "<!["])
def test_text_after_a_marked_section_stays(section):
    got = htmltext.main_text(f"<article><p>one</p>{section}><p>two</p><![endif]><p>three</p><![CDATA[ last ]]></article>").split("\n")
    assert [x for x in got if x != ">"] == ["one", "two", "three"]


@pytest.mark.parametrize("name", ["layout has-sidebar", "no-sidebar", "page-with-header", "layout-sidebar-left", "withSidebar", "widget"])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_a_class_does_not_silence_what_holds_the_article(name, tag):
    html = f"<div class='{name}'><div id='{name}'><{tag}><h1>Head</h1><p>The text of it.<div class=ad>Buy</div><p>And more.</{tag}></div></div><div class=sidebar>Links</div>"
    assert htmltext.main_text(html).split("\n") == ["Head", "The text of it.", "And more."]
    html = f"<{tag}><p>The text of it.</{tag}><div class=comments><article><p>Not so.</article></div>"
    assert htmltext.main_text(html) == "The text of it."
    assert htmltext.main_text("<div class='no-sidebar'><p>Words</div>") == htmltext.main_text("<div class=sidebar><main></main><p>Words</div>") == "Words"


def test_page_without_article():
    long = "A paragraph with many words that goes on for quite a while, as the text of an article does. " * 3
    html = f"<body><div><a href=1>a</a><a href=2>b</a></div><div class=menu>menu</div><h2>Head</h2><p>{long}</p><p>{long}</p><div class='comment-list'><p>{long}</p></div></body>"
    assert htmltext.main_text(html).split("\n") == ["Head", long.strip(), long.strip()]


LONG = "A paragraph with many words that goes on for quite a while, as the text of an article does. " * 3


@pytest.mark.parametrize("part", ['<h2 id="related-work">Kept</h2>', '<h2 id="search-algorithms">Kept</h2>', '<h2 id="social-history">Kept</h2>', '<section id="side-effects">Kept</section>',
                                  '<div class="share-price">Kept</div>', '<section class="widget">Kept</section>', '<blockquote class="comment">Kept</blockquote>', '<header><h1>Kept</h1></header>',
                                  '<label>Kept</label>', '<section id="search"><p>Kept</section>', '<p>Kept <span class="share">whole</span></p>'])
@pytest.mark.parametrize("tag", ["article", "main"])
def test_names_inside_an_article_take_no_text_away(part, tag):
    got = htmltext.main_text(f"<nav><a href=x>menu</a></nav><{tag}><p>{LONG}</p>{part}<p>{LONG}</p></{tag}><footer>end</footer>").split("\n")
    assert got[0] == got[2] == LONG.strip() and got[1].startswith("Kept") and len(got) == 3


@pytest.mark.parametrize("part", ['<div class="ad">Buy this</div>', '<div class="ad-slot"><p>Buy</p></div>', '<div id="comments"><p>I do not agree</p><p>Nor do I</p></div>', '<ul class="share-buttons"><li>one</ul>',
                                  '<aside>x</aside>', '<footer>x</footer>', '<nav>x</nav>', '<div class="newsletterSignup">Get it</div>'])
def test_boxes_inside_an_article_go(part):
    assert htmltext.main_text(f"<article><p>{LONG}</p>{part}<p>{LONG}</p></article>").split("\n") == [LONG.strip()] * 2


def test_ratios_decide(monkeypatch):
    """With other ratios the result is another, on pages with and without an article."""
    marked = f"<article><p>{LONG}</p><div class='notice'><p>{LONG * 12}</p></div><div class=ad>Buy</div><p>{LONG}</p></article><article><p>tiny</p></article>"
    plain = "".join(f"<div>before {k}</div>" for k in range(4)) + f"<p>{LONG}</p><p>{LONG}</p>" + "".join(f"<div>after {k}</div>" for k in range(12))
    whole = [htmltext.main_text(marked), htmltext.main_text(plain)]
    assert whole[0].split("\n") == [LONG.strip(), (LONG * 12).strip(), LONG.strip()] and whole[1].count(LONG.strip()) == 2 and "before 0" not in whole[1]
    monkeypatch.setattr(htmltext, "smooth", lambda ratio, sigma: ratio[::-1])
    assert htmltext.main_text(marked) != whole[0] and htmltext.main_text(plain) != whole[1]


def test_given_pages_keep_their_article(spark):
    """Brute force over the given pages: the text of each block of the article element."""
    import html as entities

    for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect():
        inner = re.search(r"<article[^>]*>(.*?)</article>", r["html"], re.S)[1]
        inner = re.sub(r"(?s)<(script|style|aside|nav|form|footer|button)\b.*?</\1>|<!--.*?-->", "", inner)
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]+>", "", x)).split()) for x in re.split(r"</?(?:p|h\d|li|ul|ol|div|section|blockquote|table|tr|td|figure)\b[^>]*>", inner))
        assert htmltext.main_text(r["html"]).split("\n") == [x for x in blocks if x]


def test_extract_column(spark):
    df = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (2, None, None)], "page_id long, url string, html string")
    got = df.withColumn("text", htmltext.extract(F.col("html"))).collect()
    assert [len(r["text"]) > 0 for r in got] == [True, True, False]
    assert df.limit(0).withColumn("text", htmltext.extract(F.col("html"))).count() == 0


def brute(rows, k=10):
    ok = {i: [int(np.floor(1024.0 * x)) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in sorted(i for i in ok if i % 100 == 0):
        best = sorted((-sum(a * b for a, b in zip(ok[q], v)), i) for i, v in ok.items() if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(best)]
    return out


@pytest.mark.parametrize("n", [0, 1, 7, 600])
def test_topk(spark, monkeypatch, n):
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 90)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(n)
    rows = [(k, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 1.0], 6)]) for k in range(n)]
    if n > 7:
        rows += [(1000, None), (1100, [0.1, None, 0.2, 0.0, 0.0, 0.0]), (1200, [float("nan")] * 6), (1300, [float("inf")] * 6), (None, [1.0] * 6), (1400, [])]
    df = spark.createDataFrame([(i, v, 1, "r") for i, v in rows], "vec_id long, embedding array<float>, rank int, id string")
    got = sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0).collect()))
    assert got == brute(rows)


def test_topk_of_large_values(spark):
    """Sums beyond 64 bits on the way are exact; a score or a component beyond them is an error."""
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(0, [3e6, 3e6, 1.0]), (1, [2e6, -2e6, 1.0]), (2, [1.0, 1.0, 5.0]), (3, [-1.0, 2.5, 0.0])]
    assert sorted(map(tuple, topk.search(frame(rows), F.col("vec_id") % 100 == 0).collect())) == brute(rows)
    one, other = [(7, 5.0), (7, 9.0)], [(8, 2.0)]
    got = topk.search(frame([(i, [x]) for i, x in one + other]), F.col("vec_id") == 7).collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(8, 5 * 2 * 1024**2)]
    for bad in ([(0, [3e9]), (1, [3e9])], [(0, [1.0]), (1, [1e300])]):
        with pytest.raises(Exception):
            topk.search(frame(bad), F.col("vec_id") % 100 == 0).collect()


@pytest.mark.parametrize("batch", ["7", "10000"])
def test_topk_broadcasts_nothing(spark, monkeypatch, batch):
    """Queries once for every chunk of candidates are more than a driver holds: they go through the shuffle."""
    monkeypatch.setattr(topk, "CANDIDATE_BLOCK", 20)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 2)
    rng = np.random.default_rng(5)
    rows = [(20 * k, [float(x) for x in rng.choice([-0.5, 0.0, 0.25, 1.0], rng.integers(0, 9))]) for k in range(300)]
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        found = topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0)
        got = sorted(map(tuple, found.collect()))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    assert len(got) == 600 and got == brute(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "isFinalPlan=true" in plan and "Broadcast" not in plan


def test_topk_chunks(spark, monkeypatch):
    """As few chunks as the values and the cores ask for; their number is not seen in the result."""
    rows = [(k, [((k * 7 + d * 3) % 11 - 5) / 4 for d in range(6)]) for k in range(250)]
    df = spark.createDataFrame([*rows, (None, None)], "vec_id long, embedding array<float>")
    counts = []
    for values, block in ((1 << 23, 4096), (1 << 23, 130), (100, 4096)):
        monkeypatch.setattr(topk, "CHUNK_VALUES", values)
        monkeypatch.setattr(topk, "CANDIDATE_BLOCK", block)
        counts.append(topk.dealt(df, "embedding"))
        assert sorted(map(tuple, topk.search(df, F.col("vec_id") % 100 == 0).collect())) == brute(rows)
    assert counts == [1, 2, 15] and topk.dealt(df.limit(0), "embedding") == 1


@pytest.mark.parametrize("large, held", [(100, np.int32), (1 << 14, np.int64), (1 << 30, object)])
def test_best_of_blocks(large, held):
    """Over several blocks, with any width of integers, zeros, repeated ids and vectors of any length."""
    rng = np.random.default_rng(3)
    value = lambda: int(rng.choice([0, 0, 1, -1, large - 1, -large]))
    rows = [(int(rng.integers(0, 60)), [value() for _ in range(rng.integers(0, 9))]) for _ in range(90)]
    asks = [(i, [value() for _ in range(7)]) for i in range(0, 60, 3)]
    arrays = [pa.array([v for _, v in x], pa.list_(pa.int64())) for x in (rows, asks)]
    blocks = [(np.array([i for i, _ in rows[a : a + 25]]), topk.matrix(arrays[0].slice(a, 25))) for a in range(0, 90, 25)]
    q = topk.matrix(arrays[1])
    assert topk.kind(q, blocks[0][1]) == held
    got = [x.tolist() for x in topk.best(np.array([i for i, _ in asks]), q, blocks, 10)]
    expected = []
    for i, w in asks:
        expected += [(i, j, -s) for s, j in sorted((-sum(a * b for a, b in zip(w, v)), j) for j, v in rows if j != i)[:10]]
    assert list(zip(*got)) == expected
    assert topk.kind(np.array([[1 << 40]]), np.array([[0]])) == np.int64


def test_licences(spark):
    rows = [
        (1, "Licensed under the Apache License, Version 2.0.", None, None), (2, "  RELEASED under the MIT Licence!!\r\nCopyright (c) 2020 Somebody\n", None, None),
        (3, "Some text.\nReleased under the MIT License.\nmore\nLicensed under CC BY 4.0", None, None), (4, None, None, None), (5, "", None, None),
        (6, "We do not say released under the MIT License. here", None, None), (7, "Licence", None, None), (7, "License", None, None),
    ]
    got = {(r["doc_id"], r["digest"]): (r["license"], r["line_licenses"], r["n_lines"]) for r in licenses.scan(docs_frame(spark, rows)).collect()}
    by = {}
    for (d, _), v in got.items():
        by.setdefault(d, []).append(v)
    assert by[1] == [("Apache-2.0", "Apache-2.0", 1)] and by[2] == [("MIT", "MIT", 1)] and by[3] == [(None, "CC-BY-4.0,MIT", 2)]
    assert by[4] == by[5] == by[6] == [(None, "", 0)] and len(by[7]) == 1
    mine = spark.createDataFrame([("own", licenses_digest(spark, "My words"))], "license string, digest string")
    assert licenses.scan(docs_frame(spark, [(1, "my WORDS.", None, None)]), mine).collect()[0]["license"] == "own"
    assert licenses.scan(docs_frame(spark, [])).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN
CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""


def test_full_licence_texts(spark):
    wrapped = "\n\n".join(textwrap.fill(p, 72) for p in MIT.split("\n\n"))
    rows = [
        (1, "The MIT Licence (MIT)\n\nCopyright (c) 2031 A Body\nAll rights reserved.\n\n" + MIT, "MIT"), (2, MIT.replace("\n", "\r\n"), "MIT"), (3, wrapped, "MIT"),
        (4, "ISC Licence\n\nCopyright 2001-2004 Somebody Else <a@b.c>\n\n" + ISC, "ISC"), (5, MIT + "\nNot for anybody else.", None), (6, "Licensed under the ISC Licence.", "ISC"),
    ]
    flat = "\n\n".join(" ".join(p.split()) for p in MIT.split("\n\n"))
    rows += [(1000 + w, "\n\n".join(textwrap.fill(p, w) for p in flat.split("\n\n")), "MIT") for w in range(40, 141)]
    rows += [(2000, "Copyright holders and others may do so.\n" + MIT, None)]
    common = {"Apache-2.0": "Apache-2.0", "GPL-3": "GPL-3.0", "LGPL-2.1": "LGPL-2.1", "MPL-2.0": "MPL-2.0", "CC0-1.0": "CC0-1.0"}
    for k, (f, name) in enumerate(common.items()):
        if os.path.exists(path := f"/usr/share/common-licenses/{f}"):
            text = open(path, encoding="utf-8").read()
            rows += [(10 + k, text, name), (20 + k, re.sub(r"\b([Aa])uthoriz", r"\1uthoris", re.sub(r"\b([Ll])icense", r"\1icence", text)), name)]
    got = {r["doc_id"]: r["license"] for r in licenses.scan(docs_frame(spark, [(i, t, None, None) for i, t, _ in rows])).collect()}
    assert got == {i: name for i, _, name in rows}
    assert sum(map(len, DIGESTS.values())) < 400
    assert {"MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "MPL-2.0", "EPL-2.0", "Unlicense", "Zlib"} <= set(DIGESTS)


def licenses_digest(spark, text):
    df = licenses.with_form(spark.createDataFrame([(text,)], "t string"), F.col("t"), "form")
    return df.select(licenses.digest(licenses.one_line(F.col("form")))).collect()[0][0]
