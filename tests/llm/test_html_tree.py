import itertools
import time
import tracemalloc

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from trawlix.llm import html_tree as h


def test_held_out_pages():
    pages = [h.Page(x) for x in h.labelled_pages(200, 77)]
    y = np.concatenate([h.labels_of(p) for p in pages])
    leaf = np.concatenate([[i in p.texts for i in range(len(p.parent))] for p in pages]).astype(bool)
    p = h.Forest(pages).marginals(*h.train())
    assert ((p > 0.5) == y)[leaf].mean() > 0.97 and 0.2 < y[leaf].mean() < 0.9


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    pages = [h.Page("<div class=ad><p>a b c</p><ul><li>x</ul></div><p>Some text."), h.Page("")]
    forest = h.Forest(pages)
    weights, edges = rng.standard_normal(len(h.FEATURES)), rng.standard_normal((h.EDGES, 2, 2))
    got, joint = forest.marginals(weights, edges, want_edges=True)
    n, unary = len(forest.parent), forest.unary(weights)
    whole = np.concatenate([edges, h.EQUAL[None]])
    total, ones, pairs = 0.0, np.zeros(n), np.zeros((n, 2, 2))
    for labels in itertools.product((0, 1), repeat=n):
        s = sum(unary[i] for i in range(n) if labels[i]) + sum(whole[forest.edge[i], labels[p], labels[i]] for i, p in enumerate(forest.parent) if p >= 0)
        w = np.exp(s)
        total += w
        ones += w * np.array(labels)
        for i, p in enumerate(forest.parent):
            if p >= 0:
                pairs[i, labels[p], labels[i]] += w
    assert np.allclose(got, ones / total)
    assert np.allclose(joint[forest.parent >= 0], pairs[forest.parent >= 0] / total)


def test_article_without_its_surroundings():
    page = """<!doctype html><html><head><title>no</title><style>p{}</style></head><body class="page">
    <script>var t = "</p><p>no</p>";</script><noscript>no</noscript><!-- <p>no</p> -->
    <header><a href="/">Site</a> <h2>no menu</h2></header><nav><ul><li><a href=a>no</a></ul></nav>
    <div id="cookie-notice">We use cookies, no.</div>
    <article><h1>A title here</h1><p>First   line &amp; more&nbsp;of <b>it</b>.<p>Second &lt;b&gt; line<br>goes on &eacute;&#233;.
    <ul><li>One thing to say<li>Another thing to say</ul><div class="ad">Buy no.</div><p>Last line of text here.</article>
    <section id="comments"><h3>Comments</h3><p>No, a reader says this and that at length.</p></section>
    <aside><h3>More</h3><p>no</p></aside><form><p>no</p><input value="no"><textarea>no</textarea></form><footer><p>&copy; no</p></footer>"""
    assert h.main_texts([page], h.train()) == ["A title here\nFirst line & more of it.\nSecond <b> line goes on éé.\nOne thing to say\nAnother thing to say\nLast line of text here."]


def test_markup_that_is_cut_off_or_deep():
    deep = "<article>" + "<div>" * 5000 + "<p>deep words that stay here</p>"
    texts = h.main_texts(["", "<", "<p", "<p>a<", "<!--", "<script>", deep, "<article><p>" + "word " * 50_000 + "</p></article>", '<article><p title="a>b">quoted sign is no text.</p>'], h.train())
    assert texts[0] == "" and texts[4] == "" and texts[5] == ""
    assert texts[6] == "deep words that stay here" and len(texts[7]) == 50_000 * 5 - 1 and texts[8] == "quoted sign is no text."


def test_raw_elements_without_an_end_tag():
    before, after = "<article><p>A line of text before it.</p>", "<p>A line of text after it.</p>"
    both = "A line of text before it.\nA line of text after it."
    odd = ["<svg class=i />", "<svg/>", "<SVG CLASS='a>b'/>", "<math/>", "<select>", "<object data=x>", "<template>", "<svg>", "<noscript>", "<iframe src=x>"]
    closed = ["<svg><svg/><text>no</text></svg>", "<svg><svg>no</svg>no</svg>", "<select><option>no</select >", "<object>no<!-- <object> -->no</object>", "<noscript>no<script>'<noscript>'</script>no</noscript\n>", "<svg>no</svgx>no</svg>", "<svg>no</svg"]
    pages = [before + x + after + "</article>" for x in odd] + [before + x + after + f"</article><{n}>no</{n}>" for x, n in (("<svg>", "svg"), ("<svg/>", "svg"), ("<select>", "select"))]
    pages += [before + x + after for x in closed[:-1]]
    texts = h.main_texts(pages, h.train())
    assert texts == [both] * len(pages)
    shut = h.main_texts([before + closed[-1], before + "<textarea>" + after, before + "<script>" + after, before + "<style>no</styles>" + after], h.train())
    assert shut == ["A line of text before it."] * 4


def test_letters_whose_lower_case_is_longer():
    many = "İ" * 60
    pages = [f"<head><title>{many}</title></HEAD><article><p>{many}.</p>{x}<p>A line of text after it.</p></article>" for x in ("<script>no</SCRIPT>", "<style>no</style>", "<svg>no</SVG>", "<SELECT>no</select>", "<svg/>")]
    assert h.main_texts(pages, h.train()) == [f"{many}.\nA line of text after it."] * len(pages)


def test_head_without_its_end_tag():
    line = "<article><header><h1>A title here</h1></header><p>A line of text after it.</p></article>"
    starts = ["<html><head><title>no</title>", "<head><title>no</title></head>", "<head><title>no</title><body>", "<head>no</HEAD >", "<head><title>no</title><style>p{}</style>"]
    assert h.main_texts([x + line for x in starts], h.train()) == ["A title here\nA line of text after it."] * len(starts)


def test_deep_pages_and_unmatched_end_tags_take_linear_time():
    h.train()
    began = time.perf_counter()
    many = "<article>" + "<div>" * 20_000 + "<p>deep words that stay here.</p>" + "</section></li>" * 20_000 + "<ul><li><dl>" + "<li></li>" * 20_000 + "</article>"
    assert h.main_texts([many], h.train())[0].startswith("deep words that stay here.")
    assert time.perf_counter() - began < 2


def test_a_narrow_level_is_worked_on_as_a_wide_one(monkeypatch):
    pages = [h.Page(x) for x in ["<article><div class=ad><p>a b c</div><p>Some text.", "<nav><ul><li><a>x</a><li>y</ul></nav><p>z"]]
    narrow = h.Forest(pages).marginals(*h.train())
    monkeypatch.setattr(h, "NARROW", 0)
    assert np.allclose(narrow, h.Forest(pages).marginals(*h.train()))


def test_a_long_page_of_tags_in_bounded_memory():
    tracemalloc.start()
    page = "<article>" + "<p>a<b>c</b>" * 440_000 + "</article>"
    assert len(page) > 5_000_000 and h.main_texts([page], h.train())[0].count("\n") == 439_999
    assert tracemalloc.get_traced_memory()[1] < 500e6
    tracemalloc.stop()


def test_forests_of_any_size_give_the_same(monkeypatch):
    pages = [x.replace(h.MARK, "") for x in h.labelled_pages(30, 5)]
    whole = h.main_texts(pages, h.train())
    monkeypatch.setattr(h, "FOREST_NODES", 40)
    assert h.main_texts(pages, h.train()) == whole


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["<p>", "</p>", "<div class='ad'>", "</div>", "<a href=x>", "</a>", "text & ", "<", ">", '"', "<!--", "-->", "<ul><li>", "</ul>", "<table><tr><td>", "&#x41;", "<script>", "</script>", "<body>", "</html>", "é"]), max_size=40))
def test_any_markup(parts):
    h.main_texts(["".join(parts)], h.train())


def test_table(spark):
    rows = [(1, "u", "<article><p>A line of text.</p></article>", "x"), (2, None, None, "x"), (3, "u", "", "x"), (1, "u", "<article><p>A line of text.</p></article>", "x")]
    got = h.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string"), ["page_id", "url"]).collect()
    assert sorted((r.page_id, r.text, r.n_chars) for r in got) == [(1, "A line of text.", 15)] * 2 + [(2, "", 0), (3, "", 0)]
