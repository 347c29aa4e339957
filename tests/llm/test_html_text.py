import numpy as np
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sheafwork.llm import html_text as H
from sheafwork.llm.dom import blocks_of, parse

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<nav><ul><li><a href="/a">one</a></li><li><a href="/b">two</a></li><li><a href="/c">three</a></li></ul></nav>
<div class="ad">Buy this now and be happy for ever.</div>
<article><h1>On the growing of pears &amp; plums</h1><p><b>The first   paragraph is long enough, with some words,
and with a line in it.<br><p>The second one says that nothing is gained by haste, since trees grow slowly, and the ground is cold until late in spring.</p>
<p>Third: 1 &lt; 2, caf&eacute;, &#8220;quoted&#8221;. It goes on for a while so that it looks like all the others do in this text.</p></article>
<footer>&copy; somebody &middot; all rights.</footer></body></html>"""


def test_article_without_the_rest():
    (text,) = H.main_texts([PAGE], H.fitted())
    assert text == (
        "On the growing of pears & plums\n\nThe first paragraph is long enough, with some words, and with a line in it.\n\n"
        "The second one says that nothing is gained by haste, since trees grow slowly, and the ground is cold until late in spring.\n\n"
        "Third: 1 < 2, café, “quoted”. It goes on for a while so that it looks like all the others do in this text."
    )


def test_generated_pages_held_out():
    maker, model = H.PageMaker(12345), H.fitted()
    pages = [parse(maker.page()) for _ in range(150)]
    odds = model.log_odds(H.node_features(pages)).tolist()
    k = right = whole = 0
    for p in pages:
        n = len(p.parent)
        kept, label, own = np.array(H.choose(p, odds[k : k + n])), H.node_labels(p), np.array(p.own)
        right, whole, k = right + own[kept == label].sum(), whole + own.sum(), k + n
    assert right / whole > 0.98


@given(st.text(alphabet="<>/=\"' apdivul!-&;x", max_size=120))
def test_any_markup_parses_to_a_tree(page):
    p = parse(page)
    n = len(p.parent)
    assert all(p.parent[i] < i and p.end[i] <= p.end[p.parent[i]] for i in range(1, n)) and all(i < e <= n for i, e in enumerate(p.end))
    assert H.node_features([p]).shape[0] == n and np.isfinite(H.node_features([p])).all()
    blocks_of(p, [True] * n)


def test_hostile_markup_takes_linear_time():
    import time

    makers = [lambda n: "<b>" * n + "</i>" * n, lambda n: "<b>" * n + "<div></div>" * n, lambda n: "<blockquote>" * n + "<li></li>" * n, lambda n: "<tbody>" * n + "<li>" * n, lambda n: "<tr><td><dt>" * n + "<li>" * n, lambda n: "<div>" * n + "</p>" * n]
    for make in makers:
        page, began = make(40_000), time.process_time()
        parse(page)
        assert time.process_time() - began < 4  # some hundred seconds, if each tag looked through the open elements


def sound(p, kept):
    """Kept nodes stand in kept ones, and have text or a kept node in them."""
    full = {p.parent[i] for i in range(1, len(kept)) if kept[i]}
    return all(kept[p.parent[i]] and (p.own[i] or i in full) for i in range(1, len(kept)) if kept[i])


@given(st.data())
def test_no_contradictions(data):
    p = parse(PAGE)
    odds = data.draw(st.lists(st.floats(-6, 6), min_size=len(p.parent), max_size=len(p.parent)))
    assert sound(p, H.choose(p, odds))


def test_choice_is_the_best():
    p = parse("<div><p>a</p><ul><li>b</li><li>c</li></ul></div><div>d</div>")
    n = len(p.parent)
    rng = np.random.default_rng(0)
    for _ in range(60):
        odds = rng.uniform(-3, 3, n).tolist()
        kept = H.choose(p, odds)
        best = max(sum(odds[i] for i in range(1, n) if m >> i & 1) for m in range(1, 1 << n, 2) if sound(p, [bool(m >> i & 1) for i in range(n)]))
        assert abs(sum(odds[i] for i in range(1, n) if kept[i]) - best) < 1e-9


def test_table(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "v", ""), (None, "w", "<p>"), (1, "u", PAGE), (4, "x", "<article><p>" + "A long text. " * 20_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("id", F.lit("clash"))
    out = H.extract_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = sorted((str(r.page_id), r.url, r.text) for r in out.collect())
    assert [len(t) for _, _, t in got][:2] == [len(got[0][2])] * 2 and len(got) == 6
    assert {k: t for k, _, t in got}["2"] == "" and {k: t for k, _, t in got}["4"] == ("A long text. " * 20_000).strip()
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert H.extract_text(pages.filter("false")).count() == 0
