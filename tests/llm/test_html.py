import html
import re

import pandas as pd

from cases import SF
from dealerlens.llm import html_extract as op
from dealerlens.llm.labelled_pages import labelled_pages


def article(page):
    """The blocks of the one article element of the test pages, by plain text rules."""
    inner = page[page.index("<article>") + 9:page.rindex("</article>")]
    blocks = (" ".join(html.unescape(b.replace("<br>", " ").replace("<b>", "").replace("</b>", "")).split())
              for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
    return "\n\n".join(b for b in blocks if b)


def test_marginals_match_enumeration():
    import itertools
    import math

    tree = op.parse("<div class=content><p>one two three</p><p>four</p></div>")
    model = op.fit()
    odds = [sum(model.weights.get(f, 0) for f in fs) for fs in op.node_features(tree)]
    psi = op._potentials(model.pairs)
    total, on = 0.0, [0.0] * len(odds)
    for y in itertools.product((0, 1), repeat=len(odds)):
        w = math.exp(sum(a * b for a, b in zip(odds, y, strict=True)))
        for k in range(1, len(odds)):
            w *= psi[op._KIND.get(tree.tag[k], op._KIND["other"])][y[tree.parent[k]]][y[k]]
        total += w
        on = [a + w * b for a, b in zip(on, y, strict=True)]
    assert all(abs(a / total - b) < 1e-9 for a, b in zip(on, op.marginals(tree, model), strict=True))


def test_held_out_labelled_pages():
    model, wrong, n = op.fit(), 0, 0
    for page in labelled_pages(2, seed=11):
        tree = op.parse(page)
        labels = op._labels(tree)
        p = op.marginals(tree, model)
        texts = [k for k, t in enumerate(tree.tag) if t == "text"]
        n += len(texts)
        wrong += sum((p[k] >= 0.5) != labels[k] for k in texts)
    assert wrong / n < 0.02


def test_parsing_rules():
    tree = op.parse("<p>a &amp;amp; b<br>c &lt;d&gt;<p>e<!-- x --><ul><li>f<li>g</ul><script>if (a<b) '</p>'</script>x < y</p></div>")
    assert [t for t in tree.text if t] == ["a &amp; b c <d>", "e", "f", "g", "x < y"]


def test_attributes_and_slashes():
    pages = {
        "<p>a</p><script src=/js/>var x = 'menu'; call(x);</script><p>b</p>": ["a", "b"], '<script src="x"/>code()</script><p>t</p>': ["t"],
        "<article><div/><p>in</p></article><p>out</p>": ["in", "out"], "<p title=Bob's>The first one</p><p>x</p>": ["The first one", "x"],
        "<div data-u=/x/><p>in</p></div><p>after</p>": ["in", "after"], "<svg/><p>k</p>": ["k"], "<svg width=10/><path/></svg><p>k</p>": ["k"],
        "<p = x>y</p>": ["y"], '<a href="a>b">z</a>': ["z"], "<p a='>' b>c</p>": ["c"], "<option value=/><p>k</p>": [], "a <b c < d": ["a <b c < d"]}
    for page, texts in pages.items():
        assert [t for t in op.parse(page).text if t] == texts, page
    within = op.parse("<article><div/><p>in</p></article><p>out</p>")
    assert within.tag[within.parent[within.parent[within.text.index("in")]]] == "div"


def test_long_broken_markup_is_read_in_one_go():
    import time

    began = time.time()
    for page in ("<" + "a" * 300_000, "<p " + "a=b " * 100_000, "<a " * 100_000, "<a b='" * 60_001, "=" * 100_000, "<p a=" + "/" * 300_000):
        op.parse(page)
    assert time.time() - began < 30


def test_edge_cases(spark):
    page = "<nav><a href=x>Home</a></nav><article><h1>A title of it</h1><p>A first paragraph, of some length.</p></article>"
    deep = "<div>" * 3000 + page + "</div>" * 3000
    rows = [(1, "u", page), (1, "u", page), (2, None, None), (None, "v", ""), (3, "w", "<p"), (4, "x", deep)]
    df = spark.createDataFrame([(*r, None) for r in rows], "page_id long, url string, html string, text string")
    got = sorted(((r.page_id, r.url, r.text) for r in op.extract_text(df).collect()), key=repr)
    main = "A title of it\n\nA first paragraph, of some length."
    assert [g for g in got if g[0] in (1, 2, None)] == sorted([(1, "u", main)] * 2 + [(2, None, ""), (None, "v", "")], key=repr)
    assert len(got) == 6
    assert op.extract_text(df.limit(0)).collect() == []


def test_query_matches_the_articles(spark):
    pages = pd.read_parquet(f"{SF}/pages.parquet")
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in op.op4_html(spark, SF).collect()}
    assert got == {i: (u, article(h), len(article(h))) for i, u, h in zip(pages.page_id, pages.url, pages.html, strict=True)}


def test_end_tags_let_out_and_raw_text():
    def texts(page):
        return [t for t in op.parse(page).text if t]

    assert texts("<html><head><meta charset=utf-8><title>T</title><link rel=x><style>p {}</style><body><p>one<p>two") == ["one", "two"]
    assert texts("<head><title>T</title><article><p>one</article>") == ["one"]
    assert texts("<p>a</p><datalist><option>x<option value=y>z</datalist><p>b</p>") == ["a", "b"]
    assert texts("<p>a</p><script>var s = '<!-- <p>no';</script><p>b</p>") == ["a", "b"]
    assert texts("<svg><script>'</svg>'</script><text>no</text></svg><p>b</p>") == ["b"]
    assert texts("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>x=2</annotation></math> holds</p>") == ["so x=2 holds"]
