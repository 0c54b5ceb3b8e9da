"""The tree model: exact inference against enumeration, held-out pages, broken markup, odd rows."""
import itertools
import re

import numpy as np
import pytest

from millrace.llm import html_extract as H
from millrace.llm import labelled_pages


@pytest.fixture(scope="module")
def model():
    return H.train(labelled_pages.labelled_pages(250))


def test_marginals_are_those_of_enumeration():
    forest = H.Forest()
    forest.add("<div class=a><p>one<p>two <b>three</b></div><ul><li>x<li>y</ul>", 0)
    parent, _, kind, features, nodes = forest.arrays()
    rng = np.random.default_rng(1)
    m = H.Model(rng.normal(size=H.FEATURES), rng.normal(size=(H.KINDS, 2, 2)))
    own = np.bincount(nodes, m.unary[features], len(parent))
    total, ones = 0.0, np.zeros(len(parent))
    for y in itertools.product((0, 1), repeat=len(parent)):
        w = np.exp(sum(own[i] * y[i] for i in range(len(y))) + sum(m.pair[kind[i], y[parent[i]], y[i]] for i in range(1, len(y))))
        total += w
        ones += w * np.array(y)
    assert np.allclose(m.beliefs(forest)[0], ones / total)


def test_held_out_pages(model):
    pages = labelled_pages.labelled_pages(150, seed=5)
    got = [x.split("\n\n") for x in model.texts([h for h, _ in pages])]
    want = [t.split("\n\n") for _, t in pages]
    right = sum(len(set(a) & set(b)) for a, b in zip(got, want))
    assert right > 0.97 * sum(len(set(a) | set(b)) for a, b in zip(got, want))


def test_the_tables_pages(spark):
    from millrace.llm import queries

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in queries.op2_tree_model_extraction(spark, "/root/testdata/sf0.01").collect()}
    for r in pages.collect():
        inner = r.html[r.html.index("<article>") + 9 : r.html.index("</article>")]
        blocks = [" ".join(H.html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        assert got[r.page_id] == "\n\n".join(b for b in blocks if b)


def test_markup_is_read_as_browsers_do():
    forest = H.Forest()
    forest.add(
        "<p>a &lt;b&gt; &amp c&nbsp;d<br>e <p>f<b>g</b>h<!-- no --><script>'<p>no</p>'</script> i</div><table><tr><td>j<td>k</table><li>l<li>m < n<a href='x>y'>o</a><style>no", 0
    )
    assert [t for _, t in forest.leaves] == ["a <b> & c d e", "fgh", "i", "j", "k", "l", "m < no"]


def test_deep_elements_close_only_themselves():
    for deep in (10, 300, 20_000):
        forest = H.Forest()
        forest.add("<section><div><p>a</p>" + "<div>" * deep + "deep" + "</div>" * deep + "<p>b</div><p>c</section><p>d", 0)
        place = {t: forest.parent[forest.parent[n]] for n, t in forest.leaves}  # the parent of each leaf's own element
        assert [t for _, t in forest.leaves] == ["a", "deep", "b", "c", "d"] and max(forest.depth) == deep + 3
        assert place["a"] == place["b"] and forest.parent[place["b"]] == place["c"] and forest.parent[place["c"]] == place["d"]


def test_a_deep_sidebar_stays_one(model):
    body = "".join(f"<p>Some words of the article, number {i}, said here at length and with a full stop.</p>" for i in range(6))
    for deep in (10, 250, 5000):
        side = "<aside class=sidebar><ul>" + "<div class=widget>" * deep + "<a href=x>more</a>" + "</div>" * deep + "<li><a href=y>Popular now</a></ul></aside>"
        got = model.texts([f"<html><body><article><h1>Head</h1>{body}</article>{side}<footer>us</footer></body></html>", f"<html><body>{side}<article><h1>Head</h1>{body}</article></body></html>"])
        assert got[0] == got[1] and "Popular" not in got[0] and got[0].count("full stop") == 6


def test_broken_markup_takes_linear_time():
    """Half a million unended tags, quotes, comments, and elements that look through others: seconds, not hours."""
    import time

    n, began = 500_000, time.perf_counter()
    sources = ["<p" * n, "<p" * n + ">", "<p a=\"" * n, "<p a='>" * n, "<!--" * n, "</div" * n, "<script>" * n, "<tr><table>" + "<div>" * n + "<tr></tr>" * n, "<div>" * n + "<p>" * n, "<li>" * n, "<" * n, "&" * n]
    for source in sources:
        forest = H.Forest()
        forest.add(source, 0)
        assert len(forest.parent) <= 2 * n + 3
    assert time.perf_counter() - began < 120


def test_odd_rows(spark, model):
    article = "<html><body><nav><a href=x>menu</a></nav><article><h1>Head</h1>" + "<p>Some words of text, said here.</p>" * 3 + "</article><footer>&copy; us</footer>"
    deep = "<div>" * 3000 + "<p>deep" + "</div>" * 3000
    rows = [(1, "u", article), (1, "u", article), (2, None, None), (None, "v", ""), (3, "w", "no markup"), (4, "x", "<" * 500 + "<p" * 500), (5, "y", deep), (6, "z", article.replace("</article>", "<p>" + "long " * 100000 + "</article>"))]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS text", "2 AS n_chars")
    got = H.extract(df, model).collect()
    assert len(got) == len(rows) and all(r.n_chars == len(r.text) for r in got)
    text = "Head" + "\n\nSome words of text, said here." * 3
    assert [r.text for r in got if r.page_id == 1] == [text, text]
    assert [r.text for r in got if r.page_id in (2, None)] == ["", ""]
    assert next(r.n_chars for r in got if r.page_id == 6) == len(text) + 2 + 499999
    assert H.extract(df.limit(0), model).count() == 0
