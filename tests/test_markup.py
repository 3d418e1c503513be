from __future__ import annotations

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tomelight.functions.markup import ended_references, markdown, tree_markdown

CASES = [
    ("<h1>Head  <em>line</em></h1><p>One <b>two</b>\nthree.</p>", "# Head _line_\n\nOne **two** three."),
    ("<ul><li>a<li>b<ul><li>c</li><li>d<ol start=3><li>e<li>f</ol></ul><li>g</ul>", "*   a\n*   b\n    *   c\n    *   d\n        3.  e\n        4.  f\n*   g"),
    ("<ol><li><p>x</p><p>y</p></li><li>z</li></ol>", "1.  x\n\n    y\n2.  z"),
    ("<blockquote><p>q</p><blockquote>in<ul><li>l</li></ul></blockquote></blockquote>", "> q\n>\n> > in\n> >\n> > *   l"),
    ('<p><img src="i.png" alt="a  b" title="t"> <img alt="none"></p>', '![a b](i.png "t")'),
    ('<a href="u(1)" title="T">x <i>y</i></a> <a>plain</a> <a href="v"></a>', '[x _y_](u\\(1\\) "T") plain'),
    ('<pre><code class="x language-py">\nif a &lt; b:\n    `c`\n</code></pre>', "```py\nif a < b:\n    `c`\n```"),
    ("<p>use <code>a`b</code> and <code>`</code></p>", "use ``a`b`` and `` ` ``"),
    ("a &amp; b &eacute; &#8364; &nosuch; &lt;p&gt;", "a & b é € &nosuch; <p>"),
    ("<p>1 * 2 _x_ [y] `z` \\</p><p>1. no list</p><p># no head</p><p>- no item</p>", "1 \\* 2 \\_x\\_ \\[y\\] \\`z\\` \\\\\n\n1\\. no list\n\n\\# no head\n\n\\- no item"),
    ("one<br>two<br/>three<hr>four", "one  \ntwo  \nthree\n\n* * *\n\nfour"),
    ("<script>x()</script><style>y</style><p>ok<noscript>no</noscript></p><!-- c -->", "ok"),
    ("<p>first<p>second<div>third <span>in <div>fourth</div></span></div></p>tail", "first\n\nsecond\n\nthird\n\nin\n\nfourth\n\ntail"),
    ("<table><tr><th>a<th>b<tr><td>c<td>d</table>", "a\n\nb\n\nc\n\nd"),
    ("<strong> spaced </strong>x<em></em>", "**spaced** x"), ("</p></div>text<b>open", "text**open**"), ("", ""), ("  \n ", ""),
]


@pytest.mark.parametrize(("html", "want"), CASES)
def test_cases(html, want):
    assert markdown(html) == want


def test_column(spark):
    deep = "<div>" * 5000 + "deep" + "</div>" * 5000
    rows = spark.createDataFrame([(0, CASES[1][0]), (1, None), (2, deep)], "k int, h string")
    got = {r["k"]: r["m"] for r in rows.select("k", tree_markdown(F.col("h")).alias("m")).collect()}
    assert got == {0: CASES[1][1], 1: None, 2: "deep"}


WORD = st.text("abcxyz", min_size=1, max_size=6)
NESTED = st.recursive(WORD, lambda inner: st.tuples(st.sampled_from(["p", "ul", "ol", "blockquote", "b", "em", "h2", "div", "li", "span"]), st.lists(inner, min_size=1, max_size=3)), max_leaves=12)


def html_of(node):
    return f" {node} " if isinstance(node, str) else f"<{node[0]}>{''.join(map(html_of, node[1]))}</{node[0]}>"


def words_of(node):
    return [node] if isinstance(node, str) else [w for c in node[1] for w in words_of(c)]


@settings(max_examples=300, deadline=None)
@given(NESTED)
def test_every_word_stays_in_order(node):
    assert re.findall("[a-z]+", markdown(html_of(node))) == words_of(node)


def test_references_that_do_not_end(spark):
    rows = spark.createDataFrame([("a &amp b &amp; c &am",), ("x&amp</h1>&lt;y&#65;",), (None,)], "h string")
    got = [r["m"] for r in rows.select(tree_markdown(ended_references(F.col("h"))).alias("m")).collect()]
    assert got == ["a &amp b & c &am", "x&amp<yA", None]
