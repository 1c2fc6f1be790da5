"""Main text of pages: elements, repairs, and wrappers learned over a host's pages."""

import pytest

from changeguard.llm import html_text
from changeguard.llm.dom import align, leaves, outline, parse

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{}</style></head><body class=x><header><h1>Site</h1></header>
<nav><ul><li><a href="/a">Menu</a></ul></nav><div id="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<main><article class="post"><header><h1>A  title &amp; more</h1></header><p>First <b>bold<i> text</b> here<br>and  on
<p>Second&nbsp;block &#8212; &lt;tag&gt; <a href='x>y'>a link</a><script>var a="</p><p>no";</script>
<div class="ad-box ads">Buy</div><ul><li>One<li>Two</ul><table><tr><td>1<td>2<tr><td>3</table>
<form><p>Your mail</p><input></form><aside>Aside</aside><section class="comments"><article><p>Reader says</p></article></section>
<blockquote>Quote</blockquote><footer>By me</footer></article></main><div class="sidebar"><p>Side</p></div><footer>Foot</footer></body></html>"""


def test_article_of_one_page():
    assert html_text.main_text(PAGE) == "A title & more\nFirst bold text here and on\nSecond block — <tag> a link\nOne\nTwo\n1\n2\n3\nQuote"


@pytest.mark.parametrize("page, text", [
    ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div>a <div>b</div> c</div>", "a\nb\nc"), ("<p>x < y & z</p>", "x < y & z"),
    ("<article><p>only</p>", "only"), ("<p>a</p><script>if (a</b", "a"), ("<!-- open <p>a", ""), ("<p hidden>a</p><p style='display: none'>b</p><p>c</p>", "c"),
    ("<article>a</article><article>b</article>", "a\nb"), ("<ul><li><a href=x>link one</a><li>words of an item</ul>", "words of an item"),
    ("<article><ul><li><a href=x>link one</a></ul></article>", "link one"), ("<p title=\"broken>a</p><p>b", "a\nb"), ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"),
    ("<ARTICLE><P>Up</ARTICLE>", "Up"), ("<p>a</b></i>b</p>", "ab"), ("<table><tr><th>h<td>d</table>", "h\nd"), ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"),
])
def test_repairs(page, text):
    assert html_text.main_text(page) == text


def test_whole_long_pages():
    body = "".join(f"<p>block {i}</p><div><p>in {i}</p></div>" for i in range(6000))
    assert html_text.main_text(f"<article>{body}</article>").count("\n") == 11_999


def tree(html):
    return outline(parse(html))


def test_simple_tree_matching():
    a, b = tree("<nav>m</nav><div><h1>t</h1><p>x</p></div><footer>f</footer>"), tree("<div class=top>n</div><nav>m</nav><div><h1>u</h1><p>y<p>z</div><footer>f</footer>")
    assert align(a, a) == [(i, i) for i in range(6)]
    assert align(a, b) == [(0, 0), (1, 2), (2, 3), (3, 4), (4, 5), (5, 6)]
    assert align(tree("<p>a</p>"), tree("<p>b</p>"))[0] == (0, 0)


def page(i, body):
    return (f"<body><div class=top>Welcome to the site</div><div class=body><h2>Title {i}</h2><p>{body}</p><p class=more>Read our newsletter every day</p></div>"
            f"<div class=low>All about us</div></body>")


def test_wrapper_of_a_host(spark):
    rows = [(i, "https://h.example/p", page(i, f"Story number {i} is long and of its own kind, with words {i * 7}")) for i in range(30)]
    rows += [(100 + i, "https://h.example/copy", rows[3][2]) for i in range(60)]  # copies do not make a story template
    rows += [(200, "https://few.example/", page(200, "Alone")), (201, None, page(201, "No host")), (202, "https://h.example/", None), (203, "https://h.example/", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: r for r in html_text.extract(pages).collect()}
    assert len(got) == len(rows)
    assert got[5].text == "Title 5\nStory number 5 is long and of its own kind, with words 35"
    assert got[120].text == "Title 3\nStory number 3 is long and of its own kind, with words 21"
    assert got[200].text == "Welcome to the site\nTitle 200\nAlone\nRead our newsletter every day\nAll about us"
    assert got[202].text == got[203].text == "" and got[5].n_chars == len(got[5].text)
    assert html_text.extract(pages.limit(0)).count() == 0


def test_wrappers_by_join(spark, monkeypatch):
    rows = [(i, "https://h.example/p", page(i, f"Story {i} of its own kind, with words {i * 7}")) for i in range(30)]
    pages = spark.createDataFrame([(*r, "other") for r in rows], "page_id long, url string, html string, host string")
    want = sorted(map(tuple, html_text.extract(pages).collect()))
    monkeypatch.setattr(html_text, "BROADCAST_BYTES", -1)
    assert sorted(map(tuple, html_text.extract(pages).collect())) == want


def most(a, b):
    """Nodes of simple tree matching, by its plain recursion."""
    if a[0] != b[0]:
        return 0
    table = [[0] * (len(b[2]) + 1) for _ in range(len(a[2]) + 1)]
    for i, x in enumerate(a[2], 1):
        for j, y in enumerate(b[2], 1):
            table[i][j] = max(table[i - 1][j], table[i][j - 1], table[i - 1][j - 1] + most(x, y))
    return 1 + table[-1][-1]


def random_tree(rng, depth=0):
    label = "root" if not depth else rng.choice("abc")
    if depth and rng.random() < 0.4:
        return (label, f"1.{rng.randrange(3)}", ())
    return (label, "", tuple(random_tree(rng, depth + 1) for _ in range(rng.randrange(6 if depth < 3 else 1))))


def test_matching_against_plain_recursion():
    import random

    rng = random.Random(5)
    for _ in range(400):
        a, b = random_tree(rng), random_tree(rng)
        pairs = align(a, b)
        labels = [[t[0] for t in flat(x)] for x in (a, b)]
        assert len(pairs) == most(a, b) and pairs == sorted(pairs) and all(labels[0][n] == labels[1][m] for n, m in pairs)
        assert [m for _, m in pairs] == sorted({m for _, m in pairs})


def flat(t):
    return [t] + [n for c in t[2] for n in flat(c)]


@pytest.mark.parametrize("blocks", [20, 300, 3000])
def test_one_child_more_shifts_nothing(blocks):
    """Blocks that differ in their texts, a constant one among them, and on one page a block more in front."""
    def long_page(i, more=""):
        middle = blocks // 2
        return "<div>" + more + "".join(f"<div class=card><p>{'Same for all' if k == middle else f'{i} {k}'}</p></div><h3>{i} h {k}</h3>" for k in range(blocks)) + "</div>"

    a, b = tree(long_page(1)), tree(long_page(2, "<div class=card><p>more</p></div>"))
    own, other = html_text._digests(a), html_text._digests(b)
    equal = [(n, m) for n, m in align(a, b) if own[n] and own[n] == other[m]]
    assert len(equal) == 1 and own[equal[0][0]].startswith("12.")


def test_small_hosts_layouts_and_missing_blocks(spark):
    """Notices without a telling name on a host of three pages, in its second layout, and on pages other than the reference."""
    def three(i):
        return f"<div class=top>Welcome to the shop</div><div class=text><p>Story {i} of its own, told in {i * 31} words</p></div>"

    def second(i):
        return f"<section class=text><p>Tale {i} of another kind, in {i * 17} words of its own</p></section><section class=low><p>Call us any time</p></section>"

    def more(i):
        return f"<div class=text><p>Report {i} on matter {i * 13}, which is long enough</p></div>" + ("<div class=end><b>Buy now!</b></div>" if i % 3 else "")

    rows = [(i, "http://three.example/", three(i)) for i in range(3)]
    rows += [(100 + i, "http://two.example/", three(i) if i % 3 else second(i)) for i in range(24)]
    rows += [(200 + i, "http://more.example/", more(i)) for i in range(12)]
    rows += [(300 + i, "http://copies.example/", three(7)) for i in range(5)]  # one article only: nothing to learn from
    rows += [(400 + i, "http://hot.example/", three(i % 2 + 50 if i < 40 else i)) for i in range(60)]  # two articles with many copies
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i} of its own, told in {i * 31} words" for i in range(3))
    assert all(got[100 + i] == (f"Story {i} of its own, told in {i * 31} words" if i % 3 else f"Tale {i} of another kind, in {i * 17} words of its own") for i in range(24))
    assert all(got[200 + i] == f"Report {i} on matter {i * 13}, which is long enough" for i in range(12))
    assert got[300] == got[304] == "Welcome to the shop\nStory 7 of its own, told in 217 words"
    assert all(got[400 + i] == (lambda k: f"Story {k} of its own, told in {k * 31} words")(i % 2 + 50 if i < 40 else i) for i in range(60))


def test_leaf_texts_are_all_there():
    assert [n.text for n in leaves(parse("a<p>b</p>c<div>d<span>e</span></div>"))] == ["a", "b", "c", "de"]


def test_article_elements_of_the_table(spark):
    """The pages of the test table name their article; a plain cut must agree."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in html_text.extract(pages).collect()}
    for r in pages.collect():
        body = re.search("<article>(.*?)</article>", r.html, re.S).group(1)
        blocks = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split("</?h1>|</?p>", body)]
        assert got[r.page_id] == "\n".join(b for b in blocks if b)
