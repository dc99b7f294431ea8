import time
from html.parser import HTMLParser

import pytest

from lorebed.llm import html_text
from lorebed.llm.html_text import Page

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header><h1>Site</h1></header>
<nav><ul><li>menu</li></ul></nav><div class="cookie-notice">We use cookies</div><main><article><header><h2>Head &amp; line</h2></header>
<p>One<br>two &nbsp; three<p>Four <b>b<i>old</b></i> x<ul><li>l1<li>l2</ul><table><tr><td>a<td>b</table><aside>side</aside>
<form><p>field</p></form><section id="comments"><p>reader</p></section><script>if(a<b){"</p>"}</script>5 < 6 and<pre>  x
 y</pre></article></main><div class='ad'>buy</div><footer>foot</footer></body></html>"""


@pytest.mark.parametrize(
    "source,text",
    [
        (PAGE, "Head & line\nOne two three\nFour bold x\nl1\nl2\na b\n5 < 6 and\nx y"),
        (None, ""),
        ("", ""),
        ("plain", "plain"),
        ("<p", ""),
        ("<!-- never ends", ""),
        ("<script>x", ""),
        ("<p>x</q></p></p>y", "x\ny"),
        ("<nav>m</nav>z", "z"),
        ('<div id="header">h</div><div class="post-content"><h1 class="ad">T</h1><p class="ad">buy</p><p>x</p></div><div>rest</div>', "T\nx"),
        ("<div class=content>side<article>a<div class='reader-comment'>c</div></article></div>", "a"),
        ("<article><p>a <button>press <b>me</b></button>b</article>", "a b"),
        ("<div role=main><span class=ads>b</span>w</div>v", "w"),
        ("<p title='>'>q</p>", "q"),
        ("a &lt;b&gt; &#233;&eacute; &unknown; &am", "a <b> éé &unknown; &am"),
    ],
)
def test_text(source, text):
    assert Page(source).text() == text


def _pages(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in rows], "page_id long, url string, html string, host string, template string")


def test_site_template_goes_and_copied_articles_stay(spark):
    share = "<div class=bar>Follow us on the town square</div>"
    rows = [(i, f"https://a.example.org/{i}", f"<body><div>Welcome to our site</div><p>Own text {i}</p>{share}</body>") for i in range(10)]
    rows += [(100 + i, f"https://b.example.org/{i}", "<body><article><p>A copied story.</p></article></body>") for i in range(8)]
    rows += [(200 + i, f"https://c.example.org/{i}", f"<body><div>Welcome to our site</div><p>Page {i}</p></body>") for i in range(2)]
    rows += [(300 + i, "https://d.example.org/", "<body><p>Nothing but this</p></body>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, rows)).collect()}
    assert all(got[i] == f"Own text {i}" for i in range(10))
    assert all(got[100 + i] == "A copied story." for i in range(8))
    assert all(got[200 + i] == f"Welcome to our site\nPage {i}" for i in range(2))  # too few pages to tell a template
    assert all(got[300 + i] == "Nothing but this" for i in range(6))  # a page is never emptied by its template


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "x", "<p>a</p>"), (2, "https://h/", ""), (3, "https://h/", "<p>b</p>" * 5000)]
    got = html_text.extract(_pages(spark, rows)).collect()
    assert sorted(((r.page_id, r.url, r.n_chars) for r in got), key=repr) == sorted(
        [(1, None, 0), (1, None, 0), (None, "x", 1), (2, "https://h/", 0), (3, "https://h/", 9999)], key=repr
    )
    assert html_text.extract(_pages(spark, [])).count() == 0


def _prose(k):
    return " ".join(f"w{k}x{j}" for j in range(40))


def test_template_goes_inside_articles_and_copied_prose_stays(spark):
    bar = "<div class=x1>Tell your friends</div><p>Follow us on the town square</p>"
    page = "<body><article><h1>Head {0}</h1><p>{1}</p>" + bar + "</article></body>"
    rows = [(i, f"https://a.example.org/{i}", page.format(i, _prose(i))) for i in range(12)]
    # near copies of one article, a third of the host, each with a date of its own
    rows += [(100 + i, f"https://a.example.org/c{i}", page.format("copy", f"{_prose('c')}</p><p>{_prose('d')}</p><p>On day {i}")) for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, rows)).collect()}
    assert all(got[i] == f"Head {i}\n{_prose(i)}" for i in range(12))
    assert all(got[100 + i] == f"Head copy\n{_prose('c')}\n{_prose('d')}\nOn day {i}" for i in range(6))


def test_a_teaser_does_not_silence_the_article():
    source = f"<article>Read also this</article><div><h1>Head</h1><p>{_prose(1)}</p><p>{_prose(2)}</p></div>"
    assert Page(source).text() == f"Read also this\nHead\n{_prose(1)}\n{_prose(2)}"
    assert Page(source.replace("<div>", "<div class=story>")).text() == f"Read also this\nHead\n{_prose(1)}\n{_prose(2)}"
    assert Page(f"<article><p>{_prose(1)}</p></article><div><p>{_prose(2)[:90]}</p></div>").text() == _prose(1)


def test_menus_on_many_pages_of_a_large_host_go_and_near_copies_stay(spark):
    menu = "<div class=s>In this part: fields and woods</div>"
    rows = [(i, f"https://a.example.org/{i}", f"<body>{menu if i < 60 else ''}<h1>Head {i}</h1><p>{_prose(i)}</p></body>") for i in range(400)]
    rows += [(1000 + i, f"https://b.example.org/{i}", f"<body><p>{_prose(i)}</p></body>") for i in range(12)]
    # near copies without an article element, and exact copies, which count as one page
    rows += [(2000 + i, f"https://b.example.org/c{i}", f"<body><p>{_prose('c')}</p><p>{_prose('d')}</p><p>On day {i}</p></body>") for i in range(6)]
    rows += [(3000 + i, "https://b.example.org/e", "<body><h1>Same head</h1><p>Short prose</p></body>") for i in range(9)]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, rows)).collect()}
    assert all(got[i] == f"Head {i}\n{_prose(i)}" for i in range(400))
    assert all(got[2000 + i] == f"{_prose('c')}\n{_prose('d')}\nOn day {i}" for i in range(6))
    assert all(got[3000 + i] == "Same head\nShort prose" for i in range(9))


N = 200_000


@pytest.mark.parametrize(
    "source",
    [
        "<a " * N, '<a href="' * N, "<a href='x\" " * N, "<b>" * N, "<div>a" * N, "<div>a" * N + "</div>" * N, "<p><button>" + "<div>" * N,
        "<" * N, "<!--" * N, "<ul><li>" * N, "<dl><dd>" * N, "<table><tr><td>" * (N // 2), "&" * N, "<p>&#" + "9" * N + ";", "<a " + "=" * N,
        "<a " + "class='" * N + ">", "<script>" * N, "</" * N, "<p><b>" * N + "</p>" * N, "<b><i>" * N + "</b>" * N,
    ],
)
def test_hostile_markup_is_read_in_linear_time(source):
    began = time.process_time()
    page = Page(source)
    page.hashes()
    page.text({key for key, *_ in page.subtrees[::2]})
    assert time.process_time() - began < 20  # a quadratic reader takes hours


@pytest.mark.parametrize(
    "source,text",
    [
        ("<p class=\"a>b</p><p>c</p>\">d", "d"),  # a quote goes on to its end
        ("<p class=\"a>b</p>", ""),
        ("<p a'b>c", "c"),  # only after = does a quote open a value
        ("<p a=b'c>d", "d"),
        ("<p a = '>'>d", "d"),
        ("a<!-->b<!--->c<!-- > -->d<!x>e</>f</ x>g", "abcdefg"),
        ("<p>&#" + "0" * 5000 + "65; &#" + "9" * 5000 + "; &#x" + "0" * 5000 + "42;", "A \ufffd B"),
    ],
)
def test_markup_is_read_as_browsers_do(source, text):
    assert Page(source).text() == text


class _Tree(HTMLParser):
    """Well-formed pages as nested lists: a plain reading of subtrees."""

    def __init__(self, source):
        super().__init__()
        self.stack = [["root"]]
        self.feed(source)

    def handle_starttag(self, tag, attrs):
        self.stack.append([tag, dict(attrs).get("class", "")])
        self.stack[-2].append(self.stack[-1])

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1].append(data.strip())


def _subtrees(node):
    for child in node[1:]:
        if isinstance(child, list):
            yield child
            yield from _subtrees(child)


def _plain_text(node, template):
    return [y for x in node[2:] if repr(x) not in template for y in ([x] if isinstance(x, str) else _plain_text(x, template))]


def test_templates_against_a_plain_count_of_subtrees(spark):
    """Divisions of words on some pages of some hosts: which go is a matter of counts alone."""
    import random

    rnd = random.Random(3)
    parts = [f"<div class=c{k}><div>label {k}</div><div>more {k}</div></div>" for k in range(12)]
    rows = []
    for host in range(6):
        for i in range(rnd.choice([4, 9, 30])):
            own = "".join(part for k, part in enumerate(parts) if rnd.random() < (0.9 if k % 6 == host else 0.04))
            rows.append((len(rows), f"https://h{host}.org/{i}", f"<body><div>{_prose(len(rows))}</div>{own}<div>end {len(rows)}</div></body>"))
    trees = {i: _Tree(h).stack[0][1] for i, _, h in rows}
    host_of = {i: u.split("/")[2] for i, u, _ in rows}
    pages = {h: [i for i in trees if host_of[i] == h] for h in set(host_of.values())}
    has = {i: {repr(x) for x in _subtrees(["root", trees[i]])} for i in trees}
    told = {}
    for h, own in pages.items():
        for x in set().union(*(has[i] for i in own)):
            n, other = sum(x in has[i] for i in own), sum(x in has[i] for i in trees if host_of[i] != h)
            lifted = n * (len(trees) - len(own)) >= 10 * other * len(own)
            if len(own) >= 5 and n >= 5 and n >= 0.2 * len(own) and (lifted or 2 * n >= len(own)):
                told.setdefault(h, set()).add(x)
    want = {i: "\n".join(_plain_text(trees[i], told.get(host_of[i], set()))) for i in trees}
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, rows)).collect()}
    assert got == want
    assert sum(want[i] != "\n".join(_plain_text(trees[i], set())) for i in want) > 30  # pages that the template changes


def test_passages_that_recur_on_all_hosts_stay(spark):
    """A line that many documents share is no site's template, however many pages of a large host have it."""
    line = "<p>A line that a seventh of all documents share.</p>"
    rows = [
        (i, f"https://{'big' if i < 400 else f'h{i % 20}'}.org/{i}", f"<body><article><h1>Head {i}</h1><p>{_prose(i)}</p>{line if i % 7 == 0 else ''}</article></body>")
        for i in range(700)
    ]
    got = {r.page_id: r.text for r in html_text.extract(_pages(spark, rows)).collect()}
    assert all(got[i].endswith("documents share.") == (i % 7 == 0) for i in got)
