import random

from helpers import SF

from cytoframe.llm import html, queries


def test_common_subsequences_are_longest():
    r = random.Random(1)
    for _ in range(2000):
        a, b = ([r.randrange(4) for _ in range(r.randrange(9))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = html.shared_lines(a, b)
        rest = iter(b)
        assert len(got) == table[-1][-1] and all(a[i] in rest for i in got)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var x="</p>";</script></head><body>
<header>Site</header><nav><a href="/">Home</a></nav><div class="ad">Buy</div><div id="cookie-notice">ok?</div>
<article><h1>Title &amp; more</h1><p><b>One  two<br><p>three&nbsp;four &lt;x&gt;<aside>related</aside><div class="comments"><p>first!</p></div><form>mail</form></article>
<div>%s</div><p>Only here %d</p><footer>&copy;</footer></body></html>"""


def test_elements_decide_furniture_and_articles():
    got = html.page_lines(PAGE % ("shared", 1))
    assert [t for t, s in got if s == html.KEPT] == ["Title & more", "One two", "three four <x>"]
    assert [t for t, s in got if s == html.FREE] == ["shared", "Only here 1"]
    assert html.page_lines(None) == [] and html.page_lines("plain &amp; text") == [("plain & text", html.FREE)]


def test_lines_shared_with_the_nearest_page_go(spark):
    rows = [(i, f"http://h{i % 2}.org/a/{i}", PAGE % ("menu of host %d" % (i % 2), i)) for i in range(6)]
    rows += [(9, "http://alone.org/x", PAGE % ("kept, as nobody shares it", 9)), (10, None, None), (None, "::bad[", ""), rows[0], (11, "http://h0.org/a/9", "<p>no article here</p><p>menu of host 0</p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = html.main_text(df).collect()
    assert len(out) == len(rows)
    by = {r.page_id: r for r in out if r.page_id not in (0,)}
    article = "Title & more\nOne two\nthree four <x>"
    assert by[1].text == article + "\nOnly here 1" and by[9].text == article + "\nkept, as nobody shares it\nOnly here 9"
    assert by[10].text == "" and by[None].text == "" and by[11].text == "no article here"
    assert len({r.text for r in out if r.page_id == 0}) == 1
    assert html.main_text(df.limit(0)).collect() == []


def test_marks_on_what_wraps_the_page_or_holds_its_text_do_not_count():
    article = "<article><h1 class='post-header'>T</h1><p class='social'>one</p><blockquote id='search'>two</blockquote></article>"
    wrap = ('<div class="page no-sidebar">%s</div>', '<form id="aspnetForm">%s</form>', '<div class="tag-search">%s</div>', "%s")
    for w in wrap:
        page = "<body>" + w % (article + '<ol class="comment-list"><article class="comment-body"><p>' + "first! " * 90 + "</p></article></ol>") + "<nav>menu</nav></body>"
        assert [t for t, s in html.page_lines(page) if s == html.KEPT] == ["T", "one", "two"], w
        assert [s for t, s in html.page_lines(page) if t not in ("T", "one", "two")] == [html.GONE] * 2
    assert [s for _, s in html.page_lines("<body><form><p>all of it</p></form></body>")] == [html.FREE]


def test_long_pages_are_compared_in_halves(monkeypatch):
    r = random.Random(2)
    for size, table in ((40, 16), (300, 1000)):
        a, b = ([r.randrange(30) for _ in range(size)] for _ in range(2))
        whole = len(html.shared_lines(a, b))
        monkeypatch.setattr(html, "TABLE", table)
        got = html.shared_lines(a, b)
        monkeypatch.undo()
        rest = iter(b)
        assert len(got) == whole and all(a[i] in rest for i in got) and got == sorted(set(got))


def test_mirrors_take_nothing_and_differencing_counts_what_it_deletes(spark):
    body = "<div>Welcome to the site</div>" + "".join(f"<p>story line {i}</p>" for i in range(6))
    rows = [(1, "http://m.org/a/1", body), (2, "http://m.org/a/1?print", body), (3, "http://m.org/a/2", "<div>Welcome to the site</div><p>other</p><p>text</p><p>here</p><nav>Welcome to the site</nav>")]
    by = {r.page_id: r for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    story = "\n".join(f"story line {i}" for i in range(6))
    assert by[3].text == "other\ntext\nhere" and (by[3].n_lines, by[3].n_shared, by[3].n_marked) == (5, 1, 1)
    assert {by[1].text.removeprefix("Welcome to the site\n"), by[2].text.removeprefix("Welcome to the site\n")} == {story}


def test_clashing_columns_and_long_pages(spark):
    from pyspark.sql import functions as F

    page = "<article>" + "".join(f"<p>line {i}</p>" for i in range(20_000)) + "</article>"
    df = spark.createDataFrame([(1, "http://a.org/1", page), (1, "http://a.org/1", page), (2, "http://a.org/2", None)], "page_id long, url string, html string")
    df = df.withColumns({c: F.lit("x") for c in ("key", "host", "path", "lines", "rank", "shared", "text", "n_lines")})
    out = html.main_text(df).collect()
    assert [len(r.text.split("\n")) for r in out if r.page_id == 1] == [20_000] * 2 and [r.text for r in out if r.page_id == 2] == [""]


def test_op5_is_the_article_of_every_page(spark):
    import re
    from html import unescape

    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = queries.op5_html_main_text(spark, SF).collect()
    assert len(got) == len(pages)
    for r in got:
        body = re.search(r"<article>(.*?)(?:</article>|<footer|$)", pages[r.page_id].html, re.S)[1]
        lines = (" ".join(unescape(x).split()) for x in re.split(r"</?(?:p|h1|br)>", body.replace("<b>", "").replace("</b>", "")))
        assert r.text == "\n".join(x for x in lines if x) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_heads_end_where_something_else_begins():
    text = lambda page: [t for t, state in html.page_lines(page) if state != html.GONE]
    assert text("<html><head><title>x</title><meta charset=utf-8><body><article><p>one") == ["one"]
    assert text("<head><title>x</title><link rel=y><noscript>n</noscript><article><p>one</article>") == ["one"]
    assert text("<head><style>p{}</style> \n plain text<p>more") == ["plain text", "more"]
    assert text("<head><title>x</title></head><body><p>one") == ["one"]


def test_names_inside_an_article_and_open_furniture_before_it():
    kept = lambda page: [t for t, state in html.page_lines(page) if state == html.KEPT]
    page = '<article><p>a</p><div class="search-results">b</div><figure class="header-image"><img><figcaption>c</figcaption></figure><div class="site-search">d</div><div class="notice">e</div></article>'
    assert kept(page) == ["a", "b", "c"]
    assert [t for t, state in html.page_lines("<aside><p>ad<article><p>one</article>") if state != html.GONE] == ["one"]
    assert kept('<div class="header-wrap banner"><article><p>one</article></div>') == ["one"]
