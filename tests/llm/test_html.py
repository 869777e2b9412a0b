import html
import re
import time

from graphloom.llm import html_text, queries

LONG = "Some words that make up a paragraph of the main text, long enough to tell it from menus and notices. "


def test_given_pages(spark):
    """On the driver's pages the article element holds the main text and nothing else."""
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").toPandas()
    got = {r.page_id: r.text for r in queries.op9_html(spark, "/root/testdata/sf0.01").collect()}
    assert len(got) == len(pages)
    for page in pages.itertuples():
        inner = re.search("<article>(.*)</article>", page.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub("<[^>]+>", "", part)).split()) for part in re.split("</?(?:p|h1)>", inner)]
        assert got[page.page_id] == "\n".join(x for x in want if x)


def test_page_without_article_element():
    page = f"""<html><head><title>T</title></head><body><header><a href=/>Home</a></header>
    <div class="menu"><ul><li><a href=/a>One</a></li><li><a href=/b>Two</a></li></ul></div><div id="cookie-notice">{LONG}</div>
    <h1>A heading for it all</h1><p>{LONG * 2}</p><p>Short.</p><p>{LONG} <a href="x>y">with a link</a> &amp; more&nbsp;text</p>
    <form><p>{LONG}</p><input value="x"></form><div class="comments"><p>{LONG}</p></div><footer>{LONG}</footer></body></html>"""
    text = html_text.main_text(page)
    assert text.split("\n") == ["A heading for it all", " ".join((LONG * 2).split()), "Short.", LONG + "with a link & more text"]


def test_parts_of_an_article_that_are_none():
    page = f"""<main><h1>Title</h1><p>{LONG}</p><aside><p>{LONG}</p></aside><script>if (a < b) document.write("<p>no</p>")</script>
    <style>p > a {{}}</style><!-- <p>no</p> --><p>a &lt;b&gt; c</p><section id="comments"><p>{LONG}</p></section></main>"""
    assert html_text.main_text(page) == f"Title\n{LONG.strip()}\na <b> c"


def test_comments_asides_and_hidden_text():
    """Comments and teasers that are article elements, paragraphs called adverts, hidden inline text; lists of links and telling names inside an article stay."""
    body = f"<article><h1>Title</h1><p>{LONG}</p>"
    others = [
        f'<div id="comments"><ol class="comment-list"><li class="comment"><article class="comment-body"><p>{LONG} said</p></article></li></ol></div>',
        f'<section id="comments"><article class="comment"><p>{LONG} said</p></article></section>',
        f'<aside><article><h2>Teaser</h2><p>{LONG}</p></article></aside>',
        f'<p class="ad">{LONG}</p>', f'<p class="cookie-notice">{LONG}</p>', f'<p hidden>{LONG}</p>', f'<div class="sidebar"><main><p>{LONG}</p></main></div>',
        f'<div role="complementary"><article><p>{LONG}</p></article></div>', f'<article class="comment even"><p>{LONG}</p></article>',
    ]
    for other in others:
        assert html_text.main_text(f"<body>{body}{other}</article></body>") == f"Title\n{LONG.strip()}", other
        assert html_text.main_text(f"<body>{body}</article>{other}</body>") == f"Title\n{LONG.strip()}", other
    assert html_text.main_text(f"{body}<p>a <span hidden>b <span>c</span> d</span> e <i style='display: none'>f</i><b hidden>g</p><p>h</p></article>") == f"Title\n{LONG.strip()}\na e\nh"
    assert html_text.main_text(f'{body}<ul><li><a href="/a">One</a></li><li><a href="/b">Two</a></li><li><a href="/c">Three</a></li></ul></article>') == f"Title\n{LONG.strip()}\nOne\nTwo\nThree"
    for name in ("notice-board", "editor-comment", "has-sidebar", "page-menu-layout"):
        assert html_text.main_text(f'{body}<section class="{name}"><p>kept</p></section></article>') == f"Title\n{LONG.strip()}\nkept", name
    for around in ('<body class="single sidebar-right comments-open">', '<div class="content-sidebar-wrap">', '<div id="menu-and-text">'):
        assert html_text.main_text(f"{around}{body}</article>") == f"Title\n{LONG.strip()}", around


def test_edges(spark):
    assert [html_text.main_text(x) for x in (None, "", "<", "<p", "</", "<!--", "<script>", "&#xD800;&")][:7] == [""] * 7
    assert html_text.main_text("<article><p>x" + "y" * 200_000) == "x" + "y" * 200_000
    assert html_text.main_text("<article>" + "<div>" * 5000 + "deep" + '<a href="' * 3) == "deep" + '<a href="' * 3
    assert html_text.main_text(f"<article><p>{LONG}<math><mi>x</mi></math> <object>in its place</object></p><noscript><p>{LONG}</p></noscript><section class='more related'><p>{LONG}</p></section></article>") == f"{LONG}x in its place\n{LONG.strip()}\n{LONG.strip()}"
    df = spark.createDataFrame([(1, None, None, "x"), (2, "u", "<article><p>a  b</p></article>", "x"), (2, "u", "<article><p>a  b</p></article>", "x")], "page_id long, url string, html string, text string")
    assert sorted((r.page_id, r.text, r.n_chars) for r in html_text.extract(df).collect()) == [(1, "", 0), (2, "a b", 3), (2, "a b", 3)]
    assert html_text.extract(df.limit(0)).count() == 0


def test_hostile_pages_in_linear_time():
    for page in ("<article>x" + '<a href="' * 110_000, "<article>" + "<div>x" * 170_000, "<article>" + "<div>" * 100_000 + "</section>" * 50_000 + "x", "<" * 1_000_000, "<a '" * 250_000 + ">", "<!--" * 250_000, "<title>" * 150_000):
        began = time.perf_counter()
        html_text.main_text(page)
        assert time.perf_counter() - began < 6, page[:40]


def test_tags_read_quotes():
    assert [t[3:] for t in html_text.tags("""a<b x='>' y=">">c</B><!-- <i> --><!doctype x><br/><u title="open>d""")] == [("b", """ x='>' y=">\""""), ("b", ""), ("", ""), ("", ""), ("br", "/"), ("u", ' title="open')]
