"""Page text: furniture, titles, odd tables and broken markup."""

import time

import pytest

from wayloom.llm import html_consensus as hc

SCHEMA = "page_id long, url string, html string, path string, host string, text string"


def text_of(html):
    return hc.extract(hc.containers(html), None)


@pytest.mark.parametrize(
    "html, want",
    [
        ("<nav>m</nav><div class='entry-header'><h1>Title</h1></div><div class='ad-hoc'><p>one two three</p></div><div class=sidebar>x</div>", "Title\n\none two three"),
        ("<article><header><h1>T</h1></header><p>lead words</p><div class=body><p>a b c d e f g h</p></div><footer>f</footer></article>", "T\n\nlead words\n\na b c d e f g h"),
        ("<header>site</header><h1>T</h1><div class='content has-sidebar no-comments'><p>a <math>x=1</math> d <object>alt</object> e</p></div><div class=site-footer>c</div>", "T\n\na x=1 d alt e"),
        ("<article><p>a b c d e</p><section id=comments><p>reader says this and more than the text</p></section><div class='cookie-banner'>ok</div></article>", "a b c d e"),
        ("<div title='x>y'><p data-q=\"it's\">5 < 6 &amp; 7 > 2&nbsp;&eacute;</p><script>var a='<p>'</script><style>p{}</style><form>f<input></form></div>", "5 < 6 & 7 > 2 é"),
        ("<p>a<br>b\n\t c<p>d", "a b c\n\nd"),
        ("", ""),
        ("<!-- open", ""),
        ("<script>open", ""),
        ("no tags", "no tags"),
    ],
)
def test_furniture_goes_and_the_article_stays(html, want):
    assert text_of(f"<html><body>{html}</body></html>" if "<!--" not in html and "<script>o" not in html else html) == want


@pytest.mark.parametrize("name, drop", [("ad", True), ("ad-hoc", False), ("site-header", True), ("site-footer", True), ("entry-footer-note", False), ("main-nav", True), ("load", False), ("comments_list", True), ("newsletter", True)])
def test_names(name, drop):
    assert hc.boilerplate(name) == drop


@pytest.mark.parametrize("piece", ["<i y ", '<i a=">" ', "<b>", "<div>x", "<p><b>", "</i>", "<li>x", "<td>x<table>", "<a href='", "<p title=don't>x ", "<!--", "<div class='a'>"])
def test_a_megabyte_of_broken_tags_takes_seconds(piece):
    began = time.process_time()
    text_of(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 8


def test_odd_tables(spark):
    rows = [
        (1, None, None), (1, "", ""), (None, "http://h/a", "<p>x y</p>"), (3, "not a url", "<p>same</p>"), (3, "not a url", "<p>same</p>"),
        (4, "http://h/long", "<article>" + "<p>word &amp; word</p>" * 20_000 + "</article>"),
    ]
    pages = spark.createDataFrame([(*r, "p", "h", "t") for r in rows], SCHEMA)
    got = sorted((r.page_id or 0, r.url or "", r.text[:13], r.n_chars) for r in hc.main_text(pages).collect())
    assert got == sorted([(1, "", "", 0), (1, "", "", 0), (0, "http://h/a", "x y", 3), (3, "not a url", "same", 4), (3, "not a url", "same", 4), (4, "http://h/long", "word & word\n\n", 20_000 * 13 - 2)])
    assert hc.main_text(pages.limit(0)).count() == 0 and len(hc.main_text(pages.limit(0)).columns) == 4


def test_paths_join_the_same_way_by_shuffle(spark, monkeypatch):
    page = lambda body, n: f"<div class='story-{n}'><h1>T</h1><p>{body}</p></div><div class='rail'><p>{'rail words ' * (60 if n == 5 else 1)}</p></div>"
    pages = spark.createDataFrame([(n, f"http://h/{n}", page("some words of a text " * 4, n)) for n in range(9)], "page_id long, url string, html string")
    first = {r.page_id: r.text for r in hc.main_text(pages).collect()}
    monkeypatch.setattr(hc, "BROADCAST_BYTES", -1)
    assert {r.page_id: r.text for r in hc.main_text(pages).collect()} == first
    assert all(t.startswith("T\n\nsome") and "rail" not in t for t in first.values())
