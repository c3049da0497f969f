import html
import re
import time

import pytest

from foliate.llm import main_text as mt

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"word{i}" for i in range(60))
PAGES = {
    "element": (f'<html><head><title>T</title><script>if (a<b) "</p>"</script></head><body><nav><ul><li><a href=/>Home</a><li><a href=/b>B</a></ul></nav><div class="ad">Buy now</div><article><h1>Head &amp; line</h1><p>{LONG}<p>Short\n one.<br>two &nbsp; three</p></article><footer>&copy; us</footer>', f"Head & line\n{LONG}\nShort one. two three"),
    "furniture inside": (f'<main><h1>Title</h1><p>{LONG}</p><div class="share-buttons"><a href=#>Tweet</a></div><p>More.</p><section id="comments"><h2>Comments</h2><p>{LONG} indeed</p></section></main><aside><p>{LONG}</p></aside><form><label>Mail</label><input name=x></form>', f"Title\n{LONG}\nMore."),
    "cookie notice": (f'<body><div id="cookieConsent">We use cookies and {LONG}</div><header><h2>Site</h2></header><article><header><h1>Real</h1></header><p>{LONG}</p></article></body>', f"Real\n{LONG}"),
    "no elements": (f"<body><div><a href=a>one</a></div><div><a href=b>two</a></div><h2>Plain head</h2><div>{LONG}</div><div>{LONG} again</div><div><a href=c>three</a> <a href=d>four</a></div></body>", f"Plain head\n{LONG}\n{LONG} again"),
    "inline tags": (f"<article><p>a<b>b</b>c <i>d</i>&#x41;&lt;p&gt; {LONG}</p></article>", f"abc dA<p> {LONG}"),
    "comment and quotes": (f'<article><p title="a > b">{LONG}</p><!-- <p>no</p> --><p>yes<!-- open', f"{LONG}\nyes"),
    "unclosed script": (f"<article><p>{LONG}</p><script>var x = '<p>no</p>'", LONG),
}


@pytest.fixture(scope="module")
def tree():
    return mt.grow(*mt.labelled())


def test_tree_fits_its_pages_and_begins_with_density(tree):
    rows, labels = mt.labelled()
    assert [mt.decide(tree, r) for r in rows.tolist()] == labels.astype(bool).tolist()
    assert mt.FEATURES[tree[0]] == "link"


@pytest.mark.parametrize("name", PAGES)
def test_pages(tree, name):
    page, want = PAGES[name]
    assert mt.main_text(page, tree)[0] == want


@pytest.mark.parametrize("n", [63, 64, 65, 3000])
def test_closing_tags_find_openers_at_any_depth(tree, n):
    page = f"<body><nav>{'<font>x ' * n}</nav><article><h1>Head</h1><p>{LONG}</p></article></body>"
    assert mt.main_text(page, tree)[0] == f"Head\n{LONG}"
    found, _ = mt.page_blocks(f"<article><p>{LONG}{'<span>x ' * n}</article><div>after</div>")
    assert [b.article for b in found] == [True, False]


@pytest.mark.parametrize("n", [15, 16, 17, 3000])
def test_implied_ends_at_any_depth(n):
    found, _ = mt.page_blocks(f"<table><tr><td class=ad>x{'<b>' * n}<td>y<tr><td>z{'<i>' * n}</table>w")
    assert [(b.text, b.part > 0) for b in found] == [("x", True), ("y", False), ("z", False), ("w", False)]
    found, _ = mt.page_blocks(f"<ul><li class=ad>x{'<b>' * n}<ul><li>y</ul><li>z</ul>")
    assert [(b.text, b.part > 0) for b in found] == [("x", True), ("y", True), ("z", False)]


@pytest.mark.parametrize("name", ["story-related", "post share", "login-guide", "article-comment-policy", "sidebar"])
@pytest.mark.parametrize("page", ["<nav><a>x</a></nav><div class='{}'><article><h1>Head</h1><p>{}</article></div><footer>end of it</footer>", "<div><a>x</a></div><div class='{}'><h1>Head</h1><p>{}</div><footer>end</footer>", "<div class='{}'><p>Head<p>{}</div><div><a>x</a></div>"])
def test_names_around_an_article_keep_it(tree, name, page):
    assert mt.main_text(page.format(name, LONG), tree)[0] == f"Head\n{LONG}"


def plain(page):
    """The text of the article element alone, for pages that have one."""
    inside = re.search(r"<article>(.*)</article>", page or "", re.S)
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|table|tr|td)\b[^>]*>", inside[1]) if inside else []
    texts = (" ".join(html.unescape(re.sub(r"<[^>]*>", lambda m: " " if m[0].startswith("<br") else "", re.sub(r"<!--.*?-->", "", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_query_gives_the_article_of_every_page(spark):
    from foliate.llm.queries import QUERIES

    want = {r.page_id: plain(r.html) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = QUERIES["op10_main_text"](spark, SF).collect()
    assert {r.page_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)


def test_without_names_densities_tell_most_blocks(spark):
    rows, labels = mt.labelled()
    at = mt.FEATURES.index("named_share")
    rows[:, at] = 1
    tree, right, blocks = mt.grow(rows, labels), 0, 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        found, parts = mt.page_blocks(r.html or "")
        inside = set(plain(r.html).split("\n"))
        for b, row in zip(found, mt.rows_of(found, parts), strict=True):
            right += mt.decide(tree, (*row[:at], 1.0, *row[at + 1 :])) == (b.text in inside)
            blocks += 1
    assert right > 0.9 * blocks


def test_table(spark):
    rows = [(i, f"u{i}", p) for i, (p, _) in enumerate(PAGES.values())] + [(100, None, None), (101, "u", ""), (102, "u", "<" * 20_000), (103, "u", "<a href='" * 3000), (104, "u", "<div>" * 5000 + "x"), (0, "u0", PAGES["element"][0])]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "0 AS key", "1 AS n_chars")
    got = mt.extract(docs).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text == w and by[i].n_chars == len(w) for i, (_, w) in enumerate(PAGES.values()))
    assert by[100].text == by[101].text == "" and by[100].n_chars == 0
    assert mt.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


@pytest.mark.parametrize("unit", ["<p ", '<p a="', "<a href='", '<textarea x="', '<p ">" ', "<!-", "</", "<script></script ", "<p a=\"'>", "<!--", "<p \">'", "<div class='"])
@pytest.mark.parametrize("tail", ["", ">", '">', "'"])
def test_unclosed_tags_and_quotes_take_linear_time(unit, tail):
    took = {}
    for size in (250_000, 1_000_000):
        began = time.perf_counter()
        for _ in mt.tokens(unit * (size // len(unit)) + tail):
            pass
        took[size] = time.perf_counter() - began
    assert took[1_000_000] < max(12 * took[250_000], 1)


@pytest.mark.parametrize(("page", "want"), [("a<b c='>'>d", [("b", " c='>'")]), ("a<b c='>d", [("b", " c='")]), ("<title>a<b></title x>c<i>", [("", ""), ("i", "")]), ("<!--a>b", [("", "")]), ("<!-- a --!>b<!x>", [("", ""), ("", "")]), ("<script a='></script>", [("script", " a='"), ("script", "")]), ("x < y <1> <p", []), ("</P\n>", [("p", "\n")]), ("a<b <!-- c", [("", "")])])
def test_tokens(page, want):
    assert [(name, attributes) for _, _, _, name, attributes in mt.tokens(page)] == want
