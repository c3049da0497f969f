"""Pages are read where their words are: F16 (lay08_page_texts) and F17 (src11_pdf_texts)."""

from foliate.operators import layout as lo
from foliate.operators import pages
from foliate.plans import catalog

WORDS = "page long, pos long, x0 double, x1 double, top double, text string"


def test_words_of_a_page_move_once(spark):
    """A page's words were shuffled for each of its gutters, lines, slots and paragraphs."""
    plan = catalog.QUERIES["lay08_page_texts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1, plan


def test_pages_of_odd_words(spark):
    """Words without a place, a text or a page; a page in two columns below a title and above a line across."""
    title, foot = (1, 0, 100.0, 340.0, 5.0, "Title"), (1, 90, 20.0, 420.0, 190.0, "foot")
    rows = [title, *((1, i * 2 + c, 20.0 + 230 * c, 190.0 + 230 * c, 100.0 + 12 * i, f"{'lr'[c]}{i}") for i in range(6) for c in (0, 1)), foot]
    rows += [(2, 0, 10.0, 40.0, 8.0, "研究"), (2, 1, 80.0, 99.0, 8.0, "，"), (2, 2, 101.0, 110.0, 8.0, "x"), (2, 3, 130.0, 140.0, 8.0, None), (None, 0, 10.0, 20.0, 1.0, "nowhere"), (3, 0, 10.0, 20.0, 1.0, " "), (4, 0, None, None, None, "lost")]
    got = {r.page: r.text for r in lo.page_texts(spark.createDataFrame(rows, WORDS).repartition(3), 440.0, 630.0, support=3).collect()}
    assert got[1] == "Title\n\n" + "\n".join(f"l{i}" for i in range(6)) + "\n\n" + "\n".join(f"r{i}" for i in range(6)) + "\n\nfoot"
    assert {p: t for p, t in got.items() if p != 1} == {2: "研究，x", None: "nowhere", 4: "lost"}


def test_rounding_is_sparks(spark):
    values = [1.0005, 2.0015, 0.1235, 100.12349999, -3.0005, 12.0, 1 / 3]
    found = spark.createDataFrame([(v,) for v in values], "v double").selectExpr("v", "round(v, 3) AS r").collect()
    assert [pages.rounded(r.v) for r in found] == [r.r for r in found]
