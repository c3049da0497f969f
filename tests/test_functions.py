import random
import time

import pytest
from pyspark.sql import functions as F

from foliate.functions import anchors as an
from foliate.functions import text as tx
from foliate.operators import layout as lo
from foliate.operators import structure as st
from foliate.operators import tables as tb
from foliate.operators import trees as tr
from foliate.operators.search import Filters, period, search
from foliate.streaming import log as sl


def values(spark, strings, column):
    df = spark.createDataFrame([(i, s) for i, s in enumerate(strings)], "i int, s string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("s"))).collect()]


def test_strip_and_lines_as_python(spark):
    rng = random.Random(1)
    strings = ["".join(rng.choice(["a", " ", "　", " ", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x1e", "\x85", " ", "b"]) for _ in range(rng.randrange(9))) for _ in range(150)]
    assert values(spark, strings, tx.strip) == [s.strip() for s in strings]
    assert values(spark, strings, tx.lines) == [s.splitlines() for s in strings]


def test_literal_keywords(spark):
    rows = ["x_y", "xZy", "50%", "a\\b", "ABC", "É", None]
    hits = lambda word: [s for s, h in zip(rows, values(spark, rows, lambda c: tx.contains_literal(c, word)), strict=True) if h]
    assert hits("x_y") == ["x_y"] and hits("0%") == ["50%"] and hits("A\\B") == ["a\\b"] and hits("abc") == ["ABC"] and hits("é") == [] and len(hits("  ")) == len(rows)


@pytest.mark.parametrize(("text", "want"), [("p\n\nq\n\n\n\nr", ["p", "q", "r"]), ("a\n \nb", ["a", "b"]), ("", []), (None, [])])
def test_paragraphs(spark, text, want):
    assert values(spark, [text], tx.paragraphs) == [want]


def test_small_functions(spark):
    assert values(spark, ["a" * 10, "abcd! efgh ijkl", "abcd” efgh ijkl", "abcd. efgh ijkl", "ab! " + "c" * 30, None], lambda c: tx.truncate_at_sentence(c, 8)) == ["a" * 8, "abcd!", "abcd”", "abcd. ef", "ab! cccc", None]
    assert values(spark, [' a/b:c*"? ', "  ", "x"], tx.safe_name) == ["a_b_c___", "report.txt", "x"]
    assert values(spark, ["0", "1023", "1024", "1280", "1048576", "1099511627776"], lambda c: tx.human_size(c.cast("long"))) == ["0 B", "1023 B", "1.0 KB", "1.2 KB", "1.0 MB", "1.0 TB"]
    assert values(spark, ["1280", "1073741824", "3221225472"], lambda c: tx.human_size(c.cast("long"), "MB")) == ["1.2 KB", "1024.0 MB", "3072.0 MB"]
    assert values(spark, ["[原文位置：3，1, 3]x[原文位置: 7]", "none"], tx.citations) == [[3, 1, 7], []]
    assert values(spark, ["【段落2】a[原文位置：3]b【片段1/4】"], tx.without_citations) == ["ab"]
    assert values(spark, ["7", "x", None, "-2", "4"], lambda c: tx.clamped(c, 1, 5, 3)) == [5, 3, 3, 1, 4]
    assert values(spark, ['["a","b"]', "bad", None], tx.json_list) == [["a", "b"], [], []]
    assert values(spark, ["研究CNN网络a b"], tx.tokens) == [["cnn", "研究", "网络"]]


def test_markdown(spark):
    rows = F.array(F.array(F.lit("h|1"), F.lit("h\n2")), F.array(F.lit(" "), F.lit(None)), F.array(F.lit("x")))
    assert spark.range(1).select(tx.markdown_table(rows)).first()[0] == "| h\\|1 | h 2 |\n| --- | --- |\n| x |  |"


def test_anchors(spark):
    good = {"pdf:2:10,20,30,60": ("pdf", 2, 10, None), "pdfh:1:3-3": ("pdfh", 1, None, 3), "txu:5-9": ("txu", None, None, 5)}
    bad = ["pdf:2:30,20,10,60", "pdf:-1:1,2,3,4", "pdfh:1:4-3", "txc:5-5", "tx:1-2", "", None, "pdf:1:1,2,3", "txc:99999999999999999999-1"]
    for code, a in zip([*good, *bad], values(spark, [*good, *bad], an.parse), strict=True):
        assert (None if a is None else (a.kind, a.page, a.x0, a.start)) == good.get(code)
    made = spark.range(1).select(an.rectangle(F.lit(1), F.lit(0.5), F.lit(1.5), F.lit(2.5), F.lit(3.6)), an.rectangle(F.lit(1), F.lit(1.4), F.lit(1.0), F.lit(1.0), F.lit(9.0)), an.span("txh", F.lit(3), F.lit(8)), an.span("pdfu", F.lit(3), F.lit(3), F.lit(0)), an.span("txh", F.lit(3), F.lit(3))).first()
    assert tuple(made) == ("pdf:1:0,2,2,4", None, "txh:3-8", "pdfu:0:3-3", None)


def packed(lengths, size, overlap):
    """Chunks by a plain loop."""
    out, now, total = [], [], 0
    for i, n in enumerate(lengths):
        if now and total + n + 2 > size:
            out.append([k for k, _ in now])
            keep, carried = [], 0
            for k, m in reversed(now):
                if keep and carried + m > overlap:
                    break
                keep.insert(0, (k, m))
                carried += m
            now, total = keep, carried
        now.append((i, n))
        total += n + 2
    return out + ([[k for k, _ in now]] if now else [])


def test_chunks(spark):
    rng = random.Random(3)
    docs = [(i, [rng.randrange(1, 60) for _ in range(rng.randrange(12))]) for i in range(40)]
    rows = spark.createDataFrame([(i, "\n\n".join("x" * n for n in ns)) for i, ns in docs], "doc_id int, text string")
    got = {}
    for r in st.chunks(rows, size=60, overlap=20).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(r.paragraphs)
    assert got == {i: packed(ns, 60, 20) for i, ns in docs if ns}


def test_checks_of_drafts(spark):
    long = "alpha beta gamma delta epsilon zeta eta theta"
    one = spark.range(1)
    assert one.select(st.inconsistent(F.lit("short"), F.lit("x " * 300)), st.inconsistent(F.lit(long), F.lit("other words " * 30)), st.inconsistent(F.lit(long), F.lit("unlike")), st.inconsistent(F.lit(long), F.lit(long * 4))).first()[0:2] == (False, True)
    parts = F.array(F.lit("alpha beta gamma delta"), F.lit("nothing here at all"))
    trace = lambda draft, *ids: one.select(st.traceable(F.lit(draft), F.array(*map(F.lit, ids)).cast("array<int>"), parts)).first()[0]
    assert trace("alpha beta", 0) and not trace("alpha beta", 7) and not trace("alpha beta") and not trace("unrelated words", 0)


def test_search_escapes_and_orders(spark):
    lit = spark.createDataFrame([(1, "x_y", "a"), (2, "xZy", "a"), (3, "x_y", "b")], "id long, title string, author string").selectExpr("*", "'' AS publish_time", "'' AS journal_source", "'PDF' AS lit_type", "1L AS category_id", "0 AS is_parsed", "id AS file_size", "timestamp_ntz'2024-02-02 00:00:00' AS create_time")
    none = spark.createDataFrame([], "lit_id long, tag_id long, id long, tag_name string, note_content string, core_view string")
    found = search(lit, none, none, none, none, Filters(keyword="X_Y", year="2024", sort="no such column"))
    assert [r.id for r in found.collect()] == [3, 1]


def test_periods():
    from datetime import datetime

    today = datetime(2026, 10, 4, 15)
    assert period("this_week", today)[0] == datetime(2026, 9, 28) and period("this_month", today)[0] == datetime(2026, 10, 1)
    assert period("older_than_year", today) == (None, datetime(2025, 10, 4, 15)) and period("other", today) == (None, None)


def test_tables_and_trees(spark):
    rows = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "id int, v string, n int")
    assert sorted(map(tuple, tb.upsert(rows, rows.selectExpr("id + 1 AS id", "'z' AS v", "9 AS n"), "id", only_new=("n",)).collect())) == [(1, "a", 1), (2, "z", 2), (3, "z", 9)]
    assert sorted(map(tuple, tb.patch(rows, rows.selectExpr("1 AS id", "'q' AS v", "5 AS other"), "id").collect())) == [(1, "q", 1), (2, "b", 2)]
    tags = spark.createDataFrame([(1, 1, "a", 0, 2), (2, 1, "b", 0, 1), (3, 1, "c", 1, 1), (4, 1, "d", 3, 1), (5, 1, "loop", 6, 1), (6, 1, "loop2", 5, 1)], "id long, tag_type int, tag_name string, parent_id long, sort_order int")
    assert [(r.id, r.depth) for r in tr.tag_tree(tags).orderBy("key").collect()] == [(2, 0), (1, 0), (3, 1), (4, 2)]


def test_lines_of_words(spark):
    words = [("p", 0.0, 10.0, 100.0, "one"), ("p", 15.0, 20.0, 102.0, "two"), ("p", 21.0, 30.0, 101.0, "three"), ("p", 0.0, 5.0, 110.0, "研"), ("p", 9.0, 15.0, 110.0, "究")]
    df = spark.createDataFrame(words, "page string, x0 double, x1 double, top double, text string")
    assert [r.text for r in lo.line_texts(df).orderBy("line").collect()] == ["one twothree", "研究"]


def test_stream_gives_the_rows_of_the_batch(spark, tmp_path):
    events = sl.timed(spark.read.parquet("/root/testdata/sf0.001/events.parquet"))
    batch = {(r.start, r.event_type): r.n for r in sl.window_counts(events, "event_type", "1 day").collect()}
    source = spark.readStream.schema(spark.read.parquet("/root/testdata/sf0.001/events.parquet").schema).parquet("/root/testdata/sf0.001/events*.parquet")
    running = sl.window_counts(sl.timed(source), "event_type", "1 day").writeStream.outputMode("complete").format("memory").queryName("daily").option("checkpointLocation", f"{tmp_path}/c").start()
    running.processAllAvailable()
    running.stop()
    assert {(r.start, r.event_type): r.n for r in spark.table("daily").collect()} == batch


def test_debounce(spark):
    edits = spark.createDataFrame([(1, "2024-01-01 00:00:00", "a", 1), (1, "2024-01-01 00:00:00.999", "b", 2), (1, "2024-01-01 00:00:01.999", "c", 3), (1, "2024-01-01 00:00:04", "d", 4)], "k int, ts string, v string, o int").withColumn("ts", F.col("ts").cast("timestamp"))
    assert [(r.v, r.edits) for r in sl.debounced(edits, "k", "v", "o").orderBy("start").collect()] == [("c", 3), ("d", 1)]


def test_work_of_a_text_grows_with_its_lines(spark):
    """A part of a text that is named within a function of its parts is made once for the text, not once for each part."""
    text = "\n".join(f"Line {i} of the text." for i in range(3000))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    parts = tx.slices(tx.lines(F.col("text")), 4)
    mapped = F.transform(parts, lambda p: tx.truncate_at_sentence(F.array_join(F.transform(p, tx.strip), "\n"), 40))
    numbers = F.sequence(F.lit(0), F.lit(1499))
    began = time.monotonic()
    shown = docs.select(st.labelled_chunks(mapped).alias("s")).first().s
    assert shown.startswith("【片段1/750】\nLine 0 of the text.\n") and "【片段750/750】\nLine 2996 of" in shown
    marked = docs.select(st.marked(F.replace("text", F.lit("\n"), F.lit("\n\n")), numbers).alias("s")).first().s
    assert marked.count("【段落") == 1500
    table = docs.select(tx.markdown_table(F.transform(tx.lines(F.col("text")), lambda x: F.array(x, F.lit("b")))).alias("s")).first().s
    assert table.count("\n") == 3000
    assert time.monotonic() - began < 20


def test_gutters_shuffle_words_by_page_alone(spark):
    words = spark.createDataFrame([(1, 0.0, 40.0), (1, 60.0, 100.0), (2, 0.0, 100.0), (3, 10.0, 20.0), (None, 0.0, 10.0)], "page long, x0 double, x1 double")
    found = lo.gutters(words, 100.0, support=1)
    assert sorted(map(tuple, found.collect())) == [(1, 40, 60)]
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert "page" in plan and "hashpartitioning(page#" in plan
    assert not [x for x in found._jdf.queryExecution().executedPlan().toString().split("\n") if "hashpartitioning(page#" in x and ", x#" in x]


def test_all_headings_of_lines(spark):
    docs = spark.createDataFrame([(1, " Abstract \nx\n" + "y" * 40 + "\nMethods\nAbstract\n1. Summary:"), (2, None)], "doc_id long, text string")
    found = {r.doc_id: [tuple(h) for h in r.h] for r in docs.select("doc_id", st.heads(tx.lines(F.col("text"))).alias("h")).collect()}
    assert found == {1: [(0, "research_background"), (3, "research_method"), (4, "research_background"), (5, "research_conclusion")], 2: []}


def test_work_on_texts_is_dealt_by_their_ids(spark):
    """A table of one row group is read by one task, but its texts are worked on by all; words are counted where they are."""
    from foliate.plans import catalog

    for name in ("agg08_frequent_words", "str11_garbage_lines", "agg11_heading_lines"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        dealt = [x for x in plan.split("\n") if "Exchange" in x]
        assert len(dealt) == 1 and "hashpartitioning(doc_id#" in dealt[0] and "REPARTITION" in dealt[0], plan


def test_empty_texts_go_before_headings_are_put_in(spark):
    """before texts are dealt, nothing is made of them: that would be one task's work for a file of one row group."""
    from foliate.plans import catalog

    for name in ("doc09_verdicts", "agg14_unresolved_dimensions", "doc13_trusted_originals", "doc12_refine_material", "arr05_asked_dimensions"):
        plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange") == 1 and "array_join" in plan.split("Exchange")[0] and "array_join" not in plan.split("Exchange")[1], plan


def test_strip_looks_at_ends_alone(spark):
    """What is stripped is the class of blanks, whole; a text of many blanks within is not searched."""
    told = spark.range(0x3001).where("id NOT BETWEEN 55296 AND 57343").select("id", F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    found = told.select("id", (tx.strip(F.concat(F.col("c"), F.lit("a b"), F.col("c"))) == "a b").alias("stripped"), F.col("c").rlike(f"^{tx.BLANK}$").alias("blank"))
    assert found.where("stripped <> blank").count() == 0 and found.where("blank").count() == len(tx.BLANKS)
    assert "regexp" not in spark.range(1).select(tx.strip(F.col("id").cast("string")))._jdf.queryExecution().toString()


def test_pairs_of_all_han_characters(spark):
    low = "".join(f"{chr(i)}{chr(i)} " for i in range(0x110000) if not 0xD800 <= i < 0xE000)
    found = values(spark, [low], lambda c: F.size(tx.tokens(c)) == F.regexp_count(F.lower(c), F.lit(r"\p{IsHan}{2}")) + F.regexp_count(F.lower(c), F.lit(r"[a-z0-9ß-öø-ɏ]{2,}")))
    assert found == [True]
