"""Operators that SQL can't express, odd rows, and what a plan leaves behind, on small tables."""

import pytest
from pyspark.sql import functions as F

from foliate.functions import anchors as an
from foliate.functions import text as tx
from foliate.operators import cleaning as cl
from foliate.operators import fallback as fb
from foliate.operators import layout as lo
from foliate.operators import library as li
from foliate.operators import structure as st
from foliate.operators import tables as tb
from foliate.operators import trees as tr

PAPER = """一种新设计
张三
摘要：本文研究了城市公园的设计。
结果很好
关键词：公园；设计
一、引言部分
城市公园是重要的公共空间，需要仔细研究它的使用情况。
二、研究过程
本文采用问卷调查的方法收集了三百份数据并进行了分析，
得到了结果。
我们首次提出了一种基于行为的公园评价方式，它比以前的好。
[1] 李四. 公园. 2001.
[2] 王五. 设计[J]. 北京, 2002, 3-9.
图 1 公园
这是结语之前的一段正文，它说明了研究的全部发现。
作者简介：张三，教授。
五、结语与后续的工作
总之公园设计应当考虑使用者的行为，李四副教授，主要研究方向：公园
以后还要继续研究。
基金项目：2020 年"""


def filled(spark, text, precision=3):
    rows = fb.filled_sections(spark.createDataFrame([(1, text)], "doc_id long, text string"), precision).collect()
    return {r.dimension: r for r in rows}


def test_filled_sections(spark):
    got = filled(spark, PAPER)
    assert got["research_background"].content == "本文研究了城市公园的设计。\n结果很好" and got["research_background"].lines == [2, 3]
    assert got["research_method"].lines == [8, 9, 10] and got["research_method"].content.startswith("本文采用问卷")
    assert got["innovation_point"].lines[0] == 10 and got["innovation_point"].content.startswith("我们首次提出")
    assert got["research_conclusion"].lines == [17, 18, 14]
    assert "李四" in got["research_conclusion"].content and "教授" not in got["research_conclusion"].content
    assert "[1]" not in got["core_view"].content and "图 1" not in got["core_view"].content
    assert all(r.filled for r in got.values()) and "reference_list" not in got


def test_sections_with_headings_stay(spark):
    got = filled(spark, "摘要\n这里是摘要的内容。\n参考文献\n[1] 甲\n\n[2] 乙\n", 5)
    assert not got["research_background"].filled and got["research_background"].content == "这里是摘要的内容。"
    assert got["reference_list"].content == "[1] 甲\n[2] 乙" and "research_method" not in got
    assert set(filled(spark, PAPER, 2)) == set() and filled(spark, "") == {} and filled(spark, None) == {}


def test_background_without_an_abstract_holds_a_sentence(spark):
    text = "题目没有标点的短行\n作者\n" + "没有句末标点的正文行也很长很长很长很长很长，" + "\n\n" + "这一行是有句末标点的正文，它足够长可以作为背景。\n第二行。"
    assert filled(spark, text)["research_background"].lines == [4, 5]


def test_conclusion_without_a_heading_is_the_last_running_text(spark):
    got = filled(spark, "这是第一段正文，它的内容比较长，超过了二十个字。\n[1] 甲乙丙丁. 2001(3).\n作者简介：张三")
    assert got["research_conclusion"].lines == [0]


def test_texts_of_one_key_are_filled_alone(spark):
    plain = "这是第一段正文，它的内容比较长，超过了二十个字。"
    rows = fb.filled_sections(spark.createDataFrame([(1, "摘要\n甲的内容。"), (1, plain), (None, plain)], "doc_id long, text string").selectExpr("*", "1 AS lines", "2 AS opens")).collect()
    got = sorted((r.doc_id or 0, r.dimension, r.content, r.filled) for r in rows)
    own = [("core_view", plain, True), ("research_background", plain, True), ("research_conclusion", plain, True)]
    assert [g for g in got if g[0] == 0] == [(0, *x) for x in own] and (1, "research_background", "甲的内容。", False) in got and {(1, *x) for x in own} <= set(got)


def test_spans_stop_and_cross_gaps(spark):
    text = "三、研究方法与设计\n\n本文采用问卷法，收集数据三百份并分析\n\n第二段不在其中，因为又隔了一行空行"
    assert filled(spark, text)["research_method"].lines == [0, 2]
    stopped = "本文采用问卷法，收集数据三百份并做了分析，\n四、结果\n后面的内容不在其中"
    assert filled(spark, stopped)["research_method"].lines == [0]
    labels = "这是结论标题之前的正文，它应当被取到。\n图例标签\n\n[1] 甲. 2001.\n六、结语与后续的工作\nab\ncd\n很短的正文在后面，它被取到。"
    assert filled(spark, labels)["research_conclusion"].lines == [7, 0]


def test_long_texts_take_linear_time(spark):
    import time

    d = spark.createDataFrame([(1, "\n".join(["摘要", *(f"这是第{i}行，它没有结束" for i in range(16_000))]))], "doc_id long, text string")
    began = time.perf_counter()
    assert st.sections(d).where(F.length("content") > 100_000).count() == 1
    assert time.perf_counter() - began < 6


def words(*rows):
    return [(1, i, float(x), float(x + 12 * len(t)), float(top), t) for i, (x, top, t) in enumerate(rows)]


def test_page_in_two_columns(spark):
    rows = words((150, 5, "TITLE-ACROSS-ALL"), *((20, 40 + 12 * i, f"left{i}") for i in range(8)), *((260, 40 + 12 * i, f"right{i}") for i in range(8)))
    d = spark.createDataFrame(rows, "page int, pos int, x0 double, x1 double, top double, text string")
    text = lo.page_texts(d, 440.0, 150.0, support=2).collect()[0].text
    assert text == "TITLE-ACROSS-ALL\n\n" + "\n".join(f"left{i}" for i in range(8)) + "\n\n" + "\n".join(f"right{i}" for i in range(8))
    assert lo.page_texts(d.limit(0), 440.0, 150.0).count() == 0


def test_page_in_one_column(spark):
    d = spark.createDataFrame(words((20, 10, "one"), (80, 10.5, "line"), (20, 22, "two")), "page int, pos int, x0 double, x1 double, top double, text string")
    assert [r.text for r in lo.page_texts(d, 440.0, 90.0).collect()] == ["one line\ntwo"]


def test_gutters_of_bands(spark):
    rows = [(1, 20.0, 190.0, float(t)) for t in range(0, 90, 10)] + [(1, 230.0, 400.0, float(t)) for t in range(0, 90, 10)]
    rows += [(2, 20.0, 190.0, 5.0), (2, 230.0, 400.0, 5.0), (2, 20.0, 400.0, 40.0), (2, 20.0, 400.0, 80.0)]
    d = spark.createDataFrame(rows, "page int, x0 double, x1 double, top double").withColumn("text", F.lit("x"))
    got = sorted((r.page, r.band, r.divider) for r in lo.page_dividers(d, 440.0, 90.0, support=1).collect())
    assert got == [(1, 0, 210.0), (1, 1, 210.0), (1, 2, 210.0), (2, 0, 210.0)]


def test_layout_faults(spark):
    nodes = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 2), (4, "b", 0), (5, "e", 0)], "id long, name string, parent_id long")
    moves = spark.createDataFrame([(1, 3), (4, 1), (5, 5), (9, 0), (3, 77)], "id long, parent_id long")
    got = {r.id: r.fault for r in tr.layout_faults(nodes, moves).collect()}
    assert got == {1: None, 4: "name", 5: "self", 9: "unknown", 3: "parent"}
    circle = tr.layout_faults(nodes, spark.createDataFrame([(1, 3), (1, 3)], "id long, parent_id long")).collect()
    assert [(r.id, r.fault) for r in circle] == [(1, "circle")]


def test_backup_is_complete_with_its_manifest(spark, tmp_path):
    files = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "path string, size long")
    before = spark.createDataFrame([("a", 1), ("b", 9), ("gone", 1)], "path string, size long")
    plan = li.backup_plan(files, before)
    assert sorted((r.path, r.packed) for r in plan.collect()) == [("a", False), ("b", True), ("c", True)]
    assert li.backup_plan(files, None).where("packed").count() == 3
    li.write_backup({"lib": files}, plan, f"file:{tmp_path}/one")
    assert spark.read.parquet(f"file:{tmp_path}/one/manifest").count() == 3 and spark.read.parquet(f"file:{tmp_path}/one/table=lib").count() == 3


def test_rows_are_numbered_range_by_range(spark):
    rows = [(None if i % 7 == 0 else f"n{i % 3}", i * i) for i in range(300)]
    got = tb.ranked(spark.createDataFrame(rows, "name string, o long"), "o", F.col("name")).collect()
    for name in {n for n, _ in rows}:
        assert [r._n for r in sorted((r for r in got if r.name == name), key=lambda r: r.o)] == list(range(1, 1 + sum(n == name for n, _ in rows)))
    assert len(got) == len(rows) and tb.ranked(spark.createDataFrame([], "o long"), "o").count() == 0


@pytest.mark.parametrize(("raw", "k"), [('{"k": "a "b" c"}', 'a "b" c'), ('{"k": "x",}', "x"), ('{"k": "a \\"b\\""}', 'a "b"'), ('{"k" : "go" , "z": ["a"b", "c"]}', "go"), ("{", None), (None, None)])
def test_lenient_json(spark, raw, k):
    row = spark.createDataFrame([(raw,)], "c string").select(F.get_json_object(cl.lenient_json(F.col("c")), "$.k").alias("k")).first()
    assert row.k == k


def test_footnotes_and_noise(spark):
    cases = {"所以在细分财务处讲师，主要研究方向：会计": "所以在细分财务处", "正文。（基金项目：某": "正文。", "没有脚注": "没有脚注", "王五副教授": "王五", "": ""}
    rows = spark.createDataFrame([(k,) for k in cases], "s string").select("s", cl.without_footnote(F.col("s")).alias("out")).collect()
    assert {r.s: r.out for r in rows} == cases
    noise = {"[3] 甲": True, "图 2 说明": True, "参 考 文 献": True, "关键词：甲": True, "甲乙丙丁，2001，3": True, "12-19": True, "abc": True, "编号：3": True, "普通的一行正文。": False, "a b": False}
    rows = spark.createDataFrame([(k,) for k in noise], "s string").select("s", cl.is_noise(F.col("s")).alias("out")).collect()
    assert {r.s: r.out for r in rows} == noise


def test_small_functions(spark):
    row = spark.range(1).select(
        tx.error_code(F.lit("duplicate")).alias("code"),
        tx.relative_path(F.lit("/b/x/y"), "/b").alias("relative"),
        tx.absolute_path(F.lit("/z"), "/b").alias("absolute"),
        F.size(tx.clean_keywords(F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: i.cast("string")))).alias("words"),
        tx.without_key(F.lit('{"a": "1", "k": "2"}'), "k").alias("kept"),
        an.style_of(F.lit("highlight"), F.lit(" ")).alias("style"),
        st.refine_paragraphs(F.array().cast("array<struct<local:string,anchors:array<int>>>"), F.lit(0)).alias("none"),
    ).first()
    assert tuple(row) == (7, "x/y", "/z", 20, '{"a":"1"}', "#FFE066", [])
    with pytest.raises(ValueError, match="above 0"):
        tx.slices(F.lit(None), 0)


@pytest.mark.parametrize(("most", "share"), [(10_000, 1000), (2, 1000), (0, 1 << 40), (3, 2)])
def test_common_words_weigh_the_same(spark, monkeypatch, most, share):
    d = spark.createDataFrame([(i, " ".join(["all"] * 3 + ["even"] * (i % 2 == 0) + [f"w{i % 5}", f"own{i}"])) for i in range(12)], "doc_id long, text string")
    want = sorted(map(tuple, st.weighted_words(d, 3).collect()))
    monkeypatch.setattr(st, "COMMON_WORD", most)
    monkeypatch.setattr(st, "COMMON_SHARE", share)
    assert sorted(map(tuple, st.weighted_words(d, 3).collect())) == want and len(want) > 30
