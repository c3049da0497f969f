"""Folds that SQL can't express give the rows of a plain loop on whole tables."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliate.operators import cleaning as cl
from foliate.operators import structure as st

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents():
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet'").fetchall()


def packed(sizes, size, overlap):
    """Numbers of paragraphs of each chunk."""
    done, now, length = [], [], 0
    for i, n in enumerate(sizes):
        if now and length + n + 2 > size:
            done.append(now)
            kept, total = [], 0
            for j in reversed(now):
                if kept and total + sizes[j] > overlap:
                    break
                kept.insert(0, j)
                total += sizes[j]
            now, length = kept, total
        now = [*now, i]
        length += n + 2
    return [*done, now] if now else done


@pytest.mark.parametrize(("size", "overlap"), [(1500, 200), (300, 0), (100, 10_000), (1, 1)])
def test_chunks(spark, documents, size, overlap):
    wide = spark.read.parquet(f"{SF}/documents.parquet").withColumn("text", F.replace("text", F.lit("\n"), F.lit("\n\n")))
    got = {}
    for r in st.chunks(wide, size=size, overlap=overlap).orderBy("doc_id", "chunk").collect():
        got.setdefault(r.doc_id, []).append(list(r.paragraphs))
    assert got == {d: own for d, t in documents if (own := packed([len(p.strip()) for p in t.split("\n") if p.strip()], size, overlap))}


def is_garbage(line):
    letters = len(re.findall("[一-鿿㐀-䶿A-Za-z0-9]", line))
    single = not re.search("[一-鿿]", line) and " " not in line
    return line != "" and (len(line) - letters > 2 * letters or single and (letters >= 6 or 2 <= len(line) <= 5 or not line[0].isalnum()))


def cleaned(text):
    lines = re.sub(r"\(cid:\d+\)", "", re.split(r"[（(]\s*上接第\s*\d+\s*页\s*[）)]", text)[0]).splitlines()
    heads = {w for w in (x.strip() for x in lines) if 1 <= len(w) <= 22 and sum(y.strip() == w for y in lines) > 1 and not re.match(r"\s*\[\s*\d+\s*\]", w)}
    out = []
    for raw in lines:
        line = re.sub(r"\s*[（(]?\s*责\s*编\s*[:：][^）)]*[）)]?", "", raw).rstrip()
        if not raw.strip():
            if out and out[-1]:
                out.append("")
        elif line.strip() and not re.match(r"[\s—–\-－·.．]*\d{1,4}[\s—–\-－·.．]*$", raw.strip()) and line.strip() not in heads and not is_garbage(line.strip()):
            out.append(line)
    return "\n".join(out).rstrip("\n")


def test_cleaned_texts(spark, documents):
    marks = ["", "- 12 -\n", "页眉标题\n", "（责编：张三）\n", "(cid:7)abc def(cid:8)\n", "\n\n", "x=y+z**\n", "正文里的责编：李四\n", "[1] 甲\n[1] 甲\n", "   \n"]
    rows = []
    for d, t in documents:
        lines = t.split("\n")
        text = "".join(marks[(d + i) % len(marks)] + x + "\n" for i, x in enumerate(lines))
        rows.append((d, text + ("(上接第 3 页)" + t if d % 9 == 0 else "")))
    rows += [(9001, None), (9002, ""), (9003, "\n \n")]
    got = {r.doc_id: r.text for r in cl.cleaned_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {d: cleaned(t or "") for d, t in rows}
    assert len({t for t in got.values()}) > 150


def test_line_paragraphs_of_texts(spark, documents):
    """Wrapped lines of whole texts, joined in one pass over neighbours, are as a fold over the text so far gives them."""

    def joined(text):
        out = []
        for block in re.split(r"\n\s*\n", text):
            now = ""
            for line in (x for y in block.splitlines() if (x := y.strip())):
                if not now:
                    now = line
                elif now[-1] in "。！？!?”’：:" or re.match(r"\s*(?:\[\s*\d+\s*\]|\(\s*\d+\s*\)|（\s*\d+\s*）|\d+\s*[.、)]|[▪•·\-*]\s+)", line):
                    now += "\n" + line
                else:
                    now += (" " if re.match("[A-Za-z0-9]{2}$", now[-1] + line[0]) else "") + line
            if now:
                out.append(now)
        return "\n".join(out)

    d = spark.read.parquet(f"{SF}/documents.parquet")
    got = {r.doc_id: r.t for r in d.select("doc_id", cl.unwrapped(F.col("text")).alias("t")).collect()}
    assert got == {i: joined(t) for i, t in documents}
