import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from foliate.llm import ranges as rg
from foliate.llm import warc
from foliate.llm.files import located
from foliate.llm.shared import shared_dir

ROWS = [
    *((i, f"http://h/{i}", f"<p>page {i % 7} é</p>" * (i % 5)) for i in range(60)),
    (200, "http://a b\r\nX: 1", None),
    (201, None, ""),
    (202, "u", "x" * 300_000),
    (203, "u", "\r\n\r\nWARC/1.1\r\n"),
    (3, "http://again", "<p>page 3 é</p>" * 3),
    (3, "http://h/3", "<p>page 3 é</p>" * 3),
    (3, "http://h/3", "other"),
    (None, "http://none", "<p>page 4 é</p>"),
    (None, "http://none", "only without a key"),
    (None, "http://none", "only without a key"),
    (None, None, None),
    *((7, f"http://hot/{i}", f"text {i} under one key " * 9) for i in range(80)),
]
ORDER = lambda r: (r[0] is None, r[0] or 0)


def brute(rows):
    first = {}
    for k, _, t in sorted(rows, key=ORDER):
        first.setdefault(t or "", k)
    seen, out = set(), []
    for k, _, t in sorted(rows, key=ORDER):
        raw = (t or "").encode()
        fresh = (t or "") not in seen
        seen.add(t or "")
        out.append((k, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if fresh else "revisit", None if fresh else first[t or ""]))
    return sorted(out, key=str)


def test_cuts_and_numbers(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, 1, 1, 1, *range(40)]), rng.randrange(-9, 9), rng.randrange(50)) for _ in range(400)]
    d = spark.createDataFrame(rows, "a long, b long, w int")
    before = lambda r, c: (r[0] is not None, r[0] or 0, r[1]) < (c[0] is not None, c[0] or 0, c[1])
    for limit, most in ((1, 1 << 16), (300, 1 << 16), (300, 7), (1 << 30, 9)):
        found = rg.cuts(d, F.col("w"), limit, most)
        assert found == rg.cuts(d.repartition(5), F.col("w"), limit, most) and len(found) < most
        numbered = d.select("a", "b", "w", rg.number(F.col("a"), F.col("b"), found).alias("n")).collect()
        assert all(r.n == sum(not before((r.a, r.b), c) for c in found) for r in numbered)
        if limit == 300 and most > 9:
            sums = {}
            for r in numbered:
                sums[r.n] = sums.get(r.n, 0) + r.w
            assert len(found) > 10 and max(sums.values()) <= 300 + 50 * max(Counter((r.a, r.b) for r in numbered).values())
    assert rg.cuts(d.limit(0), F.col("w"), 5) == []


@pytest.mark.parametrize(("ranges", "files"), [(1 << 30, 1 << 30), (2000, 900)])
def test_round_trip(spark, ranges, files):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").selectExpr("*", "1 AS a", "'k' AS key", "2 AS range", "3 AS payload")
    contents = []
    for _ in range(2):
        folder = shared_dir(spark, "warc")
        warc.write_warc(pages.repartition(3), folder, range_bytes=ranges, file_bytes=files)
        got = warc.read_warc(spark, folder, payloads=True).collect()
        assert sorted(((r.key, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == brute(ROWS)
        assert all(r.intact for r in got)
        assert sorted(r.payload.decode() for r in got if r.record_type == "response") == sorted({t or "" for _, _, t in ROWS})
        system, base = located(folder)
        names = [r.file for r in spark.read.parquet(f"{folder}/manifest").collect()]
        contents.append({n: system.open_input_file(f"{base}/{n}").read() for n in names})
        assert all(gzip.decompress(c).startswith(b"WARC/1.1\r\n") for c in contents[-1].values())
    assert contents[0] == contents[1] and (len(contents[0]) > 3) == (files < 1000)


def test_small_payloads_stay_responses(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], "page_id long, url string, html string"), folder, revisit_from=3)
    assert sorted((r.key, r.refers_to) for r in warc.read_warc(spark, folder).collect()) == [(1, None), (2, None), (3, None), (4, 3)]


def test_empty_table(spark):
    folder = shared_dir(spark, "warc")
    warc.write_warc(spark.createDataFrame([], "page_id long, url string, html string"), folder)
    assert warc.read_warc(spark, folder).count() == 0
