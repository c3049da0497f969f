import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from foliate.llm import spelling as sp


def shortened(w):
    return {w[:i] + w[i + 1 :] for i in range(len(w))}


def edits_of_one(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return b in shortened(a) or a in shortened(b)


def neighbours(words):
    """Words that share themselves or a shortened form, compared one by one."""
    by = defaultdict(set)
    for w in words:
        for s in {w, *shortened(w)}:
            by[s].add(w)
    near = defaultdict(set)
    for group in by.values():
        for a in group:
            near[a] |= {b for b in group if a != b and edits_of_one(a, b)}
    return near


def brute(docs, least_length=6, least=5, times=5):
    counts = Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= least_length and n >= least}
    near, form = neighbours(counts), {}
    for w, n in counts.items():
        best = min(near[w], key=lambda x: (-counts[x], x), default=None)
        form[w] = best if best is not None and counts[best] >= times * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


@pytest.mark.parametrize(("letters", "seed"), [("ab", 1), ("abcdé", 2), ("xyÿÀ", 3)])
def test_near_words_match_brute_force(spark, letters, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 5, 6, 7, 8, 9, 12]))) for _ in range(300)}
    words |= {w[:i] + rng.choice(letters) + w[i:] for w in list(words)[:60] for i in (0, len(w) // 2, len(w))} | {"a" * n for n in range(1, 40)}
    long = "".join(rng.choice(letters) for _ in range(3000))
    words |= {long, long[:1500] + long[1501:], "z" + long, long + "z", long[:-1], long[:7] + "q" + long[8:]}
    got = sorted(map(tuple, sp.near_words(spark.createDataFrame([(w,) for w in words], "word string")).collect()))
    assert got == sorted((a, b) for a, bs in neighbours(words).items() for b in bs)


def test_groups_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(sp, "HELD", 50)
    rng = random.Random(8)
    stems = ["".join(rng.choice("aeinrsté") for _ in range(rng.choice([6, 7, 9]))) for _ in range(12)]
    docs = [(None, "Colour " * 5), (None, None), (1, ""), (2, "short ×÷ co-lour STRASSE straße " * 6), (3, "İstanbul " * 5)]
    for i in range(300):
        ws = []
        for s in rng.choices(stems, weights=[3**-k for k in range(12)], k=20):
            if rng.random() < 0.2:
                at = rng.randrange(len(s))
                s = s[:at] + rng.choice(["", rng.choice("aeinrst"), s[at] + rng.choice("aeinrst")]) + s[at + 1 :]
            ws.append(s.title() if rng.random() < 0.1 else s)
        docs.append((i % 250, " ".join(ws)))
    docs += docs[-20:]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "'x' AS word", "2 AS node", "3 AS at")
    got = sorted(map(tuple, sp.spelling_groups(d, spelled=sp.dropped_letter).collect()), key=str)
    want = brute(docs)
    assert got == want and sum(r[1] is not None for r in want) > 50
    assert sp.spelling_groups(d.limit(0)).count() == 0


def test_ties_and_null_words(spark):
    rows = [("abcdefg", 50), ("abcdefh", 50), ("abcdef", 10), ("abcde", 2), ("other", 7), (None, 9)]
    got = {r.word: tuple(r)[1:] for r in sp.variants(spark.createDataFrame(rows, "word string, n long")).collect()}
    assert got == {"abcdefg": (None, "abcdefg", 50, 2, None), "abcdefh": (None, "abcdefh", 50, 2, None), "abcdef": ("abcdefg", "abcdefg", 10, 3, 50), "abcde": ("abcdef", "abcdefg", 2, 1, 10), "other": (None, "other", 7, 0, None)}


def test_query_takes_whole_tables(spark):
    sf = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, sp.op13(spark, sf).collect()), key=str) == brute(docs)
