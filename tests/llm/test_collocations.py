import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from foliate.llm import collocations as co


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute(rows, longest, least, cover, top):
    counts, totals = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lowered(text)):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, longest + 1):
                counts[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in counts.items():
        candidates = {p: a for p, a in c.items() if len(p) > 1 and a >= least}
        covered = Counter()
        for p, a in candidates.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    covered[p[i : i + k]] = max(covered[p[i : i + k]], a)
        found = []
        for p, a in candidates.items():
            if covered[p] and 100 * covered[p] >= cover * a:
                continue
            score, cut = min((2_000_000 * a // (c[p[:k]] + c[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p), c[p[:cut]], c[p[cut:]]))
        out += [(lang, i, p, -a, x, y, totals[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found, key=lambda f: (f[0], f[1], f[2].encode()))[:top], 1)]
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(12)] + ["É", "The", "the", "x\x00y", " "]
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    rows = [(None, None), ("en", ""), ("", "a b " * 40), ("EN", "one two. " * 33), ("en", "one two. " * 33), ("und", "p q " * 20), (None, "p q\tp q, " * 20), ("de", "same " * 3000), ("de", "z!? ;\r\n ,")]
    for _ in range(60):
        text = "".join(rng.choice(vocabulary) + rng.choice([" "] * 9 + ["  ", "\t", ", ", ".\n", "\r\n"]) for _ in range(rng.choice([1, 5, 60, 400])))
        rows.append((rng.choice(["en", "fr", None]), text))
        if rng.random() < 0.4:
            rows += [rows[-1]] * rng.choice([1, 6])
        if rng.random() < 0.5:
            rows.append(("fr", text[:9] + passage + " " + text))
    return rows


@pytest.mark.parametrize(("seed", "period", "most", "entries", "log", "args"), [(1, 32, 256, 2_000_000, 28, (4, 30, 80, 2000)), (2, 4, 8, 50, 15, (4, 10, 80, 25)), (3, 1, 5, 1000, 16, (3, 5, 60, 2000)), (4, 1 << 60, 7, 1000, 28, (4, 3, 80, 2000))])
def test_matches_brute_force(spark, monkeypatch, seed, period, most, entries, log, args):
    for name, value in (("PERIOD", period), ("MOST_WORDS", most), ("ENTRIES", entries), ("FILTER_MOST", log), ("BLOCK", 3000 if seed > 1 else co.BLOCK)):
        monkeypatch.setattr(co, name, value)
    rows = corpus(seed)
    docs = spark.createDataFrame(rows, "lang string, text string").selectExpr("*", "1 AS n", "2 AS k", "'x' AS phrase", "3 AS chunk").repartition(3)
    assert sorted(map(tuple, co.collocations(docs, *args).collect())) == brute(rows, *args)
    if seed == 1:
        assert co.collocations(docs.limit(0)).count() == 0


def test_chunks_hold_each_ngram_once():
    rng = random.Random(9)
    text = " ".join(rng.choice("abcdefgh") for _ in range(5000)).encode()
    for span in (1, 3):
        found, at = Counter(), 0
        for _, chunk, owned in co.chunks([b"", text, b"a"], span):
            w = chunk.split()
            assert owned <= len(w) <= owned + span
            found.update(tuple(w[i : i + span + 1]) for i in range(min(owned, len(w) - span)))
        w = text.split()
        assert found == Counter(tuple(w[i : i + span + 1]) for i in range(len(w) - span)), at


def test_equal_passages_give_equal_chunks():
    rng = random.Random(4)
    passage = " ".join(f"w{rng.randrange(5000)}" for _ in range(2000))
    texts = [f"{' '.join(f'v{rng.randrange(99)}' for _ in range(n))} {passage} end".encode() for n in (0, 7, 300)]
    sets = [{c for i, c, _ in co.chunks(texts, 3) if i == x} for x in range(3)]
    shared = sets[0] & sets[1] & sets[2]
    assert sum(map(len, shared)) > 0.8 * len(passage)


def test_filters_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(co, "FILTER_BITS", 1)
    rng = np.random.default_rng(1)
    h = rng.integers(-(1 << 63), (1 << 63) - 1, size=50_000)
    kept = co.frequent(spark.createDataFrame([(int(x), 1 + i % 2, i) for i, x in enumerate(h)], "h long, n long, place long"), 2)
    made = co.filter_of(kept)
    assert made.has(h[1::2].view(np.uint64)).all() and made.has(h[::2].view(np.uint64)).mean() < 0.9


def test_scores_beyond_64_bits(spark, monkeypatch):
    """2,000,000 times a count of 10**13 passes 64 bits."""
    monkeypatch.setattr(co, "dictionary", lambda docs, longest: co.stored(spark.createDataFrame([("en", "new york\n\ncity  hall tower", 5, 10**13 + 1, 5), ("en", "city", 1, 10**12, 1 << 40)], "lang string, chunk string, owned int, n long, id long"), "chunks"))
    got = {r.phrase: (r.a, r.l, r.r, r.score) for r in co.collocations(spark.createDataFrame([], "lang string, text string")).collect()}
    a, total = 10**13 + 1, 11 * 10**12 + 1
    assert got == {"new york": (a, a, a, 1_000_000), "city hall tower": (a, total, a, 2_000_000 * a // (total + a))}
