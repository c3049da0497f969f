import random
import re

import numpy as np
import pytest
import xxhash

from foliate.llm import simhash as sh

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text, width):
    w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    hs = [xxhash.xxh64(" ".join(w[i : i + width]).encode(), seed=42).intdigest() for i in range(max(1, len(w) - width + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(docs, width, radius):
    prints = [plain(t, width) for _, t in docs]
    near = [[b for b in range(len(docs)) if (prints[a] ^ prints[b]).bit_count() <= radius] for a in range(len(docs))]
    out, seen = [], {}
    for a in range(len(docs)):
        if a not in seen:
            todo, group = [a], {a}
            while todo:
                new = set(near[todo.pop()]) - group
                group |= new
                todo += new
            ids = [docs[x][0] for x in group if docs[x][0] is not None]
            for x in group:
                seen[x] = min(ids) if ids else None
        out.append((docs[a][0], prints[a], seen[a]))
    return sorted(out, key=str)


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)] + ["É", "The", "the"]
    docs = [(i, t) for i, t in ((900, None), (901, ""), (902, "\t \n"), (None, "a b"), (None, "A b"), (903, "a\x0bb c d"), (904, "w1 " * 70_000), (905, "w1 " * 70_001), (906, "a  b"))]
    for i in range(n):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 40, 300]))]
        for _ in range(rng.choice([1, 1, 3])):
            docs.append((i * 7 % 500, " ".join(words)))
            words[rng.randrange(len(words))] = "changed"
    return docs


@pytest.mark.parametrize(("seed", "width", "radius", "parts", "tile"), [(1, 3, 2, 4, 4096), (2, 3, 2, 8, 2), (3, 5, 3, 4, 3), (4, 3, 2, 16, 4096)])
def test_matches_brute_force(spark, monkeypatch, seed, width, radius, parts, tile):
    monkeypatch.setattr(sh, "TILE", tile)
    docs = corpus(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS id", "'x' AS fp", "2 AS tile", "3 AS component_id")
    got = [(r.id, r.fp % (1 << 64), r.component_id) for r in sh.simhash_groups(d, width, radius, parts=parts).collect()]
    assert sorted(got, key=str) == brute(docs, width, radius)
    assert sh.simhash_groups(d.limit(0)).count() == 0


@pytest.mark.parametrize("parts", [4, 8, 16])
def test_tiles_within_the_radius_are_paired(parts):
    """Near fingerprints have tile numbers whose difference is a step, either way; far ones of any counts may not."""
    rng, width, bits = random.Random(parts), 64 // parts, sh.field(parts)
    known = set(sh.steps(parts, 2))

    def tile(x):
        return sum((x >> width * i & (1 << width) - 1).bit_count() << bits * i for i in range(parts))

    for x in [0, (1 << 64) - 1] + [rng.getrandbits(64) for _ in range(300)]:
        for _ in range(20):
            y = x ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
            assert tile(y) - tile(x) in known or tile(x) - tile(y) in known
    # each of the numbers within the radius, and none beyond it, is a tile whose counts are near
    top = [0, 0, width, width]
    near = {sum(c << bits * i for i, c in enumerate(top + [width // 2] * (parts - 4))) + s for s in known}
    whole = {n for n in near if all((n >> bits * i & (1 << bits) - 1) <= width for i in range(parts))}
    counts = [[n >> bits * i & (1 << bits) - 1 for i in range(parts)] for n in whole]
    assert all(sum(abs(a - b) for a, b in zip(c, top + [width // 2] * (parts - 4), strict=True)) <= 2 for c in counts)


def test_chains_and_dense_tiles():
    rng = np.random.default_rng(5)
    base = rng.integers(0, 1 << 63, dtype=np.uint64)
    a = np.unique(np.array([base ^ np.uint64(1 << i) for i in range(40)] + [base], dtype=np.uint64))
    edges = sh.spanning(a, a, 2)
    assert len(edges) == len(a) - 1
    assert sh.spanning(a, np.array([~base], dtype=np.uint64), 2) == []


def test_query_takes_whole_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    got = [(r.doc_id, int(r.fingerprint, 16), r.component_id) for r in sh.op12(spark, sf).collect()]
    assert sorted(got, key=str) == brute(docs, 3, 2)
