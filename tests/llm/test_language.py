import itertools
import random
import zlib

import numpy as np
import pytest

from foliate.llm import language as la

SF = "/root/testdata/sf0.001"
SYLLABLES = {"aa": ["ka", "lo", "mi", "tor"], "bb": ["ße", "ung", "sch", "ach"], "cc": ["ción", "ña", "que", "ll"]}


def word(rng, lang):
    return "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4)))


def corpus(n=300, seed=2):
    rng = random.Random(seed)
    return [(i, " ".join(word(rng, lang) for _ in range(rng.randrange(1, 90))), lang) for i, lang in enumerate(rng.choice(list(SYLLABLES)) for _ in range(n))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = corpus()
    return spark.createDataFrame([*rows, (900, None, "aa"), (901, "", "aa"), (902, "123 ?! ² ½ Ⅷ", "bb"), (903, rows[0][1], None), (904, "kalo " * 20_000, "cc"), (904, "kalo " * 20_000, "cc"), (None, "tor", "aa")], "doc_id long, text string, lang string")


def test_held_out_accuracy_and_odd_texts(spark, docs):
    crf = la.learn(docs)
    truth = {i: lang for i, _, lang in corpus()}
    rows = la.predict(docs, crf).withColumn("held_out", la.held_out("doc_id")).collect()
    own = [r for r in rows if r.doc_id in truth and r.held_out]
    assert len(own) > 30 and np.mean([r.lang_pred == truth[r.doc_id] for r in own]) > 0.95
    by = {r.doc_id: r for r in rows}
    assert all((by[i].lang_pred, by[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert by[903].lang_pred == by[0].lang_pred and by[903].score == pytest.approx(by[0].score)
    assert by[904].lang_pred == "aa" and sum(r.doc_id == 904 for r in rows) == 2
    assert la.predict(docs.limit(0), crf).count() == 0
    assert {r.lang_pred for r in la.predict(docs, la.learn(docs.limit(0))).collect()} == {"und"}


def test_code_switched_words(spark, docs):
    crf = la.learn(docs)
    rng = random.Random(9)
    switched = " ".join([word(rng, "aa") for _ in range(15)] + [word(rng, "cc") for _ in range(15)])
    rows = [(1, "¡é " + switched), (2, None), (3, ""), (4, "12"), (1, "¡é " + switched)]
    found = la.word_labels(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "0 AS spans", "1 AS key"), crf).collect()
    by = {r.doc_id: r.spans for r in found}
    assert len(found) == 5 and by[2] == by[3] == by[4] == []
    last = by[1][-1]
    assert last.lang == "cc" and rows[0][1][last.start : last.end].split() == switched.split()[15:] and 0.5 < last.probability <= 1
    assert by[1][-2].lang == "aa" and rows[0][1][: by[1][-2].end].split()[-15:] == switched.split()[:15]


def test_whole_texts_are_one_sequence():
    rng = np.random.default_rng(3)
    size = np.array([0, 1, 31, 32, 33, 500, 0, 97, 64])
    bounds = np.concatenate([[0], np.cumsum(size)])
    scores, transitions, start = 3 * rng.normal(size=(size.sum(), 4)), 2 * rng.normal(size=(4, 4)), rng.normal(size=4)
    full = size > 0
    plain = la.forward_backward(scores, bounds[:-1][full], size[full], transitions, start)
    assert np.allclose(la.posteriors(scores, bounds, transitions, start), plain)


def test_query_columns(spark):
    from foliate.llm.queries import QUERIES

    got = QUERIES["op6_language"](spark, SF)
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = got.collect()
    assert got.columns == ["doc_id", "held_out", "lang_pred", "score"] and sorted(r.doc_id for r in rows) == sorted(docs)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    known = [r for r in rows if r.held_out and docs[r.doc_id].lang and r.lang_pred != "und"]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in known]) > 0.95


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    scores, transitions, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    begin, length = np.array([0, 4, 5]), np.array([4, 1, 4])
    post, counts, log_z = la.forward_backward(scores, begin, length, transitions, start, pairs=True)
    for s, (b, n) in enumerate(zip(begin, length, strict=True)):
        total, marginal = 0.0, np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            weight = np.exp(start[path[0]] + sum(scores[b + i, y] for i, y in enumerate(path)) + sum(transitions[x, y] for x, y in itertools.pairwise(path)))
            total += weight
            for i, y in enumerate(path):
                marginal[i, y] += weight
        assert np.allclose(post[b : b + n], marginal / total) and np.isclose(log_z[s], np.log(total))
    assert np.isclose(counts.sum(), (length - 1).sum())
