import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from foliate.llm import token_store as ts
from foliate.llm.shared import shared_dir

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def texts():
    rng = random.Random(4)
    bits = ["The", "naïve", "ÉCOLE", "don't", "we'll", "x1y2", "ß", "é", "́", "日本", "١٢", "…", "a\x1cb", "a b", "<|endoftext|>", "<|", "~", "\t", "\n", " ", "  ", ",", "--", "ΣΑΣ", "İ", "\U0001f600", "'s", "pre-emption", "Loweiig"]
    return [None, "", " ", "\n\n", *("".join(rng.choice(bits) + rng.choice([" ", "", "\n", " "]) for _ in range(rng.randrange(40))) for _ in range(400))]


def test_pieces_encode_as_the_library(library):
    encoder = ts.Encoder(PATH, limit=50)
    for t in texts():
        assert np.frombuffer(encoder.text(t or ""), "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids, t


def test_other_vocabularies_go_through_the_library():
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder, library = ts.Encoder(path), Tokenizer.from_file(path)
    assert ts.Encoder(PATH).by_word and not encoder.by_word
    for t in texts():
        assert np.frombuffer(encoder.text(t or ""), "<u2").tolist() == library.encode(t or "", add_special_tokens=False).ids


def test_query_has_the_library_s_ids_of_every_text(spark, library):
    from foliate.llm.queries import QUERIES

    docs = sorted(spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, start = [], 0
    for r in docs:
        ids = np.array([*library.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, QUERIES["op2_token_store"](spark, "/root/testdata/sf0.001").collect())) == want


@pytest.mark.parametrize("shard_text", [1 << 30, 300])
def test_round_trip(spark, library, shard_text):
    rows = [(i * 7 % 1009, t) for i, t in enumerate(texts())] + [(5, "again"), (5, "again"), (5, "other"), (None, "no key"), (-3, "below"), (6, "long text " * 40_000), *((17, f"hot {i}") for i in range(90))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS a", "'x' AS b", "2 AS ids", "3 AS shard")
    folder = shared_dir(spark, "tokens")
    cuts = ts.write_tokens(docs, folder, PATH, shard_text=shard_text)
    got = {}
    for r in ts.look_up(spark, folder, cuts, docs.select("doc_id")).collect():
        got.setdefault(r.key, []).append((r.start, r.ids))
    encoded = [(k, [*library.encode(t or "", add_special_tokens=False).ids, 1]) for k, t in rows]
    start = 0
    for k in [None, *sorted({k for k, _ in rows} - {None})]:
        assert sorted(ids for _, ids in got[k]) == sorted(ids for other, ids in encoded if other == k)
        for s, ids in sorted(got[k]):
            assert s == start
            start += len(ids)
    digests = {(r.key, r.start): r.ids_crc32 for r in ts.look_up(spark, folder, cuts, docs.select("doc_id"), digest=True).collect()}
    assert all(digests[k, s] == zlib.crc32(np.array(ids, "<u4").tobytes()) for k in got for s, ids in got[k])
    assert ts.look_up(spark, folder, cuts, spark.range(100_000, 100_050)).count() == 0


def test_perfect_hash_is_minimal():
    keys = ts._hashed(list(range(5000)) + [None])
    slots = ts.PerfectHash.build(keys).slots(keys)
    assert sorted(slots) == list(range(5001))


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    folder = shared_dir(spark, "tokens")
    cuts = ts.write_tokens(docs, folder, PATH)
    assert ts.look_up(spark, folder, cuts, docs.select("doc_id")).count() == 0
