import hashlib
import random
import zlib

import numpy as np

from foliate.llm import media


def texts():
    rng = random.Random(7)
    made = ["".join(rng.choice("abc é日\n .") for _ in range(n)) for n in (0, 1, 63, 191, 192, 193, 900, 3071, 3072, 3073, 20_000)]
    return [None, *made, made[5], "x" * 7000 + "é" * 7000]


def test_round_trip(spark):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts())] + [(None, "no key", 2)], "doc_id long, text string, media int")
    got = {r.doc_id: r for r in media.digests(docs).collect()}
    assert len(got) == docs.count()
    for i, t in [*enumerate(texts()), (None, "no key")]:
        raw = (t or "").encode()
        payload = raw + b" " * (192 * max(1, -(-len(raw) // 192)) - len(raw))
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert media.decode([media.parse_avi(next(media.encoded([raw])))])[0][0].startswith(payload)
    assert got[0][1:] == got[1][1:] and got[6][1:] == got[12][1:]
    stored = media.encode_media(docs)
    assert sorted((r.doc_id, len(r.media)) for r in stored.where("doc_id IS NOT NULL").collect()) == sorted((i, r.media_bytes) for i, r in got.items() if i is not None)
    timed = media.clips(stored).where("doc_id = 13").orderBy("clip").collect()
    assert [c.clip for c in timed] == list(range(len(timed))) and len(timed) >= 2
    assert timed[0].start_s == 0 and all(a.end_s == b.start_s for a, b in zip(timed, timed[1:], strict=False))
    assert media.digests(docs.limit(0)).count() == 0


def bits_of(values):
    """Entropy-coded data of one block list by a plain encoder: sizes as 4-bit DC codes, run/size as 8-bit AC codes."""
    out, before = "", [0, 0, 0]
    for n, block in enumerate(values):
        delta = int(block[0]) - before[n % 3]
        before[n % 3] = int(block[0])
        size = abs(delta).bit_length()
        out += f"{size:04b}" + (f"{delta if delta > 0 else delta + (1 << size) - 1:0{size}b}" if size else "")
        run, last = 0, max([i for i in range(1, 64) if block[i]], default=0)
        for v in map(int, block[1 : last + 1]):
            if not v:
                run += 1
                continue
            while run > 15:
                out += f"{0xF0:08b}"
                run -= 16
            size = abs(v).bit_length()
            out += f"{run << 4 | size:08b}" + f"{v if v > 0 else v + (1 << size) - 1:0{size}b}"
            run = 0
        if last < 63:
            out += f"{0:08b}"
    out += "1" * (-len(out) % 8)
    return int(out, 2).to_bytes(len(out) // 8, "big").replace(b"\xff", b"\xff\x00")


def test_reads_frames_with_runs_prediction_and_no_restarts():
    rng = np.random.default_rng(3)
    values = rng.integers(-60, 60, size=(2 * 3, 64)) * (rng.random((6, 64)) < 0.1)
    values[2] = 0
    values[3, 63] = 5
    dc = media._segment(0xC4, b"\x00" + bytes([0, 0, 0, 12] + [0] * 12) + bytes(range(12)))
    symbols = bytes(s for s in range(0xF8))
    ac = media._segment(0xC4, b"\x10" + bytes([0] * 7 + [len(symbols)] + [0] * 8) + symbols)
    head = media._jpeg_head(16, 8)
    huffman = head.index(b"\xff\xc4")
    scan = head[head.index(b"\xff\xda") :]
    frame = head[:huffman] + dc + ac + scan + bits_of(values) + b"\xff\xd9"
    parsed, coded = media.parse_frame(frame, {})
    assert (media.coefficients([parsed, parsed], [coded, coded])[1].reshape(6, 64) == values).all()


def test_samples_are_the_inverse_transform():
    flat = np.zeros(64, dtype=np.float32)
    flat[0] = 80
    assert np.allclose(flat @ media.SAMPLES, 10, atol=1e-4)
    assert np.allclose(media.SAMPLES @ media.SAMPLES.T, np.eye(64), atol=1e-5)


def test_shots_adapt_to_the_motion_before():
    calm, other = np.eye(media.BINS)[[0]], np.eye(media.BINS)[[5]]
    assert media.shots(np.concatenate([calm] * 5 + [other] * 5))[0] == [0, 5]
    noise = np.random.default_rng(1).dirichlet(np.ones(media.BINS) * 4, size=60)
    noise[30:] = np.random.default_rng(2).dirichlet(np.r_[np.ones(4) * 90, np.ones(28)], size=30)
    assert media.shots(noise[:30])[0] == [0] and media.shots(noise)[0] == [0, 30]
    assert [c["end_s"] for c in media.timed(noise, 25)] == [1.2, 2.4]
    assert media.shots(np.concatenate([calm * (1 - t) + other * t for t in np.linspace(0, 1, 11)]))[0] == [0]


def test_query_columns(spark):
    from foliate.llm.queries import QUERIES

    rows = QUERIES["op1_media"](spark, "/root/testdata/sf0.001").collect()
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert len(rows) == len(docs)
    for r in rows:
        payload = docs[r.doc_id].ljust(192 * max(1, -(-len(docs[r.doc_id]) // 192)))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(docs[r.doc_id]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert r.clips[0].start_s == 0 and sum(c.frames for c in r.clips) == int(r.feature.split(";")[0][7:])
    assert np.mean([len(r.clips) / sum(c.frames for c in r.clips) for r in rows if sum(c.frames for c in r.clips) > 4]) < 0.5
