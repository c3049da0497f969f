"""Motion-JPEG AVI columns: a writer that stores bytes losslessly, a reader, and shot detection.

The writer puts bytes into quantised DCT coefficients, the unit that JPEG keeps exactly. A
minimum coded unit of three 8 x 8 blocks has 192 of them. The Huffman tables have one symbol,
run 0 and size 8, whose eight value bits are the byte; every unit is a restart interval. Any
baseline decoder reads such frames. The reader takes any baseline frame without
subsampling: it finds frames through the RIFF index and decodes all restart intervals of a
block of texts side by side, one symbol of each at a time.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.shared import as_bytes, blocks, bounded

UNIT = 192
#: Units in a row and in a column of a frame of a longer text; frames per second.
GRID, RATE = 4, 25
#: Bins of the luma histogram; the window on either side, factor and floor of the adaptive threshold; the fewest
#: neighbours that it is taken from, and the fixed threshold where there are fewer.
BINS, WINDOW, FACTOR, FLOOR, NEIGHBOURS, SUDDEN = 32, 12, 4.0, 0.1, 3, 0.5


def _zigzag() -> np.ndarray:
    """Row-major place of each coefficient along the diagonals of a block."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([8 * r + c for r, c in cells])


ZIGZAG = _zigzag()
_WAVE = np.sqrt(np.where(np.arange(8) == 0, 1, 2) / 8)[:, None] * np.cos(np.arange(8)[:, None] * (2 * np.arange(8)[None] + 1) * np.pi / 16)
#: Samples of a block from its coefficients in zigzag order.
SAMPLES = np.einsum("ux,vy->uvxy", _WAVE, _WAVE).reshape(64, 64)[ZIGZAG].astype(np.float32)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head(wide: int, high: int) -> bytes:
    one_code = bytes([1] + [0] * 15 + [8])
    return (
        b"\xff\xd8"
        + _segment(0xDB, b"\x00" + b"\x01" * 64)
        + _segment(0xC0, struct.pack(">BHHB", 8, high, wide, 3) + b"".join(bytes([c, 0x11, 0]) for c in (1, 2, 3)))
        + _segment(0xC4, b"\x00" + one_code + b"\x10" + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([3, 1, 0, 2, 0, 3, 0, 0, 63, 0]))
    )


def pack_units(payloads: np.ndarray) -> list[bytes]:
    """Entropy-coded data of each unit of 192 bytes: a zero bit before every byte, then byte stuffing."""
    bits = np.zeros((len(payloads), UNIT, 9), dtype=np.uint8)
    bits[:, :, 1:] = np.unpackbits(payloads.reshape(-1, UNIT, 1), axis=2)
    packed = np.packbits(bits.reshape(len(payloads), -1), axis=1)
    raw, size = packed.tobytes(), packed.shape[1]
    return [raw[i : i + size].replace(b"\xff", b"\xff\x00") for i in range(0, len(raw), size)]


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(units: list[bytes], n_payload: int, n_bytes: int, blank: bytes) -> bytes:
    """The AVI file of one text's units; blank is the unit that fills its last frame."""
    wide, high = (len(units), 1) if len(units) < GRID * GRID else (GRID, GRID)
    per_frame, head = wide * high, _jpeg_head(8 * wide, 8 * high)
    frames = []
    for low in range(0, len(units), per_frame):
        own = units[low : low + per_frame]
        own += [blank] * (per_frame - len(own))
        data = own[0] + b"".join(bytes((0xFF, 0xD0 + i % 8)) + u for i, u in enumerate(own[1:]))
        frames.append(head + data + b"\xff\xd9")
    movi, index, at = [], [], 4
    for f in frames:
        movi.append(_chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(movi[-1])
    most = max(map(len, frames))
    main = struct.pack("<14I", 1_000_000 // RATE, most * RATE, 0, 0x10, len(frames), 0, 1, most, 8 * wide, 8 * high, 0, 0, 0, 0)
    stream = struct.pack("<4s4sIHHIIIIIIIIHHHH", b"vids", b"MJPG", 0, 0, 0, 0, 1, RATE, 0, len(frames), most, 0xFFFFFFFF, 0, 0, 0, 8 * wide, 8 * high)
    form = struct.pack("<IiiHH4sIiiII", 40, 8 * wide, 8 * high, 1, 24, b"MJPG", 192 * per_frame, 0, 0, 0, 0)
    headers = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", main) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d bytes=%d\0" % (n_payload, n_bytes)))
    return _chunk(b"RIFF", b"AVI " + headers + info + _chunk(b"LIST", b"movi" + b"".join(movi)) + _chunk(b"idx1", b"".join(index)))


@dataclass
class Movie:
    frames: list[bytes]
    rate: float
    comment: str


def parse_avi(data: bytes) -> Movie:
    """Frames by the idx1 index (offsets from movi or from the file's start), or in file order where there is none."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    found = {"rate": 0.0, "comment": "", "movi": (0, 0), "index": None, "frames": []}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            body = at + 8
            if name == b"LIST" and data[body : body + 4] == b"movi":
                found["movi"] = (body, body + size)
            elif name == b"LIST":
                walk(body + 4, body + size)
            elif name == b"strh" and data[body : body + 4] == b"vids":
                scale, rate = struct.unpack_from("<II", data, body + 20)
                found["rate"] = rate / max(scale, 1)
            elif name == b"ICMT":
                found["comment"] = data[body : body + size].rstrip(b"\0").decode("latin-1")
            elif name == b"idx1":
                found["index"] = data[body : body + size]
            at = body + size + size % 2

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    base, end = found["movi"]
    frames = []
    if found["index"] is not None:
        for name, _, at, size in struct.iter_unpack("<4sIII", found["index"]):
            start = base + at if data[base + at : base + at + 4] == name else at
            if name[2:] in (b"dc", b"db"):
                frames.append(data[start + 8 : start + 8 + size])
    else:
        at = base + 4
        while at + 8 <= end:
            size = struct.unpack_from("<I", data, at + 4)[0]
            if data[at + 2 : at + 4] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return Movie(frames, found["rate"], found["comment"])


@dataclass
class Frame:
    """Headers of a baseline frame: size, quantisation and lookups of each component, units between restarts."""

    wide: int
    high: int
    quant: list[np.ndarray]
    dc: list[np.ndarray]
    ac: list[np.ndarray]
    restart: int
    alike: bytes  # equal for frames with the same tables

    @property
    def units(self) -> int:
        return -(-self.wide // 8) * -(-self.high // 8)

    @property
    def step(self) -> int:
        """Units of a restart interval."""
        return self.restart or self.units


def _lookup(counts: bytes, symbols: bytes) -> np.ndarray:
    """Code length and symbol (length << 8 | symbol) for each 16-bit prefix; length 0 is no code."""
    table, code, at = np.zeros(1 << 16, dtype=np.int32), 0, 0
    for length, n in enumerate(counts, 1):
        for symbol in symbols[at : at + n]:
            low = code << (16 - length)
            table[low : low + (1 << (16 - length))] = length << 8 | symbol
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse_frame(data: bytes, known: dict[bytes, Frame]) -> tuple[Frame, bytes]:
    """Headers, read once for equal bytes, and the entropy-coded data behind them."""
    at, quant, tables, parts, high, wide, restart, alike = 2, {}, {}, [], 0, 0, 0, b""
    while data[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", data, at + 2)[0]
    stop = at + 2 + struct.unpack_from(">H", data, at + 2)[0]
    head, coded = data[:stop], data[stop : data.rindex(b"\xff\xd9")]
    if head in known:
        return known[head], coded
    at = 2
    while at < stop:
        marker, size = head[at + 1], struct.unpack_from(">H", head, at + 2)[0]
        body = head[at + 4 : at + 2 + size]
        alike += b"" if marker == 0xC0 else head[at : at + 2 + size]
        if marker == 0xDB:
            while body:
                if body[0] >> 4:
                    raise ValueError("16-bit quantisation is not baseline")
                quant[body[0] & 15], body = np.frombuffer(body[1:65], dtype=np.uint8).astype(np.float32), body[65:]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0] >> 4, body[0] & 15], body = _lookup(body[1:17], body[17 : 17 + n]), body[17 + n :]
        elif marker == 0xC0:
            _, high, wide, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i], body[8 + 3 * i]) for i in range(n)]
            alike += body[5:]
            if any(sampling != 0x11 for _, sampling, _ in parts):
                raise ValueError("subsampled components are not read")
        elif 0xC1 <= marker <= 0xCF and marker != 0xC8:
            raise ValueError("only baseline frames are read")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
        at += 2 + size
    known[head] = Frame(wide, high, [quant[q] for _, _, q in parts], [tables[0, chosen[c] >> 4] for c, _, _ in parts], [tables[1, chosen[c] & 15] for c, _, _ in parts], restart, alike)
    return known[head], coded


def _intervals(coded: bytes) -> list[bytes]:
    """Restart intervals without byte stuffing."""
    at, start, out = 0, 0, []
    while (at := coded.find(b"\xff", at)) >= 0:
        if at + 1 < len(coded) and 0xD0 <= coded[at + 1] <= 0xD7:
            out.append(coded[start:at])
            start = at + 2
        at += 2
    out.append(coded[start:])
    return [x.replace(b"\xff\x00", b"\xff") for x in out]


def coefficients(frames: list[Frame], coded: list[bytes]) -> list[np.ndarray]:
    """Coefficients [unit, component, 64] of frames with the same tables and step; intervals advance side by side."""
    parts, step = len(frames[0].quant), frames[0].step
    cut = [_intervals(c) for c in coded]
    if any(len(x) != -(-f.units // step) for f, x in zip(frames, cut, strict=True)):
        raise ValueError("the number of restart intervals doesn't fit the frame")
    lanes = [x for c in cut for x in c]
    sizes = np.array([len(x) for x in lanes])
    starts = np.concatenate([[0], np.cumsum(sizes + 8)])
    raw = np.frombuffer(b"".join(x + b"\xff" * 8 for x in lanes), dtype=np.uint8).astype(np.uint64)
    ahead = raw[:-4] << np.uint64(32) | raw[1:-3] << np.uint64(24) | raw[2:-2] << np.uint64(16) | raw[3:-1] << np.uint64(8) | raw[4:]
    out = np.zeros((len(lanes), step * parts * 64), dtype=np.int16)
    todo = np.concatenate([np.minimum(step, f.units - np.arange(len(c)) * step) for f, c in zip(frames, cut, strict=True)]) * parts
    bit = starts[:-1] * 8
    lane, block, k = np.arange(len(lanes)), np.zeros(len(lanes), dtype=np.int64), np.zeros(len(lanes), dtype=np.int64)
    before = np.zeros((len(lanes), parts), dtype=np.int64)
    tables = np.stack([*frames[0].dc, *frames[0].ac])
    while len(lane):
        part = block % parts
        first = k == 0
        begins = first.any()
        window = ahead[bit >> 3]
        shift = (bit & 7).astype(np.uint64)
        code = tables[np.where(first, part, part + parts), ((window >> (np.uint64(24) - shift)) & np.uint64(0xFFFF)).astype(np.int64)]
        length, symbol = code >> 8, code & 255
        if not length.all():
            raise ValueError("a code is in no Huffman table")
        size = np.where(first, symbol, symbol & 15)
        skip = np.where(first, 0, symbol >> 4)
        value = ((window >> (np.uint64(40) - shift - length.astype(np.uint64) - size.astype(np.uint64))) & ((np.uint64(1) << size.astype(np.uint64)) - np.uint64(1))).astype(np.int64)
        value = np.where(value < (1 << size) >> 1, value - (1 << size) + 1, value)
        value[size == 0] = 0
        bit = bit + length + size
        at = k + skip
        if begins:
            rows = np.flatnonzero(first)
            before[lane[rows], part[rows]] += value[rows]
            value[rows] = before[lane[rows], part[rows]]
        put = (size > 0) | first
        out[lane[put], block[put] * 64 + at[put].clip(max=63)] = value[put]
        k = np.where(~first & (size == 0) & (skip < 15), 64, at + 1)
        full = k >= 64
        if full.any():
            block, k = np.where(full, block + 1, block), np.where(full, 0, k)
            live = block < todo[lane]
            if not live.all():
                lane, block, k, bit = lane[live], block[live], k[live], bit[live]
    ends = np.cumsum([len(c) for c in cut])
    return [out[e - len(c) : e].reshape(-1, parts, 64)[: f.units] for e, c, f in zip(ends, cut, frames, strict=True)]


def histograms(frame: Frame, coefs: list[np.ndarray]) -> np.ndarray:
    """Share of each luma bin among the samples of each of several frames with the same quantisation."""
    sizes = np.array([len(c) for c in coefs])
    luma = (np.concatenate([c[:, 0] for c in coefs]).astype(np.float32) * frame.quant[0]) @ SAMPLES + 128
    bins = (luma.clip(0, 255) * (BINS / 256)).astype(np.int32).clip(max=BINS - 1)
    bins += (np.repeat(np.arange(len(coefs)), sizes) * BINS).astype(np.int32)[:, None]
    return np.bincount(bins.ravel(), minlength=len(coefs) * BINS).reshape(-1, BINS) / (sizes[:, None] * 64)


def shots(hists: np.ndarray) -> tuple[list[int], np.ndarray]:
    """First frames of the shots, and half the absolute histogram difference of each frame to the one before.

    A shot begins where the difference is at least FLOOR and above the mean of the WINDOW differences on either
    side by FACTOR standard deviations: steady change, as of noise, begins none. Movies of few frames take SUDDEN.
    """
    if not len(hists):
        return [], np.zeros(0)
    moves = np.concatenate([[0], np.abs(np.diff(hists, axis=0)).sum(axis=1) / 2])
    cuts = [0]
    for i in range(1, len(moves)):
        around = np.concatenate([moves[max(1, i - WINDOW) : i], moves[i + 1 : i + 1 + WINDOW]])
        limit = around.mean() + FACTOR * around.std() + 1e-12 if len(around) >= NEIGHBOURS else SUDDEN
        if moves[i] >= FLOOR and moves[i] > limit:
            cuts.append(i)
    return cuts, moves


def timed(hists: np.ndarray, rate: float) -> list[dict]:
    """The clips of a movie: first frame, number of frames, seconds of begin and end, and the difference that began each."""
    cuts, moves = shots(hists)
    return [{"first_frame": a, "frames": b - a, "start_s": a / rate, "end_s": b / rate, "difference": float(moves[a])} for a, b in zip(cuts, [*cuts[1:], len(hists)], strict=True)]


def decode(movies: list[Movie]) -> list[tuple[bytes, np.ndarray]]:
    """Bytes in the coefficients, and frame histograms, of each movie; frames with equal tables are decoded together."""
    known: dict[bytes, Frame] = {}
    parsed = [[parse_frame(f, known) for f in m.frames] for m in movies]
    together: dict[tuple[bytes, int], list[tuple[int, int]]] = {}
    for i, frames in enumerate(parsed):
        for j, (frame, _) in enumerate(frames):
            together.setdefault((frame.alike, frame.step), []).append((i, j))
    data = [[b""] * len(p) for p in parsed]
    hists = [np.zeros((len(p), BINS)) for p in parsed]
    for places in together.values():
        frames = [parsed[i][j][0] for i, j in places]
        coefs = coefficients(frames, [parsed[i][j][1] for i, j in places])
        found = histograms(frames[0], coefs)
        for own, row, (i, j) in zip(coefs, found, places, strict=True):
            data[i][j] = np.where(own >= 0, own, own + 255).astype(np.uint8).tobytes()
            hists[i][j] = row
    return [(b"".join(d), h) for d, h in zip(data, hists, strict=True)]


def encoded(blobs: list[bytes]) -> Iterator[bytes]:
    """The AVI file of each text."""
    for low, high in blocks(blobs):
        padded = [b.ljust(max(1, -(-len(b) // UNIT)) * UNIT) for b in blobs[low:high]]
        units = pack_units(np.frombuffer(b"".join([*padded, b" " * UNIT]), dtype=np.uint8).reshape(-1, UNIT))
        at = 0
        for blob, whole in zip(blobs[low:high], padded, strict=True):
            n = len(whole) // UNIT
            yield avi(units[at : at + n], len(whole), len(blob), units[-1])
            at += n


def _described(media: list[bytes]) -> Iterator[tuple]:
    """Movie, stored payload, unpadded length and histograms of each file."""
    for low, high in blocks(media):
        movies = [parse_avi(m) for m in media[low:high]]
        for movie, (data, hists) in zip(movies, decode(movies), strict=True):
            told = dict(x.split("=") for x in movie.comment.split() if "=" in x)
            yield movie, data[: int(told.get("payload", len(data)))], int(told.get("bytes", len(data))), hists


def encode_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, media): the text's UTF-8 bytes, padded with spaces to a positive multiple of UNIT, as an AVI
    file. Null and empty texts make one unit of spaces; equal texts equal files; an empty table no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _encode_batches(batches)

    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    return rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, media binary").withColumnRenamed("key", key)


def _encode_batches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        blobs = as_bytes(batch.column(1))
        for low, high in blocks(blobs):
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(low, high - low), pa.array(list(encoded(blobs[low:high])), pa.large_binary())], names=["key", "media"])


def clips(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per shot: key, clip, first_frame, frames, start_s, end_s, and the difference that began it.
    Null media give no rows; a file that is no AVI with baseline frames is an error."""
    rows = bounded(media).select(F.col(key).alias("key"), F.col(column).alias("media")).where("media IS NOT NULL")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, (movie, _, _, hists) in zip(batch.column(0).to_pylist(), _described(batch.column(1).to_pylist()), strict=True):
                out += [(key, i, *clip.values()) for i, clip in enumerate(timed(hists, movie.rate))]
            kinds = [batch.column(0).type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            names = ["key", "clip", "first_frame", "frames", "start_s", "end_s", "difference"]
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=names)

    made = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, clip long, first_frame long, frames long, start_s double, end_s double, difference double")
    return made.withColumnRenamed("key", key)


_CLIP = pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("difference", pa.float64())])


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes each text, reads the stored bytes back, and gives sizes, digests, shots and timed clips. One pass in a task.

    Null and empty texts are one unit of spaces; equal texts have equal values, repeated rows and null keys are kept;
    other columns are not read; an empty table gives no rows. A long text is a movie of many frames, read as a whole.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _encode_batches(batches):
            media, out = batch.column(1).to_pylist(), []
            for file, (movie, payload, n_bytes, hists) in zip(media, _described(media), strict=True):
                clips = timed(hists, movie.rate)
                largest = max([c["difference"] for c in clips[1:]], default=0.0)
                feature = f"frames={len(hists)};shots={len(clips)};cuts={'|'.join(str(c['first_frame']) for c in clips[1:])};largest={largest:.4f}"
                out.append((n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(file), hashlib.sha256(file).hexdigest(), feature, clips))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(_CLIP)]
            names = ["key", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "clips"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([o[i] for o in out], k) for i, k in enumerate(kinds))], names=names)

    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    clip = "array<struct<first_frame: bigint, frames: bigint, start_s: double, end_s: double, difference: double>>"
    made = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, clips {clip}")
    return made.withColumnRenamed("key", key)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))
