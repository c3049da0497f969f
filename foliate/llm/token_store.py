"""Token-id shards with a minimal perfect hash index.

A shard is a file of raw little-endian ids in ascending key order and an index file. The index
hashes the shard's keys to 0..n-1 without a collision (levels of bit sets: a key rests at the
first level where no other key has its place; its number is the rank of that bit) and keeps,
by that number, a fingerprint and the first entry of the key. A look-up costs a few bit tests
and one slice of the payload, whatever the shard's size. A manifest names the shards.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm import ranges
from foliate.llm.files import Rolling, located, read
from foliate.llm.shared import bounded, held, mix, shared_dir

END_ID = 1
#: Bytes of text for one shard, about; entries of the memo of encoded pieces in each worker.
SHARD_TEXT, MEMO = 24 << 20, 400_000
_MAGIC = b"IDS1"
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")


#: Of vocabularies with these rules a text's ids are those of its pieces between blanks (fixed values).
_WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
}


def _byte_letters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: printable ones for
    themselves, the others from 256 on in order."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    others = iter(range(256, 512))
    return [chr(b if b in printable else next(others)) for b in range(256)]


class _Memo(dict):
    """Values by key, made when they are missing; all are forgotten at the limit."""

    def __init__(self, make, limit: int):
        super().__init__()
        self.make, self.limit = make, limit

    def __missing__(self, key):
        if len(self) >= self.limit:
            self.clear()
        made = self[key] = self.make(key)
        return made


class Encoder(dict):
    """Ids of a space-free piece of text as bytes, remembered. Pieces of Latin letters and punctuation go to the
    library's model directly, others through its whole normaliser. A vocabulary whose rules aren't _WORD_RULES
    encodes whole texts through the library alone."""

    def __init__(self, path: str, limit: int = MEMO):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole, self.limit = Tokenizer.from_file(path), limit
        self.model = self.whole.model
        self.kind = np.dtype("<u2" if self.whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code, self.parts = "H" if self.kind.itemsize == 2 else "I", _Memo(self.part, limit // 2)
        self.letters = _byte_letters()
        told = json.loads(self.whole.to_str())
        self.by_word = all(told.get(k) == v for k, v in _WORD_RULES.items())

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.limit:
            self.clear()
        if simple := _SIMPLE.fullmatch(piece):
            letters, marks = simple.groups()
            made = (self.parts[letters] if letters else b"") + (self.parts[marks] if marks else b"")
        else:
            made = array(self.code, self.whole.encode(piece, add_special_tokens=False).ids).tobytes()
        self[piece] = made
        return made

    def part(self, part: str) -> bytes:
        """Ids of a run of letters or of marks, which stands in many pieces."""
        spelled = part.lower()
        if not spelled.isascii():
            spelled = "".join([self.letters[b] for b in spelled.encode()])
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def text(self, text: str) -> bytes:
        if not self.by_word:
            return array(self.code, self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        self.ranks, base = [], 0
        for bits in levels:
            before = np.zeros(len(bits) // 64 + 1, dtype=np.int64)
            np.cumsum(bits.reshape(-1, 64).sum(axis=1), out=before[1:])
            self.ranks.append(before + base)
            base += int(before[-1])
        self.size = base

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray) -> PerfectHash:
        levels = []
        while len(keys):
            size = -(-2 * len(keys) // 64) * 64
            place = cls._place(keys, len(levels), size)
            alone = np.bincount(place, minlength=size) == 1
            levels.append(alone)
            keys = keys[~alone[place]]
        return cls(levels)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, or -1 where no level has it (other unknown keys get some number)."""
        out = np.full(len(keys), -1, dtype=np.int64)
        left = np.arange(len(keys))
        for level, bits in enumerate(self.levels):
            if not len(left):
                break
            place = self._place(keys[left], level, len(bits))
            here = bits[place]
            for i, p in zip(left[here], place[here], strict=True):
                word = p >> 6
                out[i] = self.ranks[level][word] + np.count_nonzero(bits[word << 6 : p])
            left = left[~here]
        return out


def _hashed(keys: list[int | None]) -> np.ndarray:
    """Two-word hashes of keys; null is a key of its own."""
    values = np.array([0 if k is None else k for k in keys], dtype=np.int64).view(np.uint64)
    null = np.array([k is None for k in keys], dtype=bool)
    return mix(mix(values + np.uint64(0x51)) + null.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


def pack_index(keys: list[int | None], counts: list[int]) -> bytes:
    """Index of entries in key order: equal keys stand side by side and are found together."""
    hashes = _hashed(keys)
    fresh = np.ones(len(hashes), dtype=bool)
    fresh[1:] = hashes[1:] != hashes[:-1]
    first = np.flatnonzero(fresh)
    hasher = PerfectHash.build(hashes[first])
    slots = hasher.slots(hashes[first])
    entry, run, mark = (np.zeros(len(first), dtype=t) for t in ("<u4", "<u4", "<u4"))
    entry[slots], run[slots] = first, np.diff(np.append(first, len(hashes)))
    mark[slots] = (mix(hashes[first] + np.uint64(0xF1)) >> np.uint64(32)).astype("<u4")
    offsets = np.zeros(len(counts) + 1, dtype="<u8")
    np.cumsum(counts, out=offsets[1:])
    arrays = [np.packbits(b) for b in hasher.levels] + [mark, entry, run, offsets]
    head = json.dumps([[a.dtype.str, len(a)] for a in arrays]).encode()
    return _MAGIC + len(head).to_bytes(4, "little") + head + b"".join(a.tobytes() for a in arrays)


class Shard:
    """Keyed access to a shard."""

    def __init__(self, folder: str, name: str, width: int):
        raw = read(folder, f"{name}.idx")
        if raw[:4] != _MAGIC:
            raise ValueError(f"{name}.idx is not an index")
        at = 8 + int.from_bytes(raw[4:8], "little")
        arrays = []
        for kind, n in json.loads(raw[8:at]):
            arrays.append(np.frombuffer(raw, dtype=kind, count=n, offset=at))
            at += arrays[-1].nbytes
        self.hasher = PerfectHash([np.unpackbits(a).astype(bool) for a in arrays[:-4]])
        self.mark, self.entry, self.run, self.offsets = arrays[-4:]
        system, base = located(folder)
        self.file, self.width = system.open_input_file(f"{base}/{name}.bin"), width

    def entries(self, keys: list[int | None]) -> list[range]:
        """Entries of each key; an unknown key has none (an unknown key passes with chance 2**-32)."""
        hashes = _hashed(keys)
        slots = self.hasher.slots(hashes)
        marks = (mix(hashes + np.uint64(0xF1)) >> np.uint64(32)).astype("<u4")
        return [range(int(self.entry[s]), int(self.entry[s]) + int(self.run[s])) if s >= 0 and self.mark[s] == m else range(0) for s, m in zip(slots, marks, strict=True)]

    def ids(self, entry: int) -> np.ndarray:
        a, b = int(self.offsets[entry]), int(self.offsets[entry + 1])
        return np.frombuffer(self.file.read_at((b - a) * self.width, a * self.width), dtype=f"<u{self.width}")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str, key: str = "doc_id", text: str = "text", shard_text: int = SHARD_TEXT) -> ranges.Cuts:
    """Encodes all texts, appends END_ID to each and writes the shards below folder in ascending key
    order, nulls first; returns the cuts between shards, which hold about shard_text bytes of text each.

    A null or empty text has the end id alone. Rows that share a key stand side by side, in the order
    of hashes of their texts; a key of many rows may go on in further shards. Other columns are not read.
    An empty table gives one manifest without shards. Keys are whole numbers; others are an error.
    """
    rows = bounded(docs).select(F.col(key).cast("long").alias("a"), F.xxhash64(F.col(text)).alias("b"), F.col(text).alias("text"))
    cuts = ranges.cuts(rows, F.octet_length(F.coalesce("text", F.lit(""))) + 1, shard_text)

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held(("words", vocabulary), lambda: Encoder(vocabulary))
        end = np.array([END_ID], dtype=encoder.kind).tobytes()
        for batch in batches:
            for low in range(0, len(batch), 1000):
                part = batch.slice(low, 1000)
                ids = [encoder.text(t or "") + end for t in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())], names=["a", "b", "ids"])

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, out, keys, counts, width = "", None, [], [], 2
        for batch in batches:
            for key, ids, shard, width in zip(*(c.to_pylist() for c in batch.columns), strict=True):  # noqa: B007
                if out is None:
                    name = f"shard-{shard:06d}"
                    out = Rolling(folder, f"{name}.bin")
                out.write(ids)
                keys.append(key)
                counts.append(len(ids) // width)
        if out is not None:
            index = Rolling(folder, f"{name}.idx")
            index.write(pack_index(keys, counts))
            index.commit()
            out.commit()
            yield pa.RecordBatch.from_pydict({"shard": [int(name[6:])], "name": [name], "docs": [len(keys)], "tokens": [sum(counts)], "width": [width]})

    from tokenizers import Tokenizer

    width = 2 if Tokenizer.from_file(vocabulary).get_vocab_size() <= 1 << 16 else 4
    encoded = rows.mapInArrow(encode, "a long, b long, ids binary").withColumn("shard", ranges.number(F.col("a"), F.col("b"), cuts))
    dealt = encoded.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.col("a").asc_nulls_first(), "b", "ids")
    dealt.select("a", "ids", "shard", F.lit(width).alias("width")).mapInArrow(write, "shard long, name string, docs long, tokens long, width long").write.parquet(f"{folder}/manifest")
    return cuts


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, with the tokens of all shards before it. A row stands for SHARD_TEXT bytes of text."""
    shards = spark.read.schema("shard long, name string, docs long, tokens long, width long").parquet(f"{folder}/manifest")
    return shards.withColumn("base", F.sum("tokens").over(Window.orderBy("shard")) - F.col("tokens"))


def look_up(spark: SparkSession, folder: str, cuts: ranges.Cuts, keys: DataFrame, digest: bool = False) -> DataFrame:
    """Rows (key, start, n_tokens, ids or ids_crc32) for each entry that the shards have under each row of
    keys (one column). Keys that no shard has give no row."""
    shards = {r.shard: (r.name, r.base, r.width) for r in manifest(spark, folder).collect()}
    least, most = (ranges.number(F.col("key"), F.lit(b).cast("long"), cuts) for b in (-(1 << 63), (1 << 63) - 1))
    wanted = keys.toDF("key").select(F.col("key").cast("long").alias("key")).distinct().withColumn("shard", F.explode(F.sequence(least, most)))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: dict[int, Shard] = {}
        for batch in batches:
            shard = np.array(batch.column(1).to_pylist(), dtype=np.int64)
            for s in np.unique(shard).tolist():
                if s not in shards:
                    continue
                name, base, width = shards[s]
                if s not in opened:
                    opened.clear()
                    opened[s] = Shard(folder, name, width)
                own = batch.column(0).filter(pa.array(shard == s)).to_pylist()
                out = []
                for key, entries in zip(own, opened[s].entries(own), strict=True):
                    for e in entries:
                        ids = opened[s].ids(e)
                        out.append((key, base + int(opened[s].offsets[e]), len(ids), zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.tolist()))
                columns = list(zip(*out, strict=True)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.int64() if digest else pa.list_(pa.int64()))], names=["key", "start", "n_tokens", "ids_crc32" if digest else "ids"])

    dealt = wanted.repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions(F.col("key").asc_nulls_first())
    return dealt.mapInArrow(find, f"key long, start long, n_tokens long, {'ids_crc32 long' if digest else 'ids array<long>'}")


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs, folder = spark.read.parquet(f"{sf_dir}/documents.parquet"), shared_dir(spark, "tokens")
    cuts = write_tokens(docs, folder, public_tokenizers.path("word_bpe_49k.json"))
    found = look_up(spark, folder, cuts, docs.select("doc_id"), digest=True)
    return found.withColumnRenamed("key", "doc_id")
