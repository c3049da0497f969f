"""Phrases whose words go together, counted by prefix-free parsing.

Each text is cut into chunks where the hash of the next words says so, so that equal passages give equal chunks wherever they
stand. A chunk runs on over the words that open the next one, which makes every n-gram lie whole in some chunk; it counts in the
chunk that owns its first word, so that overlaps count once. The dictionary holds distinct chunks and how often they occur;
n-grams are counted within it, weighted. They are counted by hash, length by length, and only where both parts that are one
word shorter may be frequent; with each hash goes a place where it stands, from which a frequent phrase is read in the end.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.shared import as_bytes, blocks, bounded, byte_class, discard, listed, mix, stored, words

#: A chunk ends where the hash of the next words is a multiple of PERIOD, and after MOST_WORDS at the latest.
PERIOD, MOST_WORDS = 32, 256
#: Bytes of chunks that a task turns into arrays at a time; entries that it adds up before it passes them on.
BLOCK, ENTRIES = 3 << 20, 2_000_000
#: Bits of a place that tell the word within its chunk, and phrases that all tasks hold to look up their parts.
PLACE, KNOWN = 9, 100_000
#: Bits of a filter for each entry, and the logarithm of the most that it has (32 MB). A filter with too few of them lets more pass, and loses none.
FILTER_BITS, FILTER_MOST = 16, 28
#: Logarithm of the bits that a task of its making sets.
PIECE = 15
_MANY = np.uint64(0x9E3779B97F4A7C15)
_SPLITS = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ\t.,;:!?\x0b\x0c\r", b"abcdefghijklmnopqrstuvwxyz \n\n\n\n\n\n\n\n\n")
_TOKEN = ~byte_class((0x20, 0x20), (0x0A, 0x0A))


def chunks(blobs: list[bytes], span: int) -> Iterator[tuple[int, bytes, int]]:
    """(text, chunk, owned): chunks of each text in order, pieces told apart by line ends, and the number of words that open none of the next."""
    for low, high in blocks(blobs):
        stream = words([b.translate(_SPLITS) for b in blobs[low:high]], _TOKEN)
        h, raw, start, end = stream.hashes(), stream.buffer.tobytes(), stream.start.tolist(), stream.end.tolist()
        rolled = np.zeros(max(len(h) - span + 1, 0), dtype=np.uint64)
        for i in range(span):
            rolled = mix(rolled * _MANY + h[i : i + len(rolled)])
        triggers, bounds = np.flatnonzero(rolled % np.uint64(PERIOD) == 0), stream.bounds
        at = np.searchsorted(triggers, bounds)
        for i in range(high - low):
            a, b = int(bounds[i]), int(bounds[i + 1])
            if a == b:
                continue
            cuts = [a, *(t for t in triggers[at[i] : at[i + 1]].tolist() if a < t <= b - span), b]
            for s, e in zip(cuts, cuts[1:], strict=False):
                for x in range(s, e, MOST_WORDS):
                    y = min(x + MOST_WORDS, e)
                    yield low + i, raw[start[x] : end[min(y + span, b) - 1]], y - x


def _parsed(span: int):
    """Rows (lang, chunk, owned, n) of rows (lang, text), added up within a batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs = batch.column(0).to_pylist()
            found = Counter((langs[i], chunk, owned) for i, chunk, owned in chunks(as_bytes(batch.column(1)), span))
            yield pa.RecordBatch.from_arrays([
                pa.array([k[0] for k in found], pa.string()),
                pa.array([k[1] for k in found], pa.binary()).cast(pa.string()),
                pa.array([k[2] for k in found], pa.int32()),
                pa.array(list(found.values()), pa.int64()),
            ], names=["lang", "chunk", "owned", "n"])

    return run


class Filter:
    """A set of hashes with false positives only: one bit for each value of their leading bits."""

    def __init__(self, log: int, pieces: Iterable[tuple[int, bytes]]):
        self.log, self.bits = log, np.zeros(1 << (log - 3), dtype=np.uint8)
        for at, piece in pieces:
            self.bits[at << (PIECE - 3) : (at + 1) << (PIECE - 3)] = np.frombuffer(piece, dtype=np.uint8)

    def has(self, hashes: np.ndarray) -> np.ndarray:
        slot = hashes >> np.uint64(64 - self.log)
        return (self.bits[slot >> np.uint64(3)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def frequent(counted: DataFrame, least: int) -> DataFrame:
    """Rows (h, n, place) of the hashes whose sum of n reaches least; written."""
    return stored(counted.groupBy("h").agg(F.sum("n").alias("n"), F.min("place").alias("place")).where(F.col("n") >= least), "frequent")


def filter_of(kept: DataFrame) -> Filter:
    """A filter over hashes (h), made in pieces by tasks; its size has a bound, whatever their number."""
    log = min(max((kept.count() * FILTER_BITS).bit_length(), PIECE), FILTER_MOST)
    slot = F.shiftrightunsigned("h", 64 - log)

    def piece(table: pa.Table) -> pa.Table:
        flags = np.zeros(1 << PIECE, dtype=bool)
        flags[table.column("bit").to_numpy()] = True
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([np.packbits(flags, bitorder="little").tobytes()], pa.binary())})

    bits = kept.select(F.shiftright(slot, PIECE).alias("at"), slot.bitwiseAND(F.lit((1 << PIECE) - 1)).cast("int").alias("bit")).distinct()
    return Filter(log, ((r.at, bytes(r.bits)) for r in bits.groupBy("at").applyInArrow(piece, "at long, bits binary").collect()))


class Grams:
    """All n-grams of a block of chunks, by hash of language and words."""

    def __init__(self, batch: pa.RecordBatch, low: int, high: int, blobs: list[bytes], lang_of: dict[str, int]):
        self.stream = stream = words(blobs[low:high], _TOKEN)
        size = np.diff(stream.bounds)
        self.row = np.repeat(np.arange(low, high), size)
        langs = batch.column(0).to_pylist()[low:high]
        lang = np.array([lang_of.setdefault(x, hash_of(x)) for x in langs], dtype=np.uint64)
        word = np.arange(len(self.row)) - np.repeat(stream.bounds[:-1], size)
        self.own = word < batch.column(2).to_numpy()[self.row]
        self.place = (batch.column(4).to_numpy()[self.row] << PLACE) + word
        self.weight = batch.column(3).to_numpy()[self.row]
        self.piece = np.cumsum(stream.buffer == 0x0A)[stream.start]
        self.word = stream.hashes()
        self.first = mix(self.word ^ lang[self.row - low])

    def candidates(self, longest: int, filters: list[Filter]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(k, positions, hashes) of n-grams of each length up to longest that own their first word, within a piece, and whose shorter parts pass."""
        h, n = self.first, len(self.word)
        passed = np.ones(n + 1, dtype=bool)
        for k in range(1, longest + 1):
            if k > 1:
                h = mix(h[:-1] * _MANY + self.word[k - 1 :]) if len(h) > 1 else h[:0]
            whole = passed[:-1] & passed[1:]
            if k > 1 and len(h):
                whole &= self.piece[: len(h)] == self.piece[k - 1 :]
            at = np.flatnonzero(whole & self.own[: len(h)])
            yield k, at, h[at]
            if k < longest:
                passed = whole.copy()
                some = np.flatnonzero(whole)
                passed[some] = filters[k - 1].has(h[some])
            if not len(h):
                return


def hash_of(lang: str) -> int:
    return xxhash.xxh64_intdigest(lang)


def summed(h: np.ndarray, n: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of equal hashes one, with the sum of n and the least place."""
    order = np.argsort(h, kind="stable")
    h, n, place = h[order], n[order], place[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    return (h[at], np.add.reduceat(n, at), np.minimum.reduceat(place, at)) if len(at) else (h, n, place)


def _hashed(k: int, filters):
    """Rows (h, n, place) of the n-grams of length k of rows (lang, chunk, owned, n, id), added up within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs: dict[str, int] = {}
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def merged():
            held[:] = [summed(*(np.concatenate([x[i] for x in held]) for i in (0, 1, 2)))]
            return len(held[0][0])

        def out():
            h, n, place = held.pop()
            return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n), pa.array(place)], names=["h", "n", "place"])

        for batch in batches:
            blobs = as_bytes(batch.column(1))
            for low, high in blocks(blobs, BLOCK):
                grams = Grams(batch, low, high, blobs, langs)
                for at_k, at, h in grams.candidates(k, filters.value):
                    if at_k == k and len(at):
                        held.append(summed(h, grams.weight[at], grams.place[at]))
                if sum(len(x[0]) for x in held) > ENTRIES and merged() > ENTRIES // 2:
                    yield out()
        if held:
            merged()
            yield out()

    return run


def dictionary(docs: DataFrame, longest: int) -> DataFrame:
    """Distinct chunks (lang, chunk, owned) of rows (lang, text), how often each occurs (n), and their ids; written."""
    parsed = bounded(docs).mapInArrow(_parsed(longest - 1), "lang string, chunk string, owned int, n long")
    return stored(parsed.groupBy("lang", "chunk", "owned").agg(F.sum("n").alias("n")).withColumn("id", F.monotonically_increasing_id()), "chunks")


def frequent_phrases(chunked: DataFrame, longest: int, least: int) -> DataFrame:
    """Rows (lang, k, phrase, f) of all phrases of up to longest words that occur at least so often; written."""
    spark, filters, tables = chunked.sparkSession, [], []
    for k in range(1, longest + 1):
        known = spark.sparkContext.broadcast(filters)
        tables.append(frequent(chunked.mapInArrow(_hashed(k, known), "h long, n long, place long"), least))
        known.destroy()
        if k < longest:
            filters = [*filters, filter_of(tables[-1])]
    found = tables[0].withColumn("k", F.lit(1))
    for k, more in enumerate(tables[1:], 2):
        found = found.unionByName(more.withColumn("k", F.lit(k)))
    asked = found.select(F.shiftright("place", PLACE).alias("id"), F.col("place").bitwiseAND(F.lit((1 << PLACE) - 1)).cast("int").alias("word"), "k", F.col("n").alias("f"))
    own = F.filter(F.split(F.translate("chunk", "\n", " "), " "), lambda w: w != "")
    phrases = chunked.select("id", "lang", "chunk").join(listed(asked), "id").select("lang", "k", F.array_join(F.slice(own, F.col("word") + 1, F.col("k")), " ").alias("phrase"), "f")
    phrases = stored(phrases, "phrases")
    discard(*tables)
    return phrases


def collocations(docs: DataFrame, longest: int = 4, least: int = 30, cover: int = 80, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    """Rows (lang, rank, phrase, a, l, r, n, score): the first ``top`` phrases of each language.

    Texts are lower-cased (A-Z) and cut at ``[.,;:!?]`` and line ends; words are runs without spaces and tabs. n counts all words
    of a language (null: ``und``), a the occurrences of a phrase of 2 to longest words, at least ``least``, within such
    pieces, overlaps included. Of its cuts in two (l and r their counts), that with the least score
    floor(2000000 * a / (l + r)) counts, of equal ones the first. A phrase that lies in a longer one with cover percent of
    its occurrences or more goes. Order: score and a descending, phrase; ties can't remain. Null and empty texts have no
    words; repeated rows count again; a language without such phrases, or an empty table, gives no rows; other columns
    are not read. N-grams count as equal where their 64-bit hashes are.
    """
    rows = docs.select(F.coalesce(F.col(lang), F.lit("und")).alias("lang"), F.col(text).alias("text"))
    chunked = dictionary(rows, longest)
    totals = stored(chunked.groupBy("lang").agg(F.sum(F.col("n") * F.col("owned")).alias("total")), "totals")
    known = frequent_phrases(chunked, longest, least)
    discard(chunked)
    parts = listed(known.select("lang", "phrase", "f"), KNOWN)
    split = F.split("phrase", " ")
    longer = known.where("k > 1").select("lang", "phrase", F.col("f").alias("a"), "k", split.alias("words"))

    def part(first, size):
        return F.array_join(F.slice("words", first, size), " ")

    cut = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1))).select("lang", "phrase", "a", "cut", part(F.lit(1), F.col("cut")).alias("_left"), part(F.col("cut") + 1, F.col("k") - F.col("cut")).alias("_right"))
    for side, count in (("_left", "l"), ("_right", "r")):
        cut = cut.join(parts.select("lang", F.col("phrase").alias(side), F.col("f").alias(count)), ["lang", side])
    score = F.expr("cast(cast(2000000 AS decimal(7,0)) * cast(a AS decimal(18,0)) div cast(l + r AS decimal(19,0)) AS long)")
    best = cut.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("best"))

    sizes = longer.where("k > 2").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = sizes.withColumn("first", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    within = inner.groupBy("lang", part(F.col("first"), F.col("size")).alias("phrase")).agg(F.max("a").alias("_longer"))
    kept = best.join(within, ["lang", "phrase"], "left").where(F.col("_longer").isNull() | (100 * F.col("_longer") < cover * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("best.score"), F.desc("a"), "phrase")
    first = kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return first.join(listed(totals), "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "best.l", "best.r", F.col("total").alias("n"), "best.score")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
