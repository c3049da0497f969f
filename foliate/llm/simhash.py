"""SimHash near duplicates: fingerprints of word shingles, compared exactly in tiles.

Distinct fingerprints are dealt to tiles by the population counts of their parts, and a tile of many to several of bounded size.
Counts of two fingerprints differ by no more than the fingerprints do, part by part and in sum, so only
tiles whose counts lie within the radius are paired; within a pair all fingerprints are compared by exclusive or and bit counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm.graph import components
from foliate.llm.shared import as_bytes, bounded, discard, listed, stored

#: Fingerprints of a tile, about.
TILE = 4096
#: Distinct fingerprints up to which they are cut into so many parts; more parts make more, smaller tiles, and more pairs of them.
PARTS = ((4_000_000, 4), (1_000_000_000, 8), (None, 16))
#: Shingles whose bits are counted at a time, and comparisons made at a time.
AT_ONCE, COMPARED = 1 << 16, 1 << 20
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def fingerprint(blob: bytes, width: int = 3, seed: int = 42) -> int:
    """64 bits, each set where it is in over half the XXH64 hashes of the text's word shingles; zero without words."""
    words = blob.translate(_LOWER).split()
    if not words:
        return 0
    width = min(width, len(words))
    total, n = np.zeros(64, dtype=np.int64), len(words) - width + 1
    hashed = xxhash.xxh64_intdigest
    for low in range(0, n, AT_ONCE):
        part = words[low : min(n, low + AT_ONCE) + width - 1]
        made = np.array([hashed(b" ".join(t), seed) for t in zip(*(part[i:] for i in range(width)), strict=False)], dtype=np.uint64)
        total += np.unpackbits(made.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > n).tobytes(), "big")


def _signed(width: int, seed: int):
    """Rows (id, fp) of rows (id, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(b, width, seed) for b in as_bytes(batch.column(1))], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    return run


def field(parts: int) -> int:
    """Bits that hold the population count of a part: one more value than counts have on either side, so that steps
    beyond the counts give no other tile's number."""
    return {4: 5, 8: 4, 16: 3}[parts]


def steps(parts: int, radius: int) -> list[int]:
    """Differences of tile numbers within the radius, one of each and its opposite, zero among them."""

    def of(left: int, most: int) -> Iterator[tuple[int, ...]]:
        if not left:
            yield ()
            return
        for d in range(-most, most + 1):
            for rest in of(left - 1, most - abs(d)):
                yield (d, *rest)

    numbers = (sum(d << (field(parts) * i) for i, d in enumerate(ds)) for ds in of(parts, radius))
    return sorted({n for n in numbers if n >= 0})


def spanning(a: np.ndarray, b: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges (of a, of b) that tie all that links within the radius between two tiles; each fingerprint with itself doesn't."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    edges, rows = [], max(1, COMPARED // max(1, len(b)))
    for low in range(0, len(a), rows):
        i, j = np.nonzero(np.bitwise_count(a[low : low + rows, None] ^ b[None, :]) <= radius)
        for x, y in zip(a[low + i].view(np.int64).tolist(), b[j].view(np.int64).tolist(), strict=True):
            if x != y and (p := root(x)) != (q := root(y)):
                up[max(p, q)] = min(p, q)
                edges.append((x, y))
    return edges


def _compared(radius: int):
    """Rows (a, b), edges, of rows (left, right), the fingerprints of two tiles."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sides = []
            for c in (0, 1):
                at, flat = batch.column(c).offsets.to_numpy(), batch.column(c).values.to_numpy().view(np.uint64)
                sides.append([flat[at[i] : at[i + 1]] for i in range(batch.num_rows)])
            edges = [e for a, b in zip(*sides, strict=True) for e in spanning(a, b, radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[i] for e in edges], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return run


def linked(prints: DataFrame, radius: int, parts: int) -> DataFrame:
    """Edges (a, b) that tie the distinct fingerprints (fp) which differ in at most radius bits."""
    width, bits = 64 // parts, field(parts)
    count = sum((F.bit_count(F.shiftrightunsigned("fp", width * i).bitwiseAND(F.lit((1 << width) - 1))).cast("long") * F.lit(1 << (bits * i)) for i in range(parts)), F.lit(0).cast("long"))
    counted = prints.select("fp", count.alias("tile"))
    several = stored(counted.groupBy("tile").agg(F.ceil(F.count("*") / TILE).cast("int").alias("slots")).where("slots > 1"), "several")
    few = listed(several)
    slots = F.coalesce("slots", F.lit(1))
    dealt = counted.join(few, "tile", "left").select("fp", "tile", F.pmod(F.xxhash64("fp"), slots).cast("int").alias("slot"))
    tiles = stored(dealt.groupBy("tile", "slot").agg(F.collect_list("fp").alias("fps")), "tiles")
    around = tiles.select(F.col("fps").alias("left"), F.col("slot").alias("_slot"), F.explode(F.array(*map(F.lit, steps(parts, radius)))).alias("_step"), (F.col("tile") + F.col("_step")).alias("tile"))
    first = F.when(F.col("_step") == 0, F.col("_slot")).otherwise(0)
    asked = around.join(few, "tile", "left").select("left", "tile", F.explode(F.sequence(first, slots - 1)).alias("slot"))
    pairs = asked.join(tiles, ["tile", "slot"]).select("left", F.col("fps").alias("right"))
    edges = stored(pairs.mapInArrow(_compared(radius), "a long, b long"), "near")
    discard(several, tiles)
    return edges


def simhash_groups(docs: DataFrame, width: int = 5, radius: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text", parts: int | None = None) -> DataFrame:
    """Rows (id, fp, component_id), one for each row of docs.

    fp is the 64-bit fingerprint (a signed long) of the text's shingles of so many words, repeats included: words are runs
    without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, a null, empty or blank one has
    fingerprint zero, which links as any other. Fingerprints link at radius or fewer differing bits, equal ones always; component_id is the least
    id that links reach, the row's own among them, null only where no row reached has an id. Rows repeat as they are given,
    equal ids or not; an empty table gives no rows; other columns are not read. ``parts`` follows the number of
    distinct fingerprints by default.
    """
    told = stored(bounded(docs).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(_signed(width, seed), "id long, fp long"), "prints")
    classes = stored(told.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "classes")
    total = classes.count()
    edges = linked(classes, radius, parts or next(p for most, p in PARTS if most is None or total <= most))
    found = components(edges).select(F.col("node").alias("fp"), "root")
    known = classes.join(found, "fp", "left").where("root IS NOT NULL OR copies > 1").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = stored(known, "known")
    lowest = known.groupBy("root").agg(F.min("least").alias("first"))
    of_print = stored(known.join(lowest, "root").select("fp", "first"), "components")
    discard(classes, known, edges)
    return told.join(listed(of_print), "fp", "left").select("id", "fp", F.coalesce("first", "id").alias("component_id"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=3, radius=2)
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
