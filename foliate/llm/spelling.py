"""Spelling variants of a corpus's words: a trie as a table of edges, walked level by level by all words at once.

Words are written into two tries, one from their first letter on and one from their last. A node stands where words part or end,
and an edge carries the letters up to the next node. Each word leaves its own path by one edit: another letter, or one
letter less (one letter more is the same pair from the other word). Edits in the second half of a word are made in the forward trie, those
in the first half in the backward one, where its half without edits leads to nodes that few words share. From there on states (word,
position, node, edits) are joined with the edges until none is left; those that end with their word are neighbours.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.shared import bounded, discard, listed, stored

RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: Words that a task adds up before it passes their counts on.
HELD = 200_000


def _as_written(key, run: str) -> str:
    return run


def dropped_letter(key, run: str, one_in: int = 199) -> str:
    """The run without the letter that the checksum of its document's id and itself picks, where ``one_in`` divides that."""
    h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
    if h % one_in:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def _counted(least_length: int, spelled):
    """Rows (word, n) of rows (id, text), added up within the task."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            rows = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
            held.clear()
            return rows

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for found, n in Counter(RUN.findall((text or "").translate(_LOWER))).items():
                    if len(found) >= least_length and len(word := spelled(key, found)) >= least_length:
                        held[word] += n
                if len(held) > HELD:
                    yield out()
        yield out()

    return run


def word_counts(docs: DataFrame, least_length: int = 6, least: int = 5, key: str = "doc_id", text: str = "text", spelled=_as_written) -> DataFrame:
    """Rows (word, n): words of at least so many letters that occur at least so often in all texts."""
    counted = bounded(docs).select(F.col(key), F.col(text)).mapInArrow(_counted(least_length, spelled), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def trie(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges and branches of both tries of distinct words.

    Edges (way, node, first, label, child, whole): from node (the hash of the letters before it) over the letters of label to child; whole where a
    word ends there. Branches (way, spelt, at, node): nodes on the own path of each word (spelt: in the way's direction), after
    its first half, where other edges leave. Letters alone tell nodes apart; that hashes may be equal makes more states, not less.
    """
    ways = words.select(F.explode(F.array(F.struct(F.lit(0).alias("way"), F.col("word").alias("spelt")), F.struct(F.lit(1).alias("way"), F.reverse("word").alias("spelt")))).alias("w")).select("w.*")
    size = F.length("spelt")
    places = ways.select("way", "spelt", size.alias("size"), F.posexplode(F.transform(F.sequence(F.lit(0), size), lambda p: F.substring("spelt", F.lit(1), p))).alias("at", "prefix"))
    places = places.select("way", "spelt", "size", "at", F.xxhash64("prefix").alias("node"), F.substring("spelt", F.col("at") + 1, F.lit(1)).alias("first"))
    nodes = places.groupBy("way", "node").agg(F.count_distinct("first").alias("ways_on"), F.bool_or(F.col("first") == "").alias("whole"))
    nodes = stored(nodes.where("ways_on > 1 OR whole"), "nodes")
    # the root is a node of its own path although words may share a first letter
    on_path = places.join(listed(nodes), ["way", "node"], "left").where("ways_on IS NOT NULL OR at = 0")
    on_path = stored(on_path.select("way", "spelt", "size", "at", "node", "first", F.coalesce("ways_on", F.lit(1)).alias("ways_on"), F.coalesce("whole", F.lit(False)).alias("whole")), "paths")
    following = Window.partitionBy("way", "spelt").orderBy("at")
    steps = on_path.select("way", "spelt", "at", "node", "first", F.lead("at").over(following).alias("to"), F.lead("node").over(following).alias("child"), F.lead("whole").over(following).alias("whole"))
    label = F.substring("spelt", F.col("at") + 1, F.col("to") - F.col("at"))
    edges = steps.where("to IS NOT NULL").select("way", "node", "first", label.alias("label"), "child", "whole").dropDuplicates(["way", "node", "first"])
    edges = stored(edges, "trie")
    half = F.when(F.col("way") == 0, F.floor(F.col("size") / 2)).otherwise(F.col("size") - F.floor(F.col("size") / 2))
    branches = stored(on_path.where((F.col("at") >= half) & (F.col("at") < F.col("size")) & ((F.col("ways_on") > 1) | F.col("whole"))).select("way", "spelt", "at", "node", "whole"), "branches")
    discard(nodes, on_path)
    return edges, branches


def near_words(words: DataFrame) -> DataFrame:
    """Pairs (word, near), both ways round, of the distinct words (word) that one inserted, deleted or replaced letter tells apart.

    Nothing is as long as all pairs; words of any length and any number of shared beginnings take part. A frontier is written
    before the next is made; there are as many as nodes behind the edits on the longest path.
    """
    edges, branches = trie(words)
    rest = F.substring("spelt", F.col("at") + 2, F.length("spelt"))
    own, after = F.substring("spelt", F.col("at") + 1, F.lit(1)), F.substring("spelt", F.col("at") + 2, F.lit(1))
    # one letter less at the end: the node is the neighbour itself
    shorter = branches.where((F.col("at") == F.length("spelt") - 1) & F.col("whole")).select("way", "spelt", F.expr("substring(spelt, 1, at)").alias("near"))
    met = branches.drop("whole").join(edges, ["way", "node"]).where(F.col("first") != own)
    replaced = met.where(F.expr("substring(label, 2) = substring(spelt, at + 2, length(label) - 1) AND at + length(label) <= length(spelt)")).select(
        "way", "spelt", (F.col("at") + F.length("label")).alias("at"), F.concat(F.expr("substring(spelt, 1, at)"), "first", rest).alias("near"), "child", "whole"
    )
    less = met.where((F.col("first") == after) & F.expr("label = substring(spelt, at + 2, length(label))")).select(
        "way", "spelt", (F.col("at") + 1 + F.length("label")).alias("at"), F.concat(F.expr("substring(spelt, 1, at)"), rest).alias("near"), "child", "whole"
    )
    states, found, kept = stored(replaced.unionByName(less), "states"), [shorter], []
    while True:
        kept.append(states)
        ended = F.col("at") == F.length("spelt")
        found.append(states.where(ended & F.col("whole")).select("way", "spelt", "near"))
        going = states.where(~ended).select("way", "spelt", "at", "near", F.col("child").alias("node"), F.substring("spelt", F.col("at") + 1, F.lit(1)).alias("first"))
        going = going.join(edges, ["way", "node", "first"]).where(F.expr("label = substring(spelt, at + 1, length(label))"))
        states = stored(going.select("way", "spelt", (F.col("at") + F.length("label")).alias("at"), "near", "child", "whole"), "states")
        if states.isEmpty():
            break
    kept.append(states)
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    forward = [F.when(F.col("way") == 0, F.col(c)).otherwise(F.reverse(c)).alias(c) for c in ("spelt", "near")]
    both = F.explode(F.array(F.struct(F.col("spelt").alias("word"), F.col("near").alias("near")), F.struct(F.col("near").alias("word"), F.col("spelt").alias("near"))))
    near = stored(pairs.select(*forward).select(both.alias("p")).select("p.*").distinct(), "neighbours")
    discard(edges, branches, *kept)
    return near


def variants(counts: DataFrame, times: int = 5) -> DataFrame:
    """Rows (word, form, root, n, n_near, form_n), one for each row (word, n) of distinct words.

    n_near counts the words one edit away; form is that of them with the largest n (of equal ones the least by code points), null where
    its n is below ``times`` the word's; root is where forms lead from the word, itself without a form. Rows
    without a word don't count. An empty table gives no rows.
    """
    counts = stored(counts.where("word IS NOT NULL").select("word", "n"), "words")
    near = near_words(counts)
    best = near.join(counts.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
    fits = -F.col("best.less") >= times * F.col("n")
    known = counts.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(fits, F.col("best.near")).alias("form"), F.when(fits, -F.col("best.less")).alias("form_n"))
    known = stored(known, "forms")
    # each round doubles the steps; counts grow with each, so that no circle can be and few rounds are needed
    root = stored(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = root.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        further = stored(root.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        moved = not further.where("_moved").isEmpty()
        discard(root)
        root = further.drop("_moved")
        root.stored_at = further.stored_at
        if not moved:
            break
    return known.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_groups(docs: DataFrame, least_length: int = 6, least: int = 5, times: int = 5, key: str = "doc_id", text: str = "text", spelled=_as_written) -> DataFrame:
    """Rows of variants() over the words of all texts: runs of the letters A to Z and U+00C0 to U+00FF, A-Z lower-cased.

    ``spelled(key, run)`` gives a run's spelling in its document. Null and empty texts have no words; repeated rows count again; a null
    key is written as nothing; other columns are not read.
    """
    return variants(word_counts(docs, least_length, least, key, text, spelled), times)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), spelled=dropped_letter)
