"""Language identification by a linear-chain conditional random field over words.

A word's features are hashed: its leading and trailing 1 to 4 bytes, its byte trigrams, the
word itself, and the languages whose lexicon has it. A text is one sequence. Forward-backward
goes through it in two levels: runs of RUN words become matrices from first to last label, which
carry what lies before and behind to each run, and within the runs all advance together; that is
exact, as matrix products are associative. Weights and transitions are learned together by
Adagrad on the conditional log-likelihood, on runs spliced from texts of several languages so
that transitions are seen.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliate.llm.shared import as_bytes, blocks, bounded, byte_class, listed, mix, words

BUCKETS, RUN, AFFIXES = 1 << 16, 32, (1, 2, 3, 4)
#: Texts of each language that training takes at most, and the longest among them in bytes.
SAMPLE, LONGEST = 300, 32 << 10
#: Words of a lexicon are in so many sampled texts of its language, and so rarely in others.
LEXICON_TEXTS, LEXICON_SHARE = 4, 0.9
#: Letters are ASCII letters and all bytes beyond ASCII.
LETTERS = byte_class((0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF))


def word_features(stream, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the chosen words, flat, with the bounds of each word's."""
    start, end = stream.start[chosen], stream.end[chosen]
    size = end - start
    rows, cols = [], []
    at = np.arange(len(chosen))

    def add(which: np.ndarray, hashed: np.ndarray, kind: int) -> None:
        rows.append(which)
        cols.append((mix(hashed + np.uint64(kind * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(BUCKETS)).astype(np.int64))

    add(at, stream.hashes(start, end), 1)
    for n in AFFIXES:
        long = size >= n
        add(at[long], stream.hashes(start[long], start[long] + n), 10 + n)
        add(at[long], stream.hashes(end[long] - n, end[long]), 20 + n)
    grams = np.maximum(size - 2, 0)
    which = np.repeat(at, grams)
    offset = np.arange(grams.sum()) - np.repeat(np.cumsum(grams) - grams, grams)
    begin = start[which] + offset
    add(which, stream.hashes(begin, begin + 3), 3)
    row, col = np.concatenate(rows), np.concatenate(cols)
    order = np.argsort(row, kind="stable")
    bounds = np.zeros(len(chosen) + 1, dtype=np.int64)
    np.cumsum(np.bincount(row, minlength=len(chosen)), out=bounds[1:])
    return col[order], bounds


@dataclass
class Crf:
    langs: list[str]
    weights: np.ndarray  # BUCKETS, languages
    lexicon: dict[int, int]  # word hash to language
    lexicon_weights: np.ndarray  # languages of a lexicon, languages
    transitions: np.ndarray
    start: np.ndarray

    def word_scores(self, stream, hashes: np.ndarray) -> np.ndarray:
        """Emission scores of all words; each distinct word is computed once."""
        distinct, chosen, back = np.unique(hashes, return_index=True, return_inverse=True)
        col, bounds = word_features(stream, chosen)
        flat = self.weights[col]
        scores = np.add.reduceat(flat, bounds[:-1], axis=0) if len(chosen) else flat[:0]
        scores += self.lexicon_weights[self.entries(distinct)]
        return scores[back]

    def entries(self, hashes: np.ndarray) -> np.ndarray:
        """The lexicon of each word, the number of languages where it is in none."""
        keys, values = self._sorted()
        if not len(keys):
            return np.full(len(hashes), len(self.langs))
        at = np.searchsorted(keys, hashes).clip(max=len(keys) - 1)
        return np.where(keys[at] == hashes, values[at], len(self.langs))

    def _sorted(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_table"):
            keys = np.array(sorted(self.lexicon), dtype=np.uint64)
            self._table = keys, np.array([self.lexicon[int(k)] for k in keys], dtype=np.int64)
        return self._table


def runs(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of each run: texts are cut into equal ones of at most RUN words."""
    size = np.diff(bounds)
    pieces = -(-size // RUN)
    doc = np.repeat(np.arange(len(size)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = bounds[doc] + number * size[doc] // np.maximum(pieces[doc], 1)
    stop = bounds[doc] + (number + 1) * size[doc] // np.maximum(pieces[doc], 1)
    return begin, stop - begin, doc


def posteriors(scores: np.ndarray, bounds: np.ndarray, transitions: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Label probabilities of each word of whole texts (text i has the words bounds[i]:bounds[i + 1])."""
    begin, length, doc = runs(bounds)
    if not len(begin):
        return np.zeros_like(scores, dtype=np.float64)
    shift, k = np.exp(transitions), scores.shape[1]
    emitted = np.exp(scores - scores.max(axis=1, keepdims=True))
    # of each run: weights from its first to its last label
    through = np.eye(k)[None] * emitted[begin][:, :, None]
    for t in range(1, int(length.max())):
        live = np.flatnonzero(length > t)
        moved = (through[live] @ shift) * emitted[begin[live] + t][:, None, :]
        through[live] = moved / np.maximum(moved.sum(axis=(1, 2), keepdims=True), 1e-300)
    first = np.searchsorted(doc, np.unique(doc))
    count = np.diff(np.append(first, len(doc)))
    scaled = lambda v: v / np.maximum(v.sum(axis=1, keepdims=True), 1e-300)
    before, behind = np.tile(np.exp(start), (len(doc), 1)), np.ones((len(doc), k))
    for i in range(1, int(count.max())):
        at = first[count > i] + i
        before[at] = scaled(np.einsum("na,nab->nb", before[at - 1], through[at - 1]) @ shift)
        at = (first + count)[count > i] - 1 - i
        behind[at] = scaled(np.einsum("nab,nb->na", through[at + 1], behind[at + 1]) @ shift.T)
    return forward_backward(scores, begin, length, transitions, start, entry=before, exit_=behind)


def forward_backward(scores: np.ndarray, begin: np.ndarray, length: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False, entry: np.ndarray | None = None, exit_: np.ndarray | None = None):
    """Label probabilities of each word; with pairs also expected transition counts, first-label
    probabilities and the log-partition of each sequence. All sequences advance together. entry
    and exit_: weights of each one's first label by what lies before it, and of its last by what
    lies behind it."""
    n, k = len(begin), scores.shape[1]
    steps = int(length.max()) if n else 0
    shift = np.exp(transitions)
    top = scores.max(axis=1, keepdims=True) if len(scores) else scores[:, :1]
    emitted = np.exp(scores - top)
    index = np.minimum(begin[None, :] + np.arange(steps)[:, None], max(len(scores) - 1, 0))
    live = np.arange(steps)[:, None] < length[None, :]
    alpha = np.zeros((steps, n, k))
    log_z = np.zeros(n)
    for t in range(steps):
        now = ((np.exp(start)[None] if entry is None else entry) if t == 0 else alpha[t - 1] @ shift) * emitted[index[t]]
        total = now.sum(axis=1, keepdims=True)
        alpha[t] = now / np.maximum(total, 1e-300)
        log_z += np.where(live[t], np.log(np.maximum(total[:, 0], 1e-300)) + top[index[t], 0], 0) if pairs else 0
    out = np.zeros_like(scores, dtype=np.float64)
    last = np.ones((n, k)) if exit_ is None else exit_
    beta = last
    counts = np.zeros((k, k))
    for t in range(steps - 1, -1, -1):
        post = alpha[t] * beta
        post /= np.maximum(post.sum(axis=1, keepdims=True), 1e-300)
        rows = live[t]
        out[index[t, rows]] = post[rows]
        if t:
            onward = emitted[index[t]] * beta
            if pairs:
                joint = alpha[t - 1][:, :, None] * shift[None] * onward[:, None, :]
                joint /= np.maximum(joint.sum(axis=(1, 2), keepdims=True), 1e-300)
                counts += joint[rows].sum(axis=0)
            back = onward @ shift.T
            back /= np.maximum(back.sum(axis=1, keepdims=True), 1e-300)
            beta = np.where(rows[:, None], back, last)
    return (out, counts, log_z) if pairs else out


def train(texts: list[tuple[bytes, str]], epochs: int = 4, rate: float = 0.3, decay: float = 1e-3, switch: float = 0.15, seed: int = 5) -> Crf:
    """Learns from texts with one language each. A share ``switch`` of the sequences' places splices in words of another text."""
    rng = np.random.default_rng(seed)
    langs = sorted({lang for _, lang in texts})
    k = len(langs)
    if not k:
        return Crf([], np.zeros((BUCKETS, 0)), {}, np.zeros((1, 0)), np.zeros((0, 0)), np.zeros(0))
    stream = words([t for t, _ in texts], LETTERS)
    hashes, bounds = stream.hashes(), stream.bounds
    label_of = np.array([langs.index(lang) for _, lang in texts], dtype=np.int64)
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds))
    pair = np.unique(np.stack([hashes, doc.astype(np.uint64)]), axis=1)
    entry, back = np.unique(pair[0], return_inverse=True)
    seen = np.zeros((len(entry), k))
    np.add.at(seen, (back, label_of[pair[1].astype(np.int64)]), 1)
    scale = np.bincount(label_of, minlength=k).clip(min=1)
    share = seen / scale
    share /= share.sum(axis=1, keepdims=True).clip(min=1e-12)
    picked = (seen.sum(axis=1) >= LEXICON_TEXTS) & (share.max(axis=1) >= LEXICON_SHARE)
    lexicon = {int(h): int(s) for h, s in zip(entry[picked], share[picked].argmax(axis=1), strict=True)}
    crf = Crf(langs, np.zeros((BUCKETS, k)), lexicon, np.zeros((k + 1, k)), np.zeros((k, k)), np.zeros(k))
    if not len(hashes):
        return crf
    distinct, chosen, word = np.unique(hashes, return_index=True, return_inverse=True)
    col, own = word_features(stream, chosen)
    lex = crf.entries(distinct)
    begin, length, text = runs(bounds)
    sums = {name: np.full_like(getattr(crf, name), 1e-2) for name in ("weights", "lexicon_weights", "transitions", "start")}
    for _ in range(epochs):
        order = rng.permutation(len(begin))
        other = rng.permutation(len(begin))
        for low in range(0, len(order), 256):
            ids, labels = [], []
            for a, b in zip(order[low : low + 256], other[low : low + 256], strict=True):
                w = word[begin[a] : begin[a] + length[a]]
                y = np.full(len(w), label_of[text[a]])
                if rng.random() < switch:
                    v = word[begin[b] : begin[b] + length[b]]
                    cut = rng.integers(0, len(w) + 1)
                    w, y = np.concatenate([w[:cut], v]), np.concatenate([y[:cut], np.full(len(v), label_of[text[b]])])
                ids.append(w), labels.append(y)
            size = np.array([len(w) for w in ids])
            w, y, at = np.concatenate(ids), np.concatenate(labels), np.concatenate([[0], np.cumsum(size)])
            used, inner = np.unique(w, return_inverse=True)
            spans = own[used + 1] - own[used]
            flat = np.repeat(own[used] - np.concatenate([[0], np.cumsum(spans)[:-1]]), spans) + np.arange(spans.sum())
            feature, which = col[flat], np.repeat(np.arange(len(used)), spans)
            emit = np.zeros((len(used), k))
            np.add.at(emit, which, crf.weights[feature])
            emit += crf.lexicon_weights[lex[used]]
            post, counts, _ = forward_backward(emit[inner], at[:-1], size, crf.transitions, crf.start, pairs=True)
            wrong = post
            wrong[np.arange(len(y)), y] -= 1
            per_word = np.zeros((len(used), k))
            np.add.at(per_word, inner, wrong)
            pairs = np.ones(len(y), dtype=bool)
            pairs[at[:-1]] = False
            later = np.flatnonzero(pairs)
            np.add.at(counts, (y[later - 1], y[later]), -1)
            touched, place = np.unique(feature, return_inverse=True)
            g = np.zeros((len(touched), k))
            np.add.at(g, place, per_word[which])
            lexical = np.zeros_like(crf.lexicon_weights)
            np.add.at(lexical, lex[used], per_word)
            n = len(size)
            for name, grad, rows in (("weights", g / n, touched), ("lexicon_weights", lexical / n, slice(None)), ("transitions", counts / n, slice(None)), ("start", wrong[at[:-1]].sum(axis=0) / n, slice(None))):
                value, total = getattr(crf, name), sums[name]
                grad = grad + decay * value[rows]
                total[rows] += grad**2
                value[rows] -= rate * grad / np.sqrt(total[rows])
    return crf


def held_out(key: str) -> Column:
    """Rows that nothing is learned from: crc32 of the key as text is divisible by 5."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit(""))) % 5 == 0


def learn(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = SAMPLE) -> Crf:
    """The field learned from at most ``sample`` texts of each language that are not held out: those with
    the least hashes of key and text, among texts of at most LONGEST bytes that have a language.

    Of each language some four times as many rows are first chosen by their hashes alone, so that no task
    sorts a whole language. Repeated rows count once.
    """
    known = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(key).isNotNull() & ~held_out(key) & (F.octet_length(text) <= LONGEST))
    known = known.select(F.col(lang).alias("lang"), F.col(text).alias("text"), F.xxhash64(key, text).alias("h"))
    sizes = listed(known.groupBy("lang").agg(F.count("*").alias("rows")))
    spread = F.pmod(F.col("h"), F.lit(1 << 31)) / float(1 << 31)
    few = known.select("lang", "h").join(sizes, "lang").where(spread * F.col("rows") < 4 * sample).select("lang", "h").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = few.withColumn("place", place).where(F.col("place") <= sample).select("lang", "h")
    rows = known.join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).collect()
    return train([(r.text.encode(), r.lang) for r in sorted(rows, key=lambda r: (r.lang, r.h))])


def _lettered(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, lang_pred, score, mix): the language with the greatest mean probability over a text's words,
    that mean, and the mean of each language. Texts that are null or without a letter give und, 0 and no
    mix; equal texts have equal results, repeated rows are kept; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast(crf)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            blobs, out = as_bytes(batch.column(1)), []
            for low, high in blocks(blobs):
                for blob, mean in zip(blobs[low:high], label_means(crf, blobs[low:high]), strict=True):
                    if mean is None or not _lettered(blob.decode()):
                        out.append(("und", 0.0, []))
                    else:
                        best = int(mean.argmax())
                        out.append((crf.langs[best], float(mean[best]), mean.tolist()))
            columns = list(zip(*out, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.string()), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.list_(pa.float64()))], names=["key", "lang_pred", "score", "mix"])

    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, lang_pred string, score double, mix array<double>")
    return made.withColumnRenamed("key", key)


def word_labels(docs: DataFrame, crf: Crf, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, spans): the runs of words with the same most likely language, as structs (start, end, lang,
    probability: the mean over the run's words), in code points, end exclusive.

    A null text, one without words, and any text where nothing was learned have no spans; repeated rows are
    kept; an empty table gives no rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(crf)
    kinds = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("lang", pa.string()), ("probability", pa.float64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        for batch in batches:
            blobs, out = as_bytes(batch.column(1)), []
            for low, high in blocks(blobs):
                out += spans(crf, blobs[low:high])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kinds)], names=["key", "spans"])

    rows = bounded(docs).select(F.col(key).alias("key"), F.col(text).alias("text"))
    made = rows.mapInArrow(run, f"key {rows.schema['key'].dataType.simpleString()}, spans array<struct<start: bigint, end: bigint, lang: string, probability: double>>")
    return made.withColumnRenamed("key", key)


def _labelled(crf: Crf, blobs: list[bytes]):
    """The texts' words and their label probabilities."""
    stream = words(blobs, LETTERS)
    return stream, posteriors(crf.word_scores(stream, stream.hashes()), stream.bounds, crf.transitions, crf.start)


def spans(crf: Crf, blobs: list[bytes]) -> list[list[dict]]:
    """word_labels of texts."""
    if not crf.langs:
        return [[] for _ in blobs]
    stream, post = _labelled(crf, blobs)
    points = np.cumsum((stream.buffer & 0xC0) != 0x80)  # code points up to and with each byte
    best, out, begin = post.argmax(axis=1) if len(post) else [], [], 0
    for i, blob in enumerate(blobs):
        a, b = int(stream.bounds[i]), int(stream.bounds[i + 1])
        before = int(points[begin - 1]) if begin else 0
        edges = [a, *(np.flatnonzero(best[a + 1 : b] != best[a : b - 1]) + a + 1).tolist(), b] if b > a else []
        at = lambda byte: int(points[byte - 1]) - before if byte else 0  # noqa: B023, E731
        out.append([{"start": at(int(stream.start[x])), "end": at(int(stream.end[y - 1])), "lang": crf.langs[int(best[x])], "probability": float(post[x:y, best[x]].mean())} for x, y in zip(edges, edges[1:], strict=False)])
        begin += len(blob) + 1
    return out


def label_means(crf: Crf, blobs: list[bytes]) -> list[np.ndarray | None]:
    """Mean label probabilities of each text's words, None without words."""
    if not crf.langs:
        return [None] * len(blobs)
    stream, post = _labelled(crf, blobs)
    a, b = stream.bounds[:-1], stream.bounds[1:]
    # each text's probabilities are summed for itself, so that they don't depend on its neighbours
    means = np.add.reduceat(post, a[b > a], axis=0) / (b - a)[b > a][:, None] if len(post) else []
    found = iter(means)
    return [next(found) if y > x else None for x, y in zip(a, b, strict=True)]


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, learn(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")
