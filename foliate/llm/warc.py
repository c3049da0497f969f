"""Deterministic sharded WARC writer and its reader.

Records are ranged by key, sorted within a range and written to files that roll at a compressed
size. Each record is a gzip member of its own; identifiers, dates and digests come from the
record alone, so the same input gives the same bytes. A file appears under its name once it is
complete, and a manifest lists the files with their sizes and digests. Of records with equal
payloads the one with the least key is a response, the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliate.llm import ranges
from foliate.llm.files import Rolling, located
from foliate.llm.shared import bounded, shared_dir

#: Payload bytes of one range, about, and compressed bytes after which a file is closed.
RANGE_BYTES, FILE_BYTES = 32 << 20, 8 << 20
#: Payloads of at least this many bytes are stored once.
REVISIT_FROM = 0
#: Every record has this date, as the input has none.
DATE = "2024-01-01T00:00:00Z"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _uri(url: str | None) -> str:
    """The URL on one header line: control characters and spaces are percent-encoded."""
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")


def record(key: int | None, place: str, url: str | None, payload: bytes, digest: str, revisit: bool = False, refers_to: str | None = None) -> bytes:
    """One WARC/1.1 record as a gzip member. place tells rows with the same key apart. Null URLs leave the target out;
    refers_to is the identifier of the record that a revisit stands for."""
    body = b"" if revisit else b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload
    headers = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_identifier(key, place)}",
        f"WARC-Date: {DATE}",
        *([f"WARC-Target-URI: {_uri(url)}"] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}",
        *([f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {_PROFILE}"] if revisit else []),
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(headers).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + packer.flush()


def _identifier(key: int | None, place: str) -> str:
    return f"<urn:record:{'' if key is None else key}:{place}>"


def _key(identifier: str) -> int | None:
    part = identifier.split(":")[2]
    return int(part) if part else None


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of one unpacked record."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return headers, rest[: int(headers["content-length"])]


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """Unpacked gzip members of a file, read piece by piece."""
    unpacker, out, data = zlib.decompressobj(31), [], b""
    while True:
        if not data:
            data = stream.read(chunk)
            if not data:
                if out:
                    raise ValueError("the archive ends within a record")
                return
        out.append(unpacker.decompress(data))
        data = unpacker.unused_data
        if unpacker.eof:
            yield b"".join(out)
            unpacker, out = zlib.decompressobj(31), []


def write_warc(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", payload: str = "html", range_bytes: int = RANGE_BYTES, file_bytes: int = FILE_BYTES, revisit_from: int = REVISIT_FROM) -> None:
    """Writes one record per row below folder, and folder/manifest (file, records, bytes, sha256).

    A null payload is empty. Rows that share a key and payload count as copies, the first of them (by URL)
    is the response. Rows with a null key come first in the archives and last among copies: one of them is
    a response only where no copy has a key. Other columns are not read. An empty table gives an empty
    manifest. Two narrow shuffles find the first record of each repeated payload; payloads move once, to
    their range of about range_bytes; a key of many rows may go on in further ranges.
    """
    rows = bounded(pages).select(F.col(key).cast("long").alias("a"), F.col(url).alias("url"), F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload")).withColumn("b", F.xxhash64("payload"))
    found = ranges.cuts(rows, F.octet_length("payload") + 1, range_bytes)

    prints = rows.where(F.octet_length("payload") >= revisit_from).select("a", "b", F.unhex(F.sha1("payload")).alias("digest"))
    repeated = prints.groupBy("digest").agg(F.min("a").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL")
    known = prints.join(repeated, "digest").where("NOT a <=> first").select("a", "b", "first", "digest").distinct()

    none = F.lit(None)
    marks = known.select("a", "b", F.lit(0).alias("kind"), none.cast("string").alias("url"), F.col("digest").alias("payload"), "first")
    both = marks.unionByName(rows.select("a", "b", F.lit(1).alias("kind"), "url", "payload", none.cast("long").alias("first")))
    dealt = both.withColumn("range", ranges.number(F.col("a"), F.col("b"), found)).repartitionById(len(found) + 1, F.col("range")).sortWithinPartitions(F.col("a").asc_nulls_first(), "b", "kind", "payload", "url")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, part, count, sums = None, 0, 0, None
        now, first, here = None, {}, Counter()
        made: list[tuple] = []

        def close():
            out.commit()
            made.append((name, count, out.size, sums.hexdigest()))

        for batch in batches:
            for key, hashed, kind, url, payload, refers, area in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (key, hashed) != now:
                    now, first, here = (key, hashed), {}, Counter()
                if kind == 0:
                    first[payload] = refers
                    continue
                digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                to, again = first.get(hashlib.sha1(payload).digest()), here[digest]
                here[digest] += 1
                revisit = to is not None or (again > 0 and len(payload) >= revisit_from)
                packed = record(key, f"{digest}:{again}", url, payload, digest, revisit, _identifier(key if to is None else to, f"{digest}:0"))
                if out is not None and out.size + len(packed) > file_bytes and count:
                    close()
                    out, part = None, part + 1
                if out is None:
                    name = f"records-{area:06d}-{part:05d}.warc.gz"
                    out, count, sums = Rolling(folder, name), 0, hashlib.sha256()
                out.write(packed)
                sums.update(packed)
                count += 1
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["file", "records", "bytes", "sha256"])

    dealt.select("a", "b", "kind", "url", "payload", "first", "range").mapInArrow(write, "file string, records long, bytes long, sha256 string").write.parquet(f"{folder}/manifest")


def read_warc(spark: SparkSession, folder: str, payloads: bool = False) -> DataFrame:
    """One row per record of the manifest's files: key, url, payload_bytes, payload_digest, record_type, refers_to,
    intact (the file has the manifest's size; a response's digests hold), and with payloads the payload (null in revisits)."""
    files = spark.read.schema("file string, records long, bytes long, sha256 string").parquet(f"{folder}/manifest")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = located(folder)
        for batch in batches:
            for file, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, held, whole = [], 0, system.get_file_info(f"{base}/{file}").size == size
                with system.open_input_stream(f"{base}/{file}", compression=None) as stream:
                    for raw in members(stream):
                        headers, block = parse(raw)
                        revisit = headers["warc-type"] == "revisit"
                        payload = None if revisit else block.partition(b"\r\n\r\n")[2]
                        digest = headers["warc-payload-digest"].removeprefix("sha1:")
                        intact = whole and headers["warc-block-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode()
                        if payload is not None:
                            intact &= digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        to = _key(headers["warc-refers-to"]) if revisit else None
                        rows.append((_key(headers["warc-record-id"]), headers.get("warc-target-uri"), int(headers["x-payload-length"]), digest, headers["warc-type"], to, intact, payload if payloads else None))
                        held += len(raw)
                        if held > 4 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                yield _batch(rows)

    # tasks by the files' bytes, which the rows of the manifest don't show
    tasks = max(1, -(-(files.agg(F.sum("bytes")).first()[0] or 0) // FILE_BYTES))
    return files.select("file", "bytes").repartition(tasks, F.col("file")).mapInArrow(run, "key long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean, payload binary")


_KINDS = [("key", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("intact", pa.bool_()), ("payload", pa.binary())]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, (_, k) in enumerate(_KINDS)], names=[n for n, _ in _KINDS])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), folder)
    found = read_warc(spark, folder)
    return found.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")
