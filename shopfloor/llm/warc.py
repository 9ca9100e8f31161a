"""WARC archives: write, normalise whole-file gzip streams into one member per record, and read through the index."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import zlib
from collections.abc import Iterator
from typing import BinaryIO, NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.files import created, folder, opened
from shopfloor.sources.staging import stage

LEVEL = 4
CHUNK = 1 << 20
# Fixed values of the WARC 1.0 format and its identical-payload revisits.
VERSION = b"WARC/1.0\r\n"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2000-01-01T00:00:00Z"
"""WARC-Date of written records, unless given: pages carry no capture time."""


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def serialised(headers: dict[str, str], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in {**headers, "Content-Length": str(len(block))}.items())
    return VERSION + lines.encode("utf-8") + b"\r\n" + block + b"\r\n\r\n"


def inflated(source: BinaryIO) -> Iterator[bytes]:
    """The bytes of a gzip file, be it one member or many, in bounded pieces."""
    left, inflate = b"", zlib.decompressobj(31)
    while True:
        data = left or source.read(CHUNK)
        piece = inflate.decompress(data, CHUNK)
        # Without more input, what the decompressor still holds comes out piece by piece.
        if not data and not piece:
            return
        yield piece
        left = inflate.unconsumed_tail
        if inflate.eof:
            left, inflate = inflate.unused_data, zlib.decompressobj(31)


def records(pieces: Iterator[bytes]) -> Iterator[Record]:
    """Parse a record stream, holding one record at a time."""
    held, done = bytearray(), False

    def fill(n: int) -> bool:
        nonlocal done
        while len(held) < n and not done:
            piece = next(pieces, None)
            if piece is None:
                done = True
            else:
                held.extend(piece)
        return len(held) >= n

    while fill(1):
        looked = 0
        while (end := held.find(b"\r\n\r\n", max(0, looked - 3))) < 0:
            looked = len(held)
            if not fill(looked + 1):
                raise ValueError("a record's headers are cut off")
        lines = held[:end].decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a record")
        headers = dict(line.split(": ", 1) for line in lines[1:])
        size = int(headers["Content-Length"])
        if not fill(end + 4 + size + 4):
            raise ValueError("a record is cut off")
        yield Record(headers, bytes(held[end + 4 : end + 4 + size]))
        del held[: end + 8 + size]


def roles(pages: DataFrame, key: str = "page_id", html: str = "html", least_bytes: int = 0) -> DataFrame:
    """Pages with payload (binary) and first (the key of the response to equal payloads).

    Payloads smaller than ``least_bytes`` are never revisits: their ``first`` is
    their own key. A null html is the empty payload. Rows that repeat the
    response's key are the same record and responses too; null keys count as the
    largest.
    """
    rows = pages.withColumn("payload", F.coalesce(F.col(html).cast("binary"), F.lit(b""))).withColumn(
        "same", F.sha2("payload", 256)
    )
    # The groups are written down so that a payload with very many pages is only one row of a join that can be split.
    firsts = stage(rows.groupBy("same").agg(F.min(key).alias("least")), "payloads")
    large = F.octet_length("payload") >= least_bytes
    return rows.join(firsts, "same").withColumn("first", F.when(large, F.col("least")).otherwise(F.col(key)))


def write_archives(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0, date: str = DATE
) -> DataFrame:
    """One archive per partition, compressed as one gzip stream; returns the manifest (file)."""
    target = folder(pages.sparkSession, "warc")
    rows = roles(pages, key, html, least_bytes).select(
        F.col(key).cast("long").alias("key"), F.col(url).alias("url"), "payload", F.col("first").cast("long").alias("first")
    )

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_batch = next((b for b in batches if b.num_rows), None)
        if first_batch is None:
            return
        with created(target, ".warc.gz") as (name, out), gzip.GzipFile(fileobj=out, mode="wb", compresslevel=LEVEL, mtime=0) as gz:
            for batch in (b for part in ([first_batch], batches) for b in part):
                for k in range(batch.num_rows):
                    page, address, payload, response = (c[k].as_py() for c in batch.columns)
                    headers = {
                        "WARC-Type": "response" if page == response else "revisit",
                        "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
                        "WARC-Date": date,
                        # A line break would end the header.
                        "WARC-Target-URI": " ".join((address or "").split()),
                        "WARC-Payload-Digest": f"sha1:{digest(payload)}",
                        "X-Payload-Length": str(len(payload)),
                        "Content-Type": "application/http; msgtype=response",
                    }
                    if page != response:
                        headers |= {"WARC-Refers-To": f"<urn:page:{response}>", "WARC-Profile": PROFILE}
                    gz.write(serialised(headers, HTTP_HEAD + (payload if page == response else b"")))
        yield pa.RecordBatch.from_pydict({"file": [name]})

    return stage(rows.mapInArrow(write, "file string"), "archives")


def normalise(archives: DataFrame) -> DataFrame:
    """Rewrite each archive with one gzip member per record, and an index of JSON lines beside it.

    Each source stream is inflated once, a record at a time. Returns the manifest
    (file, index, n_records).
    """
    target = folder(archives.sparkSession, "warc-members")

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for source in (s for batch in batches for s in batch.column(0).to_pylist()):
            at = count = 0
            with opened(source) as stream, created(target, ".warc.gz") as (name, out), created(target, ".idx") as (index, notes):
                for record in records(inflated(stream)):
                    headers = {k: v for k, v in record.headers.items() if k != "Content-Length"}
                    member = gzip.compress(serialised(headers, record.block), LEVEL, mtime=0)
                    out.write(member)
                    note = {"id": headers["WARC-Record-ID"], "type": headers["WARC-Type"], "offset": at, "length": len(member)}
                    notes.write(json.dumps(note).encode() + b"\n")
                    at += len(member)
                    count += 1
            yield pa.RecordBatch.from_pydict({"file": [name], "index": [index], "n_records": [count]})

    spread = archives.repartition(max(archives.count(), 1))  # one task a file, however little their names weigh
    return stage(spread.mapInArrow(rewrite, "file string, index string, n_records long"), "members")


def read_archives(manifest: DataFrame, with_payload: bool = False) -> DataFrame:
    """Records by their index entries: page_id, url, payload_bytes, payload_digest, record_type, refers_to (, payload).

    A response's size and digest are recomputed from its payload and must equal
    the headers; a revisit's are those of the payload it refers to.
    """
    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    if with_payload:
        schema, names = schema + ", payload binary", [*names, "payload"]

    def page(text: str) -> int | None:
        number = text.removeprefix("<urn:page:").removesuffix(">")
        return int(number) if number and number != "None" else None

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = pa.schema([(n, pa.string() if n in ("url", "payload_digest", "record_type") else pa.binary() if n == "payload" else pa.int64()) for n in names])
        for name, index in ((f, i) for b in batches for f, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            rows: list[tuple] = []
            held = 0
            with opened(name) as source, opened(index) as notes:
                for note in map(json.loads, io.BufferedReader(notes)):
                    source.seek(note["offset"])
                    record = next(records(iter([gzip.decompress(source.read(note["length"]))])))
                    h = record.headers
                    size, sha = int(h["X-Payload-Length"]), h["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload = None
                    if h["WARC-Type"] == "response":
                        payload = record.block.split(b"\r\n\r\n", 1)[1]
                        if (len(payload), digest(payload)) != (size, sha):
                            raise ValueError(f"{note['id']} does not match its digest")
                    refers = page(h["WARC-Refers-To"]) if "WARC-Refers-To" in h else None
                    rows.append((page(h["WARC-Record-ID"]), h["WARC-Target-URI"], size, sha, h["WARC-Type"], refers, payload)[: len(names)])
                    held += len(payload or b"") if with_payload else 1
                    if len(rows) >= 5_000 or held >= 1 << 24:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=types)
                        rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(names, map(list, zip(*rows)))), schema=types)

    return manifest.select("file", "index").repartition(max(manifest.count(), 1)).mapInArrow(read, schema)
