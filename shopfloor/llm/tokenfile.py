"""Token-ID files: patched frame-of-reference blocks with an index of block starts.

Layout of a file: blocks one after the other, then a footer (documents, block
starts) and its length. A block holds up to BLOCK ids:

* header: count, minimum, bit width, number of exceptions (little-endian u32 each);
* the ids minus the minimum, packed at a width that holds PERCENTILE of them;
* the exceptions: positions (u32), then the differences that did not fit (u32).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.llm.files import created, folder, opened
from shopfloor.llm.units import encoder
from shopfloor.sources.staging import stage

MAGIC = b"PFOR0001"
BLOCK = 8192
PERCENTILE = 98.0
_HEADER = struct.Struct("<4I")
_TAIL = struct.Struct("<3Q8s")  # documents, blocks, ids, magic


def pack(values: np.ndarray, width: int) -> bytes:
    """The low ``width`` bits of each value, least significant bit first."""
    if width == 0:
        return b""
    bits = np.unpackbits(values.astype("<u4").view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")
    return np.packbits(bits[:, :width].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width == 0:
        return np.zeros(count, np.uint32)
    bits = np.unpackbits(np.frombuffer(data, np.uint8), bitorder="little", count=count * width).reshape(count, width)
    wide = np.zeros((count, 32), np.uint8)
    wide[:, :width] = bits
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


def encode_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    """One block of 1 to BLOCK ids."""
    low = int(ids.min())
    rest = (ids.astype(np.int64) - low).astype(np.uint32)
    width = int(np.percentile(rest, percentile, method="higher")).bit_length()
    outside = np.flatnonzero(rest >> np.uint32(width)) if width < 32 else np.zeros(0, np.int64)
    patched = rest.copy()
    patched[outside] = 0
    return b"".join(
        [
            _HEADER.pack(len(ids), low, width, len(outside)),
            pack(patched, width),
            outside.astype("<u4").tobytes(),
            rest[outside].astype("<u4").tobytes(),
        ]
    )


def decode_block(data: bytes) -> np.ndarray:
    count, low, width, outside = _HEADER.unpack_from(data)
    at = _HEADER.size
    size = (count * width + 7) // 8
    ids = unpack(data[at : at + size], width, count)
    if outside:
        where = np.frombuffer(data, "<u4", outside, at + size)
        ids[where] = np.frombuffer(data, "<u4", outside, at + size + 4 * outside)
    return ids + np.uint32(low)


class TokenFileWriter:
    """Appends documents; holds one block and the document table."""

    def __init__(self, out: BinaryIO):
        self.out, self.at, self.held, self.waiting = out, 0, [], 0
        self.starts: list[int] = []
        self.docs: list[int | None] = []
        self.sizes: list[int] = []

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def _blocks(self, all_of_it: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        end = len(ids) if all_of_it else len(ids) // BLOCK * BLOCK
        for k in range(0, end, BLOCK):
            self.starts.append(self.at)
            self._write(encode_block(ids[k : min(k + BLOCK, end)]))
        self.held, self.waiting = [ids[end:]], len(ids) - end

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.sizes.append(len(ids))
        self.held.append(ids)
        self.waiting += len(ids)
        if self.waiting >= 32 * BLOCK:
            self._blocks(False)

    def close(self) -> None:
        self._blocks(True)
        self._write(np.array([d is not None for d in self.docs], np.uint8).tobytes())
        self._write(np.array([d or 0 for d in self.docs], "<i8").tobytes())
        self._write(np.array(self.sizes, "<i8").tobytes())
        self._write(np.array(self.starts, "<i8").tobytes())
        self._write(_TAIL.pack(len(self.docs), len(self.starts), sum(self.sizes), MAGIC))


class TokenFileReader:
    """Random access to the ids of a file by position, and its documents in order."""

    def __init__(self, source: BinaryIO):
        self.source = source
        size = source.size()
        source.seek(size - _TAIL.size)
        docs, blocks, self.n_ids, magic = _TAIL.unpack(source.read(_TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token-ID file")
        foot = size - _TAIL.size - 8 * blocks - 17 * docs
        source.seek(foot)
        known = np.frombuffer(source.read(docs), np.uint8).tolist()
        names = np.frombuffer(source.read(8 * docs), "<i8").tolist()
        self.docs = [d if k else None for d, k in zip(names, known)]
        self.sizes = np.frombuffer(source.read(8 * docs), "<i8")
        self.starts = np.append(np.frombuffer(source.read(8 * blocks), "<i8"), foot)
        self.last: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def block(self, k: int) -> np.ndarray:
        if self.last[0] != k:
            self.source.seek(int(self.starts[k]))
            self.last = (k, decode_block(self.source.read(int(self.starts[k + 1] - self.starts[k]))))
        return self.last[1]

    def parts(self, first: int, count: int) -> Iterator[np.ndarray]:
        """The ids at positions first .. first + count - 1, a block's share at a time."""
        while count > 0:
            inside = first % BLOCK
            part = self.block(first // BLOCK)[inside : inside + count]
            yield part
            first += len(part)
            count -= len(part)


def write_token_files(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    key: str = "doc_id",
    text: str = "text",
    label: str = "tokens",
    units_kept: int = 1_200_000,
) -> DataFrame:
    """Encode whole texts and write them in ascending order of ``key``; returns the manifest.

    Manifest: one row per file (file, place, n_docs, n_ids), ``place`` ascending
    in key order. Every input row is one document: null and empty texts hold just
    the end id, null keys come first, rows with equal keys stand in order of a
    hash of their text. An empty table gives no files. The rows are range
    partitioned by (key, text hash), so no key gathers in one task. Each worker
    remembers the ids of at most ``units_kept`` words.
    """
    target = folder(df.sparkSession, label)
    order = [F.col("key").asc_nulls_first(), F.col("tie")]
    rows = df.select(F.col(key).cast("long").alias("key"), F.xxhash64(text).alias("tie"), F.col(text).alias("text"))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("key", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, source, writer = TaskContext.get().partitionId(), encoder(tokenizer, units_kept), None
        end = np.array([end_id], np.uint32)
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        with created(target, ".ids") as (name, out):
            writer = TokenFileWriter(out)
            for batch in (b for part in ([first], batches) for b in part):
                for at in range(0, batch.num_rows, 256):
                    keys = batch.column(0)[at : at + 256].to_pylist()
                    for k, ids in zip(keys, source.encode(batch.column(1)[at : at + 256].to_pylist())):
                        writer.add(k, np.concatenate([ids, end]))
            writer.close()
        yield pa.RecordBatch.from_pydict({"file": [name], "place": [place], "n_docs": [len(writer.docs)], "n_ids": [sum(writer.sizes)]})

    # Written down at once: the files named are those of the tries that succeeded.
    return stage(rows.mapInArrow(write, "file string, place long, n_docs long, n_ids long"), "manifest")


def read_token_files(manifest: DataFrame) -> DataFrame:
    """Documents of the files: doc_id, start, n_tokens, ids_crc32 (of little-endian u32 ids)."""
    before = Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    files = manifest.select("file", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for name, base in ((f, b) for batch in batches for f, b in zip(*(c.to_pylist() for c in batch.columns))):
            with opened(name) as source:
                reader = TokenFileReader(source)
                sizes = reader.sizes
                starts = np.cumsum(sizes) - sizes
                for at in range(0, len(sizes), 10_000):
                    crcs = []
                    for k in range(at, min(at + 10_000, len(sizes))):
                        crc = 0
                        for part in reader.parts(int(starts[k]), int(sizes[k])):
                            crc = zlib.crc32(part.astype("<u4").tobytes(), crc)
                        crcs.append(crc)
                    end = at + len(crcs)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(reader.docs[at:end], pa.int64()),
                            "start": pa.array(starts[at:end] + base, pa.int64()),
                            "n_tokens": pa.array(sizes[at:end], pa.int64()),
                            "ids_crc32": pa.array(crcs, pa.int64()),
                        }
                    )

    # A name a row weighs nothing, so the tasks are counted: one a file.
    spread = files.repartition(max(manifest.count(), 1))
    return spread.mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
