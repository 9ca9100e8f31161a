"""Fill-in-middle: cut a text in three at code points and put the middle last.

The code points of a text in UTF-8 are the byte offsets at which one starts. That
set is kept in containers of 65 536 offsets, each in its cheapest form (a sorted
array, a bitmap, or runs), with the number of code points before each container.
Where code point k starts is then a search over those numbers and a selection
inside one container; texts are never decoded.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 65_536
"""Byte offsets in a container."""
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


class _Array:
    """Few offsets: listed."""

    def __init__(self, starts: np.ndarray):
        self.places = np.flatnonzero(starts).astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.places[k])


class _Bitmap:
    """Many scattered offsets: a bit each, and the number of bits before every 64."""

    def __init__(self, starts: np.ndarray):
        padded = np.zeros(-(-len(starts) // 64) * 64, bool)
        padded[: len(starts)] = starts
        self.bits = np.packbits(padded, bitorder="little").reshape(-1, 8)
        counts = padded.reshape(-1, 64).sum(axis=1)
        self.before = np.cumsum(counts) - counts

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, side="right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.bits[word], bitorder="little"))
        return 64 * word + int(inside[k - self.before[word]])


class _Runs:
    """Long stretches of one-byte characters: where each run begins, and the offsets before it."""

    def __init__(self, starts: np.ndarray):
        edges = np.flatnonzero(np.diff(starts, prepend=False, append=False))
        self.heads, sizes = edges[::2], edges[1::2] - edges[::2]
        self.before = np.cumsum(sizes) - sizes

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, side="right")) - 1
        return int(self.heads[run]) + k - int(self.before[run])


def container(starts: np.ndarray) -> _Array | _Bitmap | _Runs:
    """The smallest form for one span: two bytes an offset, one bit a byte, or four bytes a run."""
    count = int(np.count_nonzero(starts))
    runs = int(np.count_nonzero(starts[1:] & ~starts[:-1])) + int(starts[0])
    sizes = {_Runs: 4 * runs, _Array: 2 * count, _Bitmap: SPAN // 8}
    return min(sizes, key=sizes.get)(starts)


class BoundarySet:
    """The offsets at which the code points of a UTF-8 text start; ``len`` is their number."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        starts = (raw & 0xC0) != 0x80
        self.end = len(raw)
        spans = [starts[at : at + SPAN] for at in range(0, len(raw), SPAN)]
        self.containers = [container(s) for s in spans]
        counts = np.array([np.count_nonzero(s) for s in spans], np.int64)
        self.before = np.cumsum(counts) - counts
        self.size = int(counts.sum())

    def __len__(self) -> int:
        return self.size

    def offset(self, k: int) -> int:
        """The byte at which code point k starts; the end of the text for k = len."""
        if k == self.size:
            return self.end
        at = int(np.searchsorted(self.before, k, side="right")) - 1
        return at * SPAN + self.containers[at].select(k - int(self.before[at]))


def draws(key: str, seed: int = 1) -> tuple[int, ...]:
    """Four numbers below 2^32 that depend on the key alone."""
    found = hashlib.sha256(f"{seed}:{key}".encode()).hexdigest()
    return tuple(int(found[8 * k : 8 * k + 8], 16) for k in range(4))


def transformed(text: bytes, key: str, seed: int, plain_percent: int, spm_percent: int) -> tuple:
    """(n, form, prefix_chars, middle_chars, output) of one text; the two lengths are none for a plain one."""
    cuts = BoundarySet(text)
    n = len(cuts)
    first, second, form, order = draws(key, seed)
    marks = [m.encode() for m in (PREFIX, SUFFIX, MIDDLE)]
    if not n or any(m in text for m in marks) or form % 100 >= 100 - plain_percent:
        return n, PLAIN, None, None, text
    low, high = sorted((first % (n + 1), second % (n + 1)))
    a, b = cuts.offset(low), cuts.offset(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < spm_percent:
        return n, SPM, low, high - low, b"".join([marks[1], suffix, marks[0], prefix, marks[2], middle])
    return n, PSM, low, high - low, b"".join([marks[0], prefix, marks[1], suffix, marks[2], middle])


BATCH_BYTES = 8_000_000
"""Output is handed back after so many bytes."""


def fill_in_middle(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    *,
    seed: int = 1,
    plain_percent: int = 10,
    spm_percent: int = 20,
) -> DataFrame:
    """One row per input row: key, n (code points), form, prefix_chars, middle_chars, output.

    ``plain_percent`` of the texts stay as they are, and ``spm_percent`` of the
    others put the suffix first. A null text counts as empty; empty texts and texts
    that hold a marker are plain. The draws depend on the key's decimal text, the
    empty text for a null key, so rows that share a key are drawn alike. Rows are
    kept, repeated ones too; other columns are not read.
    """
    schema = df.select(key).schema.add("n", "long").add("form", "string")
    schema = schema.add("prefix_chars", "long").add("middle_chars", "long").add("output", "string")
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, texts = batch.column(1).to_pylist(), batch.column(2)
            start, size, found = 0, 0, []
            for k in range(len(texts)):
                found.append(transformed(texts[k].as_py() or b"", names[k], seed, plain_percent, spm_percent))
                size += len(found[-1][-1])
                if size >= BATCH_BYTES or k == len(texts) - 1:
                    made = [pa.array(list(c), t) for c, t in zip(zip(*found), [*kinds[:-1], pa.binary()])]
                    made[-1] = made[-1].cast(pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, k + 1 - start), *made], names=schema.names)
                    start, size, found = k + 1, 0, []

    name = F.coalesce(F.col(key).cast("string"), F.lit("")).alias("_name")
    return df.select(key, name, F.col(text).cast("binary")).mapInArrow(cut, schema)


def restored(form: str | Column = "form", output: str | Column = "output") -> Column:
    """The text that an output was made from.

    A cut text holds no marker, and no marker can arise where a piece meets one, so
    the pieces are what stands between the markers.
    """
    form, output = (F.col(c) if isinstance(c, str) else c for c in (form, output))
    pieces = F.split(output, "|".join(map(re.escape, (PREFIX, SUFFIX, MIDDLE))), -1)
    return (
        F.when(form == PSM, F.concat(pieces[1], pieces[3], pieces[2]))
        .when(form == SPM, F.concat(pieces[2], pieces[3], pieces[1]))
        .otherwise(output)
    )
