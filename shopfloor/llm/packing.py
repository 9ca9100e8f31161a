"""Best-fit packing of token sequences by hierarchical residual packing.

Each partition packs its own pieces best-fit, longest first. Nearly full
sequences are final. Of the underfull ones, a tree of merges passes on only what
can still combine: after best-fit at most one sequence of a set is half full or
less, so a merge of FAN_IN sets has at most FAN_IN small sequences to place and
needs at most the FAN_IN emptiest sequences of each set to place them in. Every
merge therefore handles a bounded number of rows, at any input size.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.llm.units import ENCODERS, encoder
from shopfloor.llm.workers import own_turn
from shopfloor.sources.staging import stage

CAPACITY = 1024
FAN_IN = 16
NEARLY_FULL = 0.995
SECTION = 400_000
"""Pieces one task packs together; longer partitions are packed in sections."""
_BIN_BITS, _SECTION_BITS = 28, 16
"""Bits of a sequence id for the sequence in its section and the section in its partition."""


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit, longest first: bin and offset of each item, fill of each bin.

    Open bins are kept by their free room, so each item finds the tightest bin
    with a bit search. Ties go to the item that comes first.
    """
    bins, offsets = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    room_of: list[list[int]] = [[] for _ in range(capacity + 1)]
    fills: list[int] = []
    open_rooms = 0
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = int(sizes[i])
        fitting = open_rooms >> size
        if fitting:
            room = size + (fitting & -fitting).bit_length() - 1
            k = room_of[room].pop()
            if not room_of[room]:
                open_rooms ^= 1 << room
        else:
            room, k = capacity, len(fills)
            fills.append(0)
        bins[i], offsets[i] = k, capacity - room
        fills[k] += size
        left = room - size
        if left:
            if not room_of[left]:
                open_rooms |= 1 << left
            room_of[left].append(k)
    return bins, offsets, np.array(fills, np.int64)


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document of n tokens: whole ones last, the remainder first."""
    if n <= capacity:
        return [(0, n)] if n else []
    head = n % capacity
    return [(0, head)] * bool(head) + [(s, capacity) for s in range(head, n, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, bin long, offset long, fill long"


def _pieces(df: DataFrame, tokenizer: str, end_id: int, capacity: int, key: str, text: str, units_kept: int) -> DataFrame:
    """Pieces of all documents, packed best-fit inside each partition."""

    def packed(columns: dict[str, list], leaf: int) -> pa.RecordBatch:
        bins, offsets, fills = best_fit(np.array(columns["length"], np.int64), capacity)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(columns["doc_id"], pa.int64()),
                pa.array(columns["piece"], pa.int32()),
                *[pa.array(columns[c], pa.int64()) for c in ("start", "length", "ids_crc32")],
                pa.array(bins + (leaf << _BIN_BITS), pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array(fills[bins] if len(bins) else bins, pa.int64()),
            ],
            names=["doc_id", "piece", "start", "length", "ids_crc32", "bin", "offset", "fill"],
        )

    @own_turn(ENCODERS)
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        source, end = encoder(tokenizer, units_kept), np.array([end_id], np.uint32)
        leaf = TaskContext.get().partitionId() << _SECTION_BITS
        columns: dict[str, list] = {c: [] for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                keys = batch.column(0)[at : at + 256].to_pylist()
                for k, ids in zip(keys, source.encode(batch.column(1)[at : at + 256].to_pylist())):
                    ids = np.concatenate([ids, end]).astype("<u4")
                    for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                        crc = zlib.crc32(ids[start : start + length].tobytes())
                        for c, v in zip(columns, (k, piece, start, length, crc)):
                            columns[c].append(v)
            if len(columns["piece"]) >= SECTION:
                yield packed(columns, leaf)
                leaf += 1
                if not leaf & ((1 << _SECTION_BITS) - 1):
                    raise ValueError("a partition holds too many pieces; use more partitions")
                columns = {c: [] for c in columns}
        if columns["piece"]:
            yield packed(columns, leaf)

    return df.select(F.col(key).cast("long"), text).mapInArrow(pack, _PIECES)


def _passed_on(state: pd.DataFrame, capacity: int) -> pd.Series:
    """What can still combine: the sequences at most half full, and the FAN_IN emptiest others."""
    small = 2 * state["fill"] <= capacity
    rank = state["fill"].where(~small).rank(method="first")
    return small | (rank <= FAN_IN)


_STATE = "node long, bin long, fill long, members array<long>, shifts array<long>, up boolean"


def _merged(capacity: int):
    def merge(state: pd.DataFrame) -> pd.DataFrame:
        """One node of the tree: best-fit over underfull sequences as items."""
        state = state.sort_values(["fill", "bin"], ascending=[False, True]).reset_index(drop=True)
        bins, offsets, fills = best_fit(state["fill"].to_numpy(np.int64), capacity)
        rows = []
        for k, fill in enumerate(fills.tolist()):
            inside = np.flatnonzero(bins == k)
            inside = inside[np.argsort(offsets[inside])]
            members = [int(m) for i in inside for m in state["members"][i]]
            shifts = [int(s + offsets[i]) for i in inside for s in state["shifts"][i]]
            rows.append((int(state["node"][0]), int(state["bin"][inside[0]]), fill, members, shifts, True))
        out = pd.DataFrame(rows, columns=["node", "bin", "fill", "members", "shifts", "up"])
        out["up"] = _passed_on(out, capacity)
        return out

    return merge


def pack_documents(
    df: DataFrame,
    tokenizer: str,
    end_id: int = 2,
    capacity: int = CAPACITY,
    key: str = "doc_id",
    text: str = "text",
    units_kept: int = 600_000,
) -> DataFrame:
    """Pack documents into sequences of at most ``capacity`` tokens.

    Each row is one document: its ids and the end id (null and empty texts: the
    end id alone). Longer documents are cut into pieces of ``capacity``, the first
    piece possibly shorter. Returns per piece: doc_id, piece, start, length,
    ids_crc32, sequence_id, offset. Null and repeated keys are kept as rows of
    their own; an empty table gives no rows. Each worker remembers the ids of at
    most ``units_kept`` words.
    """
    pieces = stage(_pieces(df, tokenizer, end_id, capacity, key, text, units_kept), "pieces")
    underfull = pieces.where(F.col("fill") < NEARLY_FULL * capacity)
    # Per section: one sequence at most half full and the FAN_IN emptiest others.
    heads = underfull.where("offset = 0").select(F.shiftright("bin", _BIN_BITS).alias("leaf"), "bin", "fill")

    @own_turn()
    def chosen(part: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in part:
            keep = [group[_passed_on(group, capacity)] for _, group in frame.groupby("leaf")]
            yield pd.concat(keep) if keep else frame

    # Batches of a section first drop what cannot matter; the merge sees a bounded rest.
    heads = heads.mapInPandas(chosen, "leaf long, bin long, fill long")
    state = heads.select(
        F.shiftright("leaf", _SECTION_BITS).alias("node"),
        "bin",
        "fill",
        F.array("bin").alias("members"),
        F.array(F.lit(0).cast("long")).alias("shifts"),
        F.lit(True).alias("up"),
    )
    last = heads.agg(F.max(F.shiftright("leaf", _SECTION_BITS))).first()[0]
    done: list[DataFrame] = []
    while last is not None:
        state = stage(state.groupBy("node").applyInPandas(_merged(capacity), _STATE), "merge")
        if last == 0:
            done.append(state)
            break
        done.append(state.where("not up"))
        state = state.where("up").withColumn("node", F.floor(F.col("node") / FAN_IN).cast("long"))
        last //= FAN_IN
    if not done:
        return pieces.select(*_RESULT, F.col("bin").alias("sequence_id"), "offset")
    moved = done[0]
    for part in done[1:]:
        moved = moved.unionByName(part)
    moved = moved.where(F.size("members") > 1).select("bin", F.explode(F.arrays_zip("members", "shifts")).alias("m"))
    moved = moved.select(F.col("bin").alias("host"), F.col("m.members").alias("bin"), F.col("m.shifts").alias("shift"))
    return pieces.join(moved, "bin", "left").select(
        *_RESULT,
        F.coalesce("host", "bin").alias("sequence_id"),
        (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
    )


_RESULT = ["doc_id", "piece", "start", "length", "ids_crc32"]
