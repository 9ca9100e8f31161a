"""Byte-level byte-pair encoding with a rank queue under a hierarchy of bitmaps.

The merge loop keeps one linked list over the bytes of many pre-tokens and, for
each merge rank, a bucket of list positions whose pair has that rank. Bitmaps in
levels of 64 tell which buckets hold anything: finding the first set bit on the
way down gives the next rank in a few steps, whatever the number of ranks. A
bucket is taken whole; positions whose pair has changed since are stale and
skipped. Nothing is searched or shifted, so a pre-token of a million bytes costs
a merge what a short one does.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from shopfloor.llm.units import UnitCache, ragged, spelled

_NONE = np.iinfo(np.int64).max


class RankQueue:
    """Buckets of positions by rank; ``pop`` takes the bucket of the lowest rank that holds any."""

    def __init__(self, ranks: int):
        self.buckets: dict[int, list[np.ndarray]] = {}
        self.levels: list[list[int]] = []
        while True:
            ranks = -(-ranks // 64)
            self.levels.append([0] * ranks)
            if ranks == 1:
                break

    def push(self, rank: int, positions: np.ndarray) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.append(positions)
            return
        self.buckets[rank] = [positions]
        for level in self.levels:
            before = level[rank >> 6]
            level[rank >> 6] = before | 1 << (rank & 63)
            if before:
                return
            rank >>= 6

    def push_all(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        """Push each position to the bucket of its rank."""
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        heads = np.flatnonzero(np.diff(ranks, prepend=-1)).tolist()
        for rank, start, end in zip(ranks[heads].tolist(), heads, [*heads[1:], len(ranks)]):
            self.push(rank, positions[start:end])

    def pop(self) -> tuple[int, np.ndarray] | None:
        if not self.levels[-1][0]:
            return None
        rank = 0
        for level in reversed(self.levels):
            word = level[rank]
            rank = rank << 6 | (word & -word).bit_length() - 1
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        bucket = self.buckets.pop(rank)
        return rank, bucket[0] if len(bucket) == 1 else np.concatenate(bucket)


class ByteBpe(UnitCache):
    """Encoder and decoder for a rank file: a token in base64 and its rank on every line.

    ``pattern`` cuts texts into pre-tokens, which are encoded one by one. A
    pre-token that is a token is that token; otherwise the adjacent pair whose
    bytes have the lowest rank is merged, the leftmost first, until none has one.
    """

    BATCH_UNITS = 800_000
    BATCH_BYTES = 1_500_000
    """Bytes of pre-tokens merged together; a longer pre-token goes alone."""

    def __init__(self, path: str, pattern: str, most_kept: int = 1_000_000, most_chars: int = 20_000_000):
        super().__init__(most_kept, most_chars)
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.pattern = regex.compile(pattern)
        self.n = max(self.ranks.values()) + 1
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the rank file has no token for byte {missing[0]}")
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        # What any two tokens merge to: every way to cut a token into two tokens.
        cuts = [(self.ranks.get(t[:k], -1), self.ranks.get(t[k:], -1), r) for t, r in self.ranks.items() for k in range(1, len(t))]
        cuts = np.array([c for c in cuts if c[0] >= 0 and c[1] >= 0], np.int64).reshape(-1, 3)
        keys = cuts[:, 0] * (self.n + 1) + cuts[:, 1]
        order = np.argsort(keys)
        self.pair_keys, self.pair_ranks = keys[order], cuts[order, 2]
        # The bytes of all tokens, one after the other.
        tokens = [b""] * self.n
        for token, rank in self.ranks.items():
            tokens[rank] = token
        self.token_sizes = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_sizes) - self.token_sizes
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _pair_ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the bytes of each pair of tokens; the token n (behind the last) merges with none."""
        if not len(self.pair_keys):
            return np.full(len(a), _NONE)
        key = a * (self.n + 1) + b
        at = np.searchsorted(self.pair_keys, key)
        return np.where(self.pair_keys.take(at, mode="clip") == key, self.pair_ranks.take(at, mode="clip"), _NONE)

    def merge(self, words: list[bytes], leftmost_only: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of pre-tokens and each one's number of ids.

        All pairs of one rank are merged together. That equals merging them one by
        one from the left unless a merge makes a pair of a still lower rank; words
        where that happens are done again with ``leftmost_only``.
        """
        sizes = np.array([len(w) for w in words], np.int64)
        n = int(sizes.sum())
        owner = np.repeat(np.arange(len(words)), sizes)
        # Linked list; position n stands behind the last byte of every word, and before the first.
        token = np.append(self.byte_ids[np.frombuffer(b"".join(words), np.uint8)], self.n)
        after, before = np.arange(1, n + 2), np.arange(-1, n)
        ends = np.cumsum(sizes)[sizes > 0]
        after[ends - 1] = n
        before[ends - sizes[sizes > 0]] = n
        rank_of = np.append(self._pair_ranks(token[:n], token[after[:n]]), _NONE)
        alive = np.ones(n + 1, bool)
        taking = np.append(np.zeros(n, bool), True)
        again = np.zeros(len(words), bool)
        queue = RankQueue(self.n)
        first = np.flatnonzero(rank_of != _NONE)
        queue.push_all(rank_of[first], first)
        while (taken := queue.pop()) is not None:
            rank, at = taken
            at = at.compress(rank_of.take(at) == rank)  # the others are stale
            if len(at) > 1:
                at.sort()
                if leftmost_only:
                    head = np.diff(owner.take(at), prepend=-1) != 0
                    if not head.all():
                        queue.push(rank, at[~head])
                    at = at[head]
                else:
                    chained = after.take(at[:-1]) == at[1:]
                    if chained.any():  # overlapping pairs: every other one of a chain, from its left
                        place = np.arange(len(at))
                        start = np.maximum.accumulate(np.where(np.append(False, chained), 0, place))
                        at = at[(place - start) % 2 == 0]
            if not len(at):
                continue
            gone = after.take(at)
            behind = after.take(gone)
            token[at] = rank
            rank_of[gone] = _NONE
            alive[gone] = False
            after[at] = behind
            before[behind] = at
            left = before.take(at)  # neighbours merged just now are found by their new place
            taking[at] = True
            touched = np.concatenate([at, left.compress(~taking.take(left))])
            taking[at] = False
            made = self._pair_ranks(token.take(touched), token.take(after.take(touched)))
            rank_of[touched] = made
            live = made != _NONE
            touched, made = touched.compress(live), made.compress(live)
            if len(made):
                queue.push_all(made, touched)
                if not leftmost_only and made.min() < rank:
                    again[owner[touched[made < rank]]] = True
        alive = alive[:n]
        ids, counts = token[:n][alive].astype(np.uint32), np.bincount(owner[alive], minlength=len(words))
        if again.any():
            own = self.merge([w for w, odd in zip(words, again) if odd], leftmost_only=True)
            return _replaced(ids[~np.repeat(again, counts)], ~again, counts[~again], *own)
        return ids, counts

    def _pieces(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """The pre-tokens of all units, and where each unit's begin."""
        # One space or line break and a word: such units cut alike side by side, and each begins with its white space.
        if all(u[:1] not in ("", "\0") and u != "\n" for u in units):
            pieces = self.pattern.findall("".join(map(spelled, units)))
            heads = np.flatnonzero(np.array([p[0] in " \n" for p in pieces], bool))
            return pieces, heads
        pieces, heads = [], np.zeros(len(units), np.int64)
        for k, unit in enumerate(units):
            heads[k] = len(pieces)
            pieces += self.pattern.findall(spelled(unit))
        return pieces, heads

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.array([u[:1] not in ("", "\0") and u != "\n" for u in units], bool)
        ids, sizes = self._encoded([u for u, p in zip(units, plain) if p])
        if not plain.all():
            return _replaced(ids, plain, sizes, *self._encoded([u for u, p in zip(units, plain) if not p]))
        return ids, sizes

    def _encoded(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if not units:
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        pieces, heads = self._pieces(units)
        slot = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
        code = np.fromiter(map(slot.get, pieces), np.int64, len(pieces))
        words = [p.encode("utf-8") for p in slot]
        whole = np.array([self.ranks.get(w, -1) for w in words], np.int64)
        done, parts, held, size = whole >= 0, [], [], 0
        for k in np.flatnonzero(~done).tolist():
            held.append(words[k])
            size += len(words[k])
            if size >= self.BATCH_BYTES:
                parts.append(self.merge(held))
                held, size = [], 0
        if held:
            parts.append(self.merge(held))
        ids, sizes = whole[done].astype(np.uint32), np.ones(int(done.sum()), np.int64)
        if parts:
            ids, sizes = _replaced(ids, done, sizes, np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
        starts = np.cumsum(sizes) - sizes
        return ids[ragged(starts[code], sizes[code])], np.add.reduceat(sizes[code], heads)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids; an id without a token is an error."""
        ids = np.asarray(ids).astype(np.int64)
        if len(ids) and (ids.min() < 0 or ids.max() >= self.n or not self.token_sizes[ids].all()):
            raise ValueError("an id is in no rank of the file")
        return self.token_bytes[ragged(self.token_starts[ids], self.token_sizes[ids])].tobytes()


def _replaced(
    ids: np.ndarray, where: np.ndarray, counts: np.ndarray, other_ids: np.ndarray, other_counts: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """One ragged array from the rows at ``where`` and, for all other rows, the others, each in their order."""
    sizes = np.zeros(len(where), np.int64)
    sizes[where], sizes[~where] = counts, other_counts
    starts = np.cumsum(sizes) - sizes
    out = np.zeros(int(sizes.sum()), np.uint32)
    out[ragged(starts[where], sizes[where])] = ids
    out[ragged(starts[~where], sizes[~where])] = other_ids
    return out, sizes


_loaded: dict[tuple[str, str], ByteBpe] = {}


def codec(path: str, pattern: str) -> ByteBpe:
    """This worker's codec for a rank file."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


ROWS_CHARS = 8_000_000
"""Characters of texts encoded, and given back, together."""


def _groups(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Ranges of rows with a bounded number of bytes, a longer text alone."""
    ends = np.cumsum(pa.compute.binary_length(texts).fill_null(0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(texts):
        base = int(ends[start - 1]) if start else 0
        end = max(start + 1, int(np.searchsorted(ends, base + ROWS_CHARS, side="right")))
        yield start, end
        start = end


def round_trip(df: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, ids (binary, little-endian unsigned 32-bit), decoded (the bytes of those ids).

    Null and empty texts have no ids and decode to nothing; a null key is kept,
    repeated rows stay repeated, other columns are not read.
    """
    schema = df.select(key).schema.add("ids", "binary", False).add("decoded", "binary", False)

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path, pattern)
        for batch in batches:
            for start, end in _groups(batch.column(1)):
                ids = bpe.encode(batch.column(1).slice(start, end - start).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, end - start),
                        pa.array([i.astype("<u4").tobytes() for i in ids], pa.binary()),
                        pa.array([bpe.decode(i) for i in ids], pa.binary()),
                    ],
                    names=[key, "ids", "decoded"],
                )

    return df.select(key, text).mapInArrow(both, schema)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids (array<int>) of each whole text. Null and empty texts get an empty array.

    Rows are kept as they are, repeated ones too; ``out`` replaces a column of that name.
    """

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series([i.astype(np.int32) for i in codec(path, pattern).encode(texts.tolist())], index=texts.index, dtype=object)

    return df.withColumn(out, ids(df[text]))


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the bytes (binary) of each array of ids; null ids decode to no bytes, unknown ids are an error."""

    @pandas_udf("binary")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: codec(path, pattern).decode([] if r is None else r))

    return df.withColumn(out, texts(df[ids]))
