"""Sets of hashed word shingles, for many texts at once."""

from __future__ import annotations

import hashlib

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_GAP = np.zeros(256, bool)
_GAP[[32, 9, 10, 11, 12, 13]] = True
_LONG = 64
"""Bytes; longer words are hashed one by one."""
_TOGETHER = 400_000
"""Characters of texts that are hashed together: the arrays made on the way are more than ten times as large."""


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """64-bit hash of each word: its bytes taken eight at a time."""
    lanes = np.lib.stride_tricks.as_strided(np.append(data, np.zeros(8, np.uint8)).view(), (len(data) + 1, 8), (1, 1))
    hashes = mix(sizes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    live = np.flatnonzero(sizes <= _LONG)
    at, left = starts[live], sizes[live]
    with np.errstate(over="ignore"):
        while len(live):
            lane = lanes[at].view("<u8").ravel()
            cut = np.minimum(left, 8).astype(np.uint64)
            lane &= np.where(cut == 8, np.uint64(2**64 - 1), (np.uint64(1) << (cut % np.uint64(8) * np.uint64(8))) - np.uint64(1))
            hashes[live] = mix(hashes[live] * np.uint64(0x2545F4914F6CDD1D) + lane)
            more = left > 8
            live, at, left = live[more], at[more] + 8, left[more] - 8
    for k in np.flatnonzero(sizes > _LONG).tolist():
        word = data[starts[k] : starts[k] + sizes[k]].tobytes()
        hashes[k] = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
    return hashes


def shingle_sets(texts: list[str | None], n: int = 5) -> list[np.ndarray]:
    """Sorted distinct hashes of the n-word shingles of each text, A-Z lower-cased.

    A text of fewer words has one shingle, the whole of it; none without words.
    """
    found: list[np.ndarray] = []
    at = held = 0
    for k, text in enumerate(texts):
        size = len(text or "")
        if k > at and held + size > _TOGETHER:
            found += _sets(texts[at:k], n)
            at, held = k, 0
        held += size
    return found + _sets(texts[at:], n) if at < len(texts) else found


def _sets(texts: list[str | None], n: int) -> list[np.ndarray]:
    parts = [(t or "").encode("utf-8", "replace") for t in texts]
    data = _LOWER[np.frombuffer(b" ".join(parts) + b" ", np.uint8)]
    ends = np.cumsum([len(p) + 1 for p in parts])
    gap = _GAP[data]
    edge = np.flatnonzero(np.diff(gap, prepend=True))
    starts, sizes = edge[::2], edge[1::2] - edge[::2]
    hashes = word_hashes(data, starts, sizes)
    owner = np.searchsorted(ends, starts, side="right")
    counts = np.bincount(owner, minlength=len(texts))
    with np.errstate(over="ignore"):
        rolled = hashes[: max(len(hashes) - n + 1, 0)].copy()
        for k in range(1, n):
            rolled = rolled * np.uint64(0xD1342543DE82EF95) + hashes[k : len(hashes) - n + 1 + k]
        rolled = mix(rolled)
    found, at = [], 0
    for count in counts.tolist():
        if count >= n:
            found.append(np.unique(rolled[at : at + count - n + 1]))
        elif count:
            h = np.uint64(count)
            with np.errstate(over="ignore"):
                for k in range(at, at + count):
                    h = h * np.uint64(0xD1342543DE82EF95) + hashes[k]
            found.append(mix(np.array([h], np.uint64)))
        else:
            found.append(np.zeros(0, np.uint64))
        at += count
    return found


def signature(hashes: np.ndarray) -> bytes:
    """128 bits that tell a set of hashes from other sets."""
    with np.errstate(over="ignore"):
        halves = [mix(hashes ^ np.uint64(c)).sum(dtype=np.uint64) for c in (0x6A09E667F3BCC908, 0xBB67AE8584CAA73B)]
    return b"".join(int(h).to_bytes(8, "little") for h in halves)
