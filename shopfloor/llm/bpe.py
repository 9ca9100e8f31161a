"""Byte-pair encoding by speculation: propose by longest match, verify adjacent pairs, merge only where that fails.

A token sequence is the byte-pair encoding of its word exactly when every
adjacent pair of tokens encodes to itself. So a cheap proposal (greedy longest
match) can be verified with array lookups, all pairs of all distinct words at
once, and the merge loop runs only for words with an unstable pair.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql.functions import pandas_udf

from shopfloor.llm.units import SLICE, SPACE

# Fixed value of the file format: a word is a contraction ending, a run of letters, one digit or a run of other signs.
_WORD = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{SPACE}\p{{L}}\p{{N}}]+")
_CHUNK = re.compile(f"[^{SPACE}]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")
_NO_LIMIT = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable character that stands for each byte: itself if it is a visible Latin-1 sign, else 256 onwards."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return [chr(b) if b in set(shown) else chr(256 + hidden.index(b)) for b in range(256)]


def chunks(text: str) -> Iterator[list[str]]:
    """The runs without white space of a text, in lists of bounded length."""
    if len(text) <= SLICE:
        yield _CHUNK.findall(text) if _SEPARATORS.search(text) else text.split()
        return
    found = _CHUNK.finditer(text)
    while part := [m.group() for m in islice(found, SLICE // 8)]:
        yield part


class SpeculativeBpe:
    """Encoder and decoder for a tokenizers file of a lower-casing BPE with word ends.

    The file must number its tokens in merge order (checked when loading).
    """

    MOST_KEPT = 1_000_000
    LONGEST_KEPT = 48
    """Bounds of the per-worker caches: entries, in a younger and an older half, and their length."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model.get("end_of_word_suffix") or ""
        if not self.suffix:
            raise ValueError("the tokenizer file must mark word ends")
        self.ids: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.tokens = {i: t for t, i in {**self.ids, **self.special}.items()}
        self.letters = byte_letters()
        n = max(self.ids.values()) + 1
        merges = np.array([[self.ids[a], self.ids[b], self.ids[a + b]] for a, b in model["merges"]], np.int64)
        if (np.diff(merges[:, 2]) <= 0).any() or (merges[:, :2].max(axis=1) >= merges[:, 2]).any():
            raise ValueError("token ids must follow the order of the merges")
        self.left, self.right = np.arange(n), np.arange(n)
        self.left[merges[:, 2]], self.right[merges[:, 2]] = merges[:, 0], merges[:, 1]
        key = merges[:, 0] * n + merges[:, 1]
        order = np.argsort(key)
        self.n, self.pair_keys, self.pair_ids = n, key[order], merges[order, 2]
        self.rank = {(int(a), int(b)): int(c) for a, b, c in merges}
        # A token that its own letters do not merge to can never be produced, so it is never proposed.
        own = self.stable(merges[:, 0], merges[:, 1], merges[:, 2])
        reachable = np.ones(n, bool)
        for (a, b, c), ok in zip(merges.tolist(), own.tolist()):
            reachable[c] = ok and reachable[a] and reachable[b]
        self.proposed = {t: i for t, i in self.ids.items() if reachable[i]}
        # Length of the longest token that begins with these two letters.
        self.reach: dict[str, int] = {}
        for t in self.proposed:
            self.reach[t[:2]] = max(len(t), self.reach.get(t[:2], 1))
        self.known: dict[str, list[int]] = {}
        self.kept: dict[str, tuple[int, str, str]] = {}
        self.older: dict[str, tuple[int, str, str]] = {}

    def _merged(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Token that each pair merges to, or no limit where it does not."""
        key = a * self.n + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ids[at], _NO_LIMIT)

    def stable(self, a: np.ndarray, b: np.ndarray, limit: np.ndarray | None = None) -> np.ndarray:
        """Whether each adjacent pair of tokens encodes to itself.

        Undoes the merges inside both tokens from the latest to the earliest; the
        pair is unstable if a merge across the border would have come before one
        that was undone.
        """
        a, b = a.astype(np.int64), b.astype(np.int64)
        limit = np.full(len(a), _NO_LIMIT) if limit is None else limit.astype(np.int64)
        result = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            crossed = self._merged(a, b) < limit
            result[live[crossed]] = False
            go = ~crossed
            live, a, b = live[go], a[go], b[go]
            # The later of both is undone; a single letter is its own half and cannot be.
            a_whole, b_whole = self.right[a] == a, self.left[b] == b
            first = (a > b) & ~a_whole | b_whole & ~a_whole
            done = a_whole & b_whole
            limit = np.where(first, a, b + 1)
            a, b = np.where(first, self.right[a], a), np.where(first, b, self.left[b])
            live, a, b, limit = live[~done], a[~done], b[~done], limit[~done]
        return result

    def propose(self, word: str) -> list[int]:
        """Greedy longest match over a word in byte letters."""
        found, at, n = [], 0, len(word)
        ended = word + self.suffix
        while at < n:
            token = self.proposed.get(ended[at:])
            end = n
            if token is None:
                for end in range(min(n - 1, at + self.reach.get(word[at : at + 2], 1)), at, -1):
                    token = self.proposed.get(word[at:end])
                    if token is not None:
                        break
            if token is None:
                raise ValueError("every single letter must be a token")
            found.append(token)
            at = end
        return found

    def merge(self, word: str) -> list[int]:
        """Exact merging: the earliest merge, leftmost first, until none applies."""
        ids = [self.ids[c] for c in word[:-1]] + [self.ids[word[-1] + self.suffix]]
        if len(ids) <= 32:
            while len(ids) > 1:
                token, i = min((self.rank.get(p, self.n), i) for i, p in enumerate(zip(ids, ids[1:])))
                if token == self.n:
                    break
                ids[i : i + 2] = [token]
            return ids
        # Long words: a heap of the pairs that merge, over a linked list.
        after, before = list(range(1, len(ids) + 1)), list(range(-1, len(ids) - 1))
        heap = [(self.rank[p], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            token, i = heapq.heappop(heap)
            j = after[i] if ids[i] >= 0 else len(ids)
            if j >= len(ids) or self.rank.get((ids[i], ids[j])) != token:
                continue
            ids[i], ids[j] = token, -1
            after[i] = after[j]
            if after[i] < len(ids):
                before[after[i]] = i
            for k, m in ((before[i], i), (i, after[i])):
                if k >= 0 and m < len(ids) and (ids[k], ids[m]) in self.rank:
                    heapq.heappush(heap, (self.rank[ids[k], ids[m]], k))
        return [t for t in ids if t >= 0]

    def words(self, words: list[str]) -> list[list[int]]:
        """Ids of words given in byte letters."""
        proposals = [self.propose(w) for w in words]
        sizes = np.array([len(p) for p in proposals], np.int64)
        flat = np.array([t for p in proposals for t in p], np.int64)
        owner = np.repeat(np.arange(len(words)), sizes)
        inside = np.flatnonzero(owner[1:] == owner[:-1])
        if len(inside):
            wrong = ~self.stable(flat[inside], flat[inside + 1])
            for k in np.unique(owner[inside[wrong]]).tolist():
                proposals[k] = self.merge(words[k])
        return proposals

    def _split(self, chunk: str) -> list[str | int]:
        """Words in byte letters, and ids of special tokens, of a chunk without white space."""
        parts: list[str | int] = []
        rest = [chunk]
        if any(s in chunk for s in self.special):
            rest = re.split("(" + "|".join(map(re.escape, self.special)) + ")", chunk)
        for piece in rest:
            if piece in self.special:
                parts.append(self.special[piece])
                continue
            lower = piece.lower() if piece.isascii() else "".join(c.lower() for c in unicodedata.normalize("NFC", piece))
            for word in _WORD.findall(lower):
                parts.append("".join(self.letters[b] for b in word.encode("utf-8")))
        return parts

    def chunk_ids(self, parts: list[str]) -> list[list[int]]:
        """Ids of each chunk; every distinct word is encoded once as long as it is remembered."""
        split = [self._split(c) for c in parts]
        if len(self.known) > self.MOST_KEPT:
            self.known.clear()
        new = list({w for ws in split for w in ws if isinstance(w, str)}.difference(self.known))
        ids = self.known
        ids.update(zip(new, self.words(new)))
        return [[t for w in ws for t in ([w] if isinstance(w, int) else ids[w])] for ws in split]

    def encode(self, text: str | None) -> list[int]:
        """Ids of a whole text; null and empty give none."""
        return [t for part in chunks(text or "") for ids in self.chunk_ids(part) for t in ids]

    def decode(self, ids: list[int]) -> str:
        """The file names no decoder, so tokens are shown joined by spaces, word ends and all."""
        return " ".join(self.tokens[i] for i in ids)

    def _facts(self, part: list[str]) -> list[tuple[int, str, str]]:
        """(number of ids, ids as text, decoded text) of each chunk, through the cache."""
        facts = list(map(self.kept.get, part))
        if None not in facts:
            return facts
        missing = [i for i, f in enumerate(facts) if f is None]
        new = list({part[i] for i in missing}.difference(self.older))
        made = {c: (len(i), " ".join(map(str, i)), self.decode(i)) for c, i in zip(new, self.chunk_ids(new))}
        for i in missing:
            facts[i] = made.get(part[i]) or self.older[part[i]]
        self.kept.update((part[i], facts[i]) for i in missing if len(part[i]) <= self.LONGEST_KEPT)
        if len(self.kept) > self.MOST_KEPT // 2:
            self.older, self.kept = self.kept, {}
        return facts

    def digests(self, text: str | None) -> tuple[int, str, str]:
        """Number of ids, SHA-256 of the ids as text, SHA-256 of the decoded text; a part of the text at a time."""
        total, ids_hash, text_hash, gap = 0, hashlib.sha256(), hashlib.sha256(), b""
        for part in chunks(text or ""):
            facts = [f for f in self._facts(part) if f[0]]
            if facts:
                total += sum(f[0] for f in facts)
                ids_hash.update(gap + " ".join([f[1] for f in facts]).encode())
                text_hash.update(gap + " ".join([f[2] for f in facts]).encode("utf-8"))
                gap = b" "
        return total, ids_hash.hexdigest(), text_hash.hexdigest()


_loaded: dict[str, SpeculativeBpe] = {}


def codec(path: str) -> SpeculativeBpe:
    """This worker's codec for a tokenizer file."""
    if path not in _loaded:
        _loaded[path] = SpeculativeBpe(path)
    return _loaded[path]


def encode_texts(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add the token ids (array<int>) of each whole text. Null and empty texts get an empty array.

    Rows are kept as they are, repeated ones too; ``out`` replaces a column of that name.
    """

    @pandas_udf("array<int>")
    def ids(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: codec(path).encode(t))

    return df.withColumn(out, ids(df[text]))


def decode_ids(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add the decoded text of each array of ids; null ids decode to the empty text."""
    @pandas_udf("string")
    def texts(rows: pd.Series) -> pd.Series:
        return rows.map(lambda r: codec(path).decode([] if r is None else list(r)))

    return df.withColumn(out, texts(df[ids]))


def token_digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: key, n_tokens, ids_sha256, decoded_sha256, without materialising the ids.

    Null and empty texts have no tokens and the digests of the empty text; a null key is kept.
    """
    schema = df.select(key).schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            found = [bpe.digests(t.as_py()) for t in batch.column(1)]
            counts, ids, texts = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())],
                names=[key, "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return df.select(key, text).mapInArrow(digest, schema)
