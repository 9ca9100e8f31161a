"""Cut texts into units that a tokenizer encodes independently, and encode each distinct unit once.

A unit is a run of white space and the word after it. The tokenizers used here
never look back across the start of such a unit, so the ids of a text are the
ids of its units in order. Words repeat, so each worker keeps a bounded cache.
New units are often known words beside other signs, so a tokenizer that marks
word ends is asked for the unknown words only.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import regex

from shopfloor.llm.workers import kept

SPACE = "\t-\r \x85\xa0  -     　"
"""Unicode white space, as a regular-expression class body (the tokenizers' ``\\s``)."""
_UNIT = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
_ODD = ["\t", "\v", "\f", "\r", "\0", "  ", "\n\n", " \n", "\n "]
_ODD_WIDE = [c for c in map(chr, [0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])]
SLICE = 2_000_000
"""Characters cut into units at a time; longer texts go through in slices."""
ENCODERS = "encoders"
"""Name under which a worker keeps its encoders."""
_WORD = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LOWERED = {
    "type": "Sequence",
    "normalizers": [
        {"type": "NFC"},
        {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "},
        {"type": "Lowercase"},
    ],
}
_IN_WORDS = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": _WORD}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
"""What a tokenizer file says that lower-cases, drops white space and cuts the rest into words."""
_LED_WORD = regex.compile(f" ?(?:{_WORD})")
_LATIN = "!-~À-ÖØ-öø-įı-ž"
"""Signs that are their own NFC and have one lower-case letter, whatever stands beside them."""


def slices(text: str) -> Iterator[list[str]]:
    """The units of ``text`` in order, in lists of bounded total length.

    A leading plain space is left out: "word" stands for " word", and a unit
    that has no space before it (the first of a text) is marked with "\\0".
    Texts with other white space keep their units whole, marked alike.
    """
    if not text:
        return
    if text[0] in " \n" or text[-1] in " \n" or _is_odd(text):
        held: list[str] = []
        size = 0
        for found in _UNIT.finditer(text):
            held.append("\0" + found.group())
            size += found.end() - found.start()
            if size >= SLICE:
                yield held
                held, size = [], 0
        yield held
        return
    start = 0
    while start < len(text):
        end = text.find(" ", start + SLICE)
        end = len(text) if end < 0 else end
        units = text[start:end].replace("\n", " \n").split(" ")
        if start == 0:
            units[0] = "\0" + units[0]
        yield units if start == 0 else units[1:]
        start = end


def _is_odd(text: str) -> bool:
    """Whether words are apart by anything but one plain space or line break."""
    return any(c in text for c in _ODD) or not text.isascii() and any(c in text for c in _ODD_WIDE)


def spelled(unit: str) -> str:
    """The characters a unit of ``slices`` stands for."""
    return unit[1:] if unit[0] == "\0" else unit if unit[0] == "\n" else " " + unit


class UnitCache:
    """Ids of texts through the ids of their units; each distinct unit is encoded once per worker while it is kept.

    A subclass says how new units are encoded. ``most_kept`` and ``most_chars``
    bound the cache: units and their total characters.
    """

    BATCH_UNITS = 200_000
    """Units looked up at a time."""

    def __init__(self, most_kept: int = 600_000, most_chars: int = 10_000_000):
        self.most_kept, self.most_chars = most_kept, most_chars
        self._keep({}, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of units not seen before, and each unit's number of ids."""
        raise NotImplementedError

    def _keep(self, slot: dict[str, int], starts: np.ndarray, sizes: np.ndarray, pool: np.ndarray) -> None:
        self.slot, self.starts, self.sizes, self.pool = slot, starts, sizes, pool
        self.uses = np.zeros(len(sizes), np.int64)
        self.chars = sum(map(len, slot))

    def _trim(self) -> None:
        """Forget the units used once only; all of them where that frees less than half."""
        units = np.array(list(self.slot), dtype=object)
        kept = np.flatnonzero(self.uses > 1)
        if 2 * len(kept) > self.most_kept or 2 * sum(map(len, units[kept])) > self.most_chars:
            kept = kept[:0]
        sizes = self.sizes[kept]
        starts = np.cumsum(sizes) - sizes
        pool = self.pool[ragged(self.starts[kept], sizes)]
        self._keep(dict(zip(units[kept].tolist(), range(len(kept)))), starts, sizes, pool)

    def _learn(self, new: list[str]) -> None:
        ids, sizes = self.fresh(new)
        sizes = sizes.astype(np.int64)
        self.slot.update(zip(new, range(len(self.sizes), len(self.sizes) + len(new))))
        self.starts = np.concatenate([self.starts, len(self.pool) + np.cumsum(sizes) - sizes])
        self.sizes = np.concatenate([self.sizes, sizes])
        self.pool = np.concatenate([self.pool, ids])
        self.uses = np.concatenate([self.uses, np.zeros(len(sizes), np.int64)])
        self.chars += sum(map(len, new))

    def _gather(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the units, and where each unit's end; unknown units are learned first."""
        slots = np.fromiter(map(self.slot.get, units, repeat(-1)), np.int64, len(units))
        missing = np.flatnonzero(slots < 0).tolist()
        new = list({units[i] for i in missing})
        if len(self.slot) + len(new) > self.most_kept or self.chars > self.most_chars:
            self._trim()
            slots = np.fromiter(map(self.slot.get, units, repeat(-1)), np.int64, len(units))
            missing = np.flatnonzero(slots < 0).tolist()
            new = list({units[i] for i in missing})
        if new:
            self._learn(new)
            slots[missing] = [self.slot[units[i]] for i in missing]
        self.uses += np.bincount(slots, minlength=len(self.uses))
        sizes = self.sizes[slots]
        return self.pool[ragged(self.starts[slots], sizes)], np.concatenate([[0], np.cumsum(sizes)])

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """uint32 ids of each text (null: none), equal to the library's on the whole text."""
        parts: list[list[np.ndarray]] = [[] for _ in texts]
        held: list[str] = []
        owners: list[tuple[int, int]] = []

        def flush() -> None:
            ids, ends = self._gather(held)
            at = 0
            for k, n in owners:
                parts[k].append(ids[ends[at] : ends[at + n]])
                at += n
            held.clear()
            owners.clear()

        for k, text in enumerate(texts):
            for units in slices(text or ""):
                held += units
                owners.append((k, len(units)))
                if len(held) >= self.BATCH_UNITS:
                    flush()
        flush()
        return [p[0] if len(p) == 1 else np.concatenate(p) if p else np.zeros(0, np.uint32) for p in parts]


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The positions start, start + 1, ... of every run, one run after the other."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total) + np.repeat(starts - (ends - sizes), sizes)


class UnitEncoder(UnitCache):
    """Ids of texts by one tokenizer file of the tokenizers library."""

    def __init__(self, path: str, most_kept: int = 600_000, most_chars: int = 10_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks already use the cores
        from tokenizers import Tokenizer

        super().__init__(most_kept, most_chars)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        special = [t for t in self.tokenizer.get_added_tokens_decoder().values() if t.special]
        self.border = special[0].content
        self.border_id = self.tokenizer.token_to_id(self.border)
        self.ends = self._word_ends()
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join([f"[^{_LATIN}]", *added]))

    def _word_ends(self) -> np.ndarray | None:
        """Which ids end a word; None if the file has no such ids, or cuts texts into other words than ``_WORD``."""
        from tokenizers.pre_tokenizers import ByteLevel

        spec = json.loads(self.tokenizer.to_str())
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix or spec["normalizer"] != _LOWERED or spec["pre_tokenizer"] != _IN_WORDS:
            return None
        vocab = spec["model"]["vocab"]
        if spec["model"].get("ignore_merges") or not all(c in vocab and c + suffix in vocab for c in ByteLevel.alphabet()):
            return None
        ends = np.zeros(max(self.tokenizer.get_vocab().values()) + 1, bool)
        ends[[i for t, i in vocab.items() if t.endswith(suffix)]] = True
        return ends

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def fresh(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units in Latin letters are put together from their words, where the tokenizer marks word ends."""
        if self.ends is None:
            return self._between_borders(units)
        bare = [u[1:] if u[:1] in ("\0", "\n") else u for u in units]
        plain = np.array([u != "" and not self.odd.search(u) for u in bare], bool)
        if not plain.any():
            return self._between_borders(units)
        ids, sizes = self._by_words([u for u, p in zip(bare, plain) if p])
        if plain.all():
            return ids, sizes
        other_ids, other_sizes = self._between_borders([u for u, p in zip(units, plain) if not p])
        ids, sizes = np.concatenate([ids, other_ids]), np.concatenate([sizes, other_sizes])
        starts, place = np.cumsum(sizes) - sizes, np.argsort(np.argsort(~plain, kind="stable"))
        return ids[ragged(starts[place], sizes[place])], sizes[place]

    def _by_words(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Units share most of their words, with each other and with the units that are kept: a word has the ids it
        has as a unit. Only the others go through the library, each once."""
        led = _LED_WORD.findall(" " + " ".join(units).lower())
        heads = np.flatnonzero(np.fromiter((w[0] == " " for w in led), bool, len(led)))
        words = [w[1:] if w[0] == " " else w for w in led]
        code = {w: k for k, w in enumerate(dict.fromkeys(words))}
        codes = np.fromiter(map(code.get, words), np.int64, len(words))
        slots = np.fromiter(map(self.slot.get, code, repeat(-1)), np.int64, len(code))
        new_ids, new_sizes = self._words([w for w, s in zip(code, slots.tolist()) if s < 0])
        known = slots[slots >= 0]
        ids = np.concatenate([self.pool[ragged(self.starts[known], self.sizes[known])], new_ids])
        sizes = np.concatenate([self.sizes[known], new_sizes])
        place = np.argsort(np.argsort(slots < 0, kind="stable"))[codes]
        starts = np.cumsum(sizes) - sizes
        return ids[ragged(starts[place], sizes[place])], np.add.reduceat(sizes[place], heads)

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many words go through the library in one text, a space between them: the last id of each marks its end."""
        texts = (" ".join(words[at : at + 100]) for at in range(0, len(words), 100))
        found = (self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts)
        ids = np.fromiter(chain.from_iterable(found), np.uint32)
        last = np.flatnonzero(self.ends[ids])
        if len(last) != len(words):
            raise ValueError("the tokenizer did not mark the end of every word")
        return ids, np.diff(last, prepend=-1)

    def _between_borders(self, units: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many units go through the library in one text, with a special token between them: special tokens
        are cut out first, so each unit is encoded as if alone."""
        ids, sizes = [], []
        for at in range(0, len(units), 100):
            part = [spelled(u) for u in units[at : at + 100]]
            if any(self.border in u for u in part):
                ids += map(self._ids, part)
                sizes.append([len(i) for i in ids[-len(part) :]])
                continue
            flat = self._ids(self.border.join(part))
            borders = np.flatnonzero(flat == self.border_id)
            if len(borders) != len(part) - 1:
                raise ValueError("the tokenizer did not keep the borders between units")
            sizes.append(np.diff(borders, prepend=-1, append=len(flat)) - 1)
            ids.append(np.delete(flat, borders))
        return np.concatenate(ids), np.concatenate(sizes)


def encoder(path: str, most_kept: int = 600_000) -> UnitEncoder:
    """This worker's encoder for a tokenizer file, remembering at most so many units."""
    encoders = kept(ENCODERS)
    if (path, most_kept) not in encoders:
        encoders[path, most_kept] = UnitEncoder(path, most_kept, 17 * most_kept)
    return encoders[path, most_kept]
