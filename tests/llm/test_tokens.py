"""Tokens, token files and packing against the library itself."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from fixtures import awkward, documents, sha256
from tokenizers import Tokenizer

from shopfloor.llm import bpe, packing, tokenfile
from shopfloor.llm.units import UnitEncoder

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", " ", "'s", "1", "23", "!!", "<|endoftext|>", "<|startoftext|>", "日本"]
PIECES += ["\x1c", "\0", "é", "İ", "Σ", "　", "<", "</w>", "x" * 70, "\r\n", "🙂", "‍", "'", " 's", "tion", "THE", "est"]


def ids(path, text):
    return Tokenizer.from_file(path).encode(text, add_special_tokens=False).ids


def noise(n, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_units_give_the_ids_of_the_whole_text(path):
    library, own = Tokenizer.from_file(path), UnitEncoder(path)
    texts = noise(2_000)
    for text, found in zip(texts, own.encode(texts)):
        assert found.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_a_full_cache_changes_nothing():
    library, own = Tokenizer.from_file(BYTES), UnitEncoder(BYTES)
    own.most_kept = 20
    for text in noise(300, seed=2):
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids


class Given:
    """The library's tokenizer, and the texts that it was given."""

    def __init__(self, tokenizer):
        self.tokenizer, self.texts = tokenizer, []

    def encode(self, text, **options):
        self.texts.append(text)
        return self.tokenizer.encode(text, **options)

    def encode_batch_fast(self, texts, **options):
        self.texts += texts
        return self.tokenizer.encode_batch_fast(texts, **options)


def test_units_of_known_words_are_put_together():
    own = UnitEncoder(WORDS)
    own.encode(["x the river élan 's 7 , ( )."])
    own.tokenizer = given = Given(own.tokenizer)
    text = "The river, (the RIVER). Élan's 77 élan,7\nTHE's"
    assert own.encode([text])[0].tolist() == ids(WORDS, text)
    assert given.texts == []
    text = "zqthe, Zqthe zqthe. new(zqthe"
    assert own.encode([text])[0].tolist() == ids(WORDS, text)
    assert sorted(" ".join(given.texts).split()) == [".", "new", "zqthe"]


def test_latin_letters_and_signs():
    library, own = Tokenizer.from_file(WORDS), UnitEncoder(WORDS)
    own.most_kept = 3_000
    letters = [chr(c) for c in range(0x21, 0x250) if not chr(c).isspace()]
    texts = [f"{c}x A{c}b {c} {c}{c}.\n1{c}'{c.upper()}'S H\u0331{c} {c}<|endoftext|>{c} {c}\u0301 '{c}'re" for c in letters]
    rng = random.Random(8)
    texts += [" ".join("".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(12)) for _ in range(500)]
    for text, found in zip(texts, own.encode(texts)):
        assert found.tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)
    for text in texts:
        assert own.encode([text])[0].tolist() == library.encode(text, add_special_tokens=False).ids, repr(text)


def test_codec_equals_the_library():
    library, own = Tokenizer.from_file(WORDS), bpe.codec(WORDS)
    rng = random.Random(5)
    texts = noise(2_000, seed=3) + ["".join(rng.choice("aeiorstlnthABC'") for _ in range(rng.randrange(45))) for _ in range(2_000)]
    for text in texts:
        expected = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == expected, repr(text)
        assert own.decode(expected) == library.decode(expected, skip_special_tokens=False)


def test_codec_caches_may_turn_over():
    own = bpe.SpeculativeBpe(WORDS)
    own.MOST_KEPT = 6
    texts = noise(200, seed=4)
    assert [own.digests(t) for t in texts + texts] == [bpe.codec(WORDS).digests(t) for t in texts + texts]


def test_codec_columns_round_trip(spark):
    rows = awkward()
    found = bpe.decode_ids(bpe.encode_texts(documents(spark, rows), WORDS), WORDS).select("text", "ids", "decoded").collect()
    library = Tokenizer.from_file(WORDS)
    assert len(found) == len(rows)
    for r in found:
        assert list(r.ids) == library.encode(r.text or "", add_special_tokens=False).ids
        assert r.decoded == library.decode(list(r.ids), skip_special_tokens=False)


def test_digests(spark):
    rows = awkward()
    found = bpe.token_digests(documents(spark, rows), WORDS).collect()
    library = Tokenizer.from_file(WORDS)
    expected = []
    for i, text, _ in rows:
        e = ids(WORDS, text or "")
        expected.append((i, len(e), sha256(" ".join(map(str, e))), sha256(library.decode(e, skip_special_tokens=False))))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    assert bpe.token_digests(documents(spark, []), WORDS).count() == 0


@pytest.mark.parametrize(
    "values", [[5], [7] * 100, [0, 2**32 - 1], list(range(9_000)), [1] * 500 + [2**31] * 3, [2**32 - 1] * 4]
)
def test_blocks_round_trip(values):
    values = np.array(values, np.uint32)
    assert (tokenfile.decode_block(tokenfile.encode_block(values)) == values).all()


def test_outliers_are_exceptions():
    values = np.array([3] * 990 + [2**30] * 10, np.uint32)
    assert len(tokenfile.encode_block(values)) == 16 + 10 * 8


def test_token_files(spark):
    rows = awkward()
    manifest = tokenfile.write_token_files(documents(spark, rows).repartition(3), WORDS)
    found = sorted(tokenfile.read_token_files(manifest).collect(), key=lambda r: r.start)
    keys = [r.doc_id for r in found]
    assert keys == sorted((i for i, _, _ in rows), key=lambda i: (i is not None, i or 0))
    start, texts = 0, {i: t for i, t, _ in rows}
    for r in found:
        expected = np.array([*ids(WORDS, texts[r.doc_id] or ""), 1], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(expected), zlib.crc32(expected.tobytes()))
        start += len(expected)
    empty = tokenfile.write_token_files(documents(spark, []), WORDS)
    assert tokenfile.read_token_files(empty).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins, offsets, fills = packing.best_fit(np.array([6, 5, 4, 3, 2]), 10)
    assert fills.tolist() == [10, 10] and bins.tolist() == [0, 1, 0, 1, 1] and offsets.tolist() == [0, 0, 6, 5, 8]


@pytest.mark.parametrize("n,expected", [(0, []), (3, [(0, 3)]), (4, [(0, 4)]), (9, [(0, 1), (1, 4), (5, 4)]), (8, [(0, 4), (4, 4)])])
def test_cut(n, expected):
    assert packing.cut(n, 4) == expected


def test_packing(spark):
    rows = awkward() + [(100 + k, "word " * (7 * k % 300), "en") for k in range(300)]
    found = packing.pack_documents(documents(spark, rows).repartition(40), BYTES).collect()
    texts = {i: t for i, t, _ in rows}
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, pieces in by_doc.items():
        expected = np.array([*ids(BYTES, texts[i] or ""), 2], "<u4")
        copies = sum(j == i for j, _, _ in rows)
        pieces.sort(key=lambda r: r.piece)
        assert sum(r.length for r in pieces) == copies * len(expected)
        for r in pieces:
            assert r.ids_crc32 == zlib.crc32(expected[r.start : r.start + r.length].tobytes())
    for pieces in by_sequence.values():
        pieces.sort(key=lambda r: r.offset)
        assert [r.offset for r in pieces] == np.cumsum([0] + [r.length for r in pieces])[:-1].tolist()
        assert sum(r.length for r in pieces) <= 1024
    # Hardly more sequences than the tokens need, though the rows came in 40 partitions.
    assert len(by_sequence) <= 1.1 * sum(r.length for r in found) / 1024 + 2
    assert packing.pack_documents(documents(spark, []), BYTES).count() == 0
