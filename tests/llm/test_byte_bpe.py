"""Byte-level BPE against the tiktoken library."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from fixtures import awkward, documents
from pyspark.sql import functions as F

from shopfloor.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
PIECES = ["a", "B", "é", " ", "  ", "\n", "\n\n", "\t", "\x85", "'s", "1", "23", "!!", "日本", "\x1c", "\0", "İ", "　", "x" * 40]
PIECES += ["\r\n", "🙂", "‍", "'", " 's", "tion", "THE", "est", "abababab", "aaaa", "́", "٣", "½"]


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=byte_bpe.codec(PATH, PATTERN).ranks, special_tokens={})


def noise(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randrange(14))) for _ in range(n)]


def test_queue_gives_the_lowest_rank_first():
    rng = random.Random(1)
    queue, expected = byte_bpe.RankQueue(50_000), {}
    for at in range(3_000):
        rank = rng.choice([0, 63, 64, 4095, 4096, 49_999, rng.randrange(50_000)])
        queue.push(rank, np.array([at]))
        expected.setdefault(rank, []).append(at)
    for rank in sorted(expected):
        found, places = queue.pop()
        assert found == rank and places.tolist() == expected[rank]
    assert queue.pop() is None


def test_codec_equals_the_library(library):
    own = byte_bpe.codec(PATH, PATTERN)
    texts = noise(3_000, seed=2) + [None, "", "".join(map(chr, range(1, 0xD800, 7)))]
    for text, found in zip(texts, own.encode(texts)):
        assert found.tolist() == library.encode_ordinary(text or ""), repr(text)
        assert own.decode(found) == (text or "").encode()


@pytest.mark.parametrize("text", ["a" * 30_001, "ab" * 20_000, "日本" * 9_000, " " * 9_000, "\n" * 4_001 + "x", "=-" * 9_000])
def test_very_long_pre_tokens(library, text):
    assert byte_bpe.codec(PATH, PATTERN).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_random_long_pre_tokens(library):
    rng = random.Random(7)
    for letters in ("ab", "etaoin", "aé"):
        text = "".join(rng.choice(letters) for _ in range(20_000))
        assert byte_bpe.codec(PATH, PATTERN).encode([text])[0].tolist() == library.encode_ordinary(text)


def test_a_merge_that_makes_a_lower_rank(tmp_path):
    """Ranks in no order of training: AB makes ABA, of a lower rank, which must go before the next AB."""
    ranks = {bytes([b]): 10 + b for b in range(256)} | {b"AB": 300, b"ABA": 5, b"ABAB": 7, b"BAB": 301}
    path = tmp_path / "odd.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = byte_bpe.ByteBpe(str(path), PATTERN)
    odd = tiktoken.Encoding("odd", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(4)
    texts = ["ABABAB", "ABAB", "ABABABABCABAB"] + ["".join(rng.choice("ABC ") for _ in range(30)) for _ in range(300)]
    assert [i.tolist() for i in own.encode(texts)] == [odd.encode_ordinary(t) for t in texts]


def test_a_full_cache_changes_nothing(library):
    own = byte_bpe.ByteBpe(PATH, PATTERN, most_kept=20)
    for text in noise(200, seed=3):
        assert own.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_unknown_ids_are_refused():
    with pytest.raises(ValueError, match="no rank"):
        byte_bpe.codec(PATH, PATTERN).decode(np.array([60_000]))


def test_round_trip(spark, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "ROWS_CHARS", 100)
    rows = awkward()
    found = byte_bpe.round_trip(documents(spark, rows), PATH, PATTERN).collect()
    expected = []
    for i, text, _ in rows:
        ids = np.array(library.encode_ordinary(text or ""), "<u4").tobytes()
        expected.append((i, hashlib.sha256(ids).hexdigest(), (text or "").encode()))
    order = lambda r: (r[0] is None, r[0] or 0)
    assert sorted(((r.doc_id, hashlib.sha256(r.ids).hexdigest(), bytes(r.decoded)) for r in found), key=order) == sorted(expected, key=order)
    assert byte_bpe.round_trip(documents(spark, []), PATH, PATTERN).count() == 0


def test_columns(spark, library):
    rows = awkward()
    docs = documents(spark, rows).withColumn("ids", F.lit("clash"))
    coded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs, PATH, PATTERN), PATH, PATTERN)
    found = coded.select("text", "ids", "decoded").collect()
    assert len(found) == len(rows)
    for r in found:
        assert list(r.ids) == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
