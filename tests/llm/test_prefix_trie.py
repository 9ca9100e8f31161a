"""The prefix trie against a plain construction."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from shopfloor.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"


def modulo(a, b):
    """The remainder with the sign of a, as SQL has it."""
    return a - b * int(a / b)


def plainly(rows, lead):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            own.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    whole = dict(own)
    if lead:
        for c, turns in own.items():
            h = zlib.crc32(str(c).encode()) % lead[1]
            whole[c] = own.get(c - modulo(c, lead[0]), [])[:h] + turns[h:]
    members = {}
    for c in sorted(whole):
        for d in range(len(whole[c]) + 1):
            members.setdefault(tuple(whole[c][:d]), []).append(c)
    found = []
    for node, convs in members.items():
        below = [n for n in members if n[: len(node)] == node]
        parents = {n[:-1] for n in members if n}
        ends = ",".join(str(c) for c in convs if len(whole[c]) == len(node))
        found.append(
            (
                convs[0],
                len(node),
                members[node[:-1]][0] if node else None,
                len(convs),
                sum(len(n) == len(node) + 1 for n in below),
                sum(n not in parents for n in below),
                sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n),
                hashlib.sha256(ends.encode()).hexdigest(),
            )
        )
    return sorted(found, key=str)


def conversations(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for c in [*range(n), *range(200, 200 + n), 1001, 1002, 1103, -5, -100, -103]:
        length = rng.choice([1, 2, 3, 4, 5, 9])
        rows += [(c, t, rng.choice(["user", "user", "system"]), rng.choice(["a", "bé", "🙂cc", ""])) for t in range(length)]
    rows += [(500, t, "user", "same") for t in range(25)] + [(501, t, "user", "same") for t in range(25)]
    rows += [(502, t, "user", "same") for t in range(19)] + [(500, 25, "user", "one more")]
    rows += [(700, None, None, None), (700, None, "b", None), (700, 3, None, "x"), (700, 3, None, "a"), (700, 3, None, "a")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None), (1300, 0, "user", "y"), (1301, 0, "user", "y")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("lead", [None, (100, 6)])
@pytest.mark.parametrize("piece_turns,most_cells", [(1024, 1 << 20), (7, 1 << 12)])
def test_nodes(spark, lead, piece_turns, most_cells):
    rows = conversations(3)
    turns = spark.createDataFrame(rows, SCHEMA).withColumn("depth", F.lit("clash")).withColumn("conv", F.lit(1)).repartition(5)
    found = prefix_trie.prefix_trie(turns, lead, piece_turns=piece_turns, most_cells=most_cells)
    assert sorted(map(tuple, found.collect()), key=str) == plainly(rows, lead)


def test_a_sketch_too_small_screens_nothing_out_but_stays_exact(spark, monkeypatch):
    rows = [(c, t, "user", f"{c % 50} {t // 2}") for c in range(900) for t in range(4)]
    monkeypatch.setattr(prefix_trie, "sketch_bits", lambda n, most: 12)
    found = prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))
    assert sorted(map(tuple, found.collect()), key=str) == plainly(rows, None)


def test_empty(spark):
    assert prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA), (100, 6)).count() == 0
    assert prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "a", "b")], SCHEMA)).count() == 0


def test_estimates_are_never_too_low(spark):
    rng = np.random.default_rng(1)
    digests = rng.integers(-(2**62), 2**62, 3_000)
    digests[:500] = digests[500:1_000]
    rows = [([int(v) for v in part],) for part in np.array_split(digests, 300)]
    cells = prefix_trie.count_min(spark.createDataFrame(rows, "h1 array<long>").repartition(6), 14)
    own = prefix_trie._cells(digests, 14)
    twice = ((cells[own >> 3] >> (own & 7)) & 1).all(axis=0)
    assert twice[:1_000].all() and twice[1_000:].mean() < 0.2


def test_ids_of_one_node_in_several_rows(spark):
    rows = [(1, 5, 5, c) for c in range(-50, 300)] + [(2, 5, 6, 9)]
    ends = spark.createDataFrame(rows, "depth long, h1 long, h2 long, conv long").repartition(9)
    found = {r.depth: r.ends for r in prefix_trie.end_digests(ends).collect()}
    assert found[1] == hashlib.sha256(",".join(map(str, range(-50, 300))).encode()).hexdigest()
    assert found[2] == hashlib.sha256(b"9").hexdigest()


def test_the_lead_must_fit_into_a_piece(spark):
    with pytest.raises(ValueError, match="lead"):
        prefix_trie.prefix_trie(spark.createDataFrame([(1, 0, "a", "b")], SCHEMA), (100, 6), piece_turns=4)
