"""Fill-in-middle against plain slicing of decoded texts."""

import hashlib
import random

import pytest
from fixtures import awkward, documents
from pyspark.sql import functions as F

from shopfloor.llm import fim


def plainly(i, text):
    """(n, form, prefix_chars, middle_chars, output) by the definition."""
    text = text or ""
    h = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    a, b, keep, swap = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    n = len(text)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or keep % 100 >= 90:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    p, m, s = text[:low], text[low:high], text[high:]
    if swap % 100 < 20:
        return n, "spm", low, high - low, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", low, high - low, f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize(
    "text",
    ["", "a", "é", "🙂", "plain", "aé日🙂" * 5, "x" * 200_000, "é" * 90_000, "日本語 " * 40_000, "a" * 65_535 + "é" * 3 + "b" * 70_000],
)
def test_boundaries(text):
    cuts = fim.BoundarySet(text.encode())
    assert len(cuts) == len(text)
    rng = random.Random(1)
    for k in {0, len(text), *(rng.randrange(len(text) + 1) for _ in range(200))}:
        assert cuts.offset(k) == len(text[:k].encode())


def test_containers_of_all_kinds():
    rng = random.Random(2)
    mixed = "".join(rng.choice("aé") for _ in range(50_000))
    text = "a" * 65_536 + mixed + "🙂" * 30_000
    cuts = fim.BoundarySet(text.encode())
    assert {type(c) for c in cuts.containers} >= {fim._Runs, fim._Bitmap}
    assert type(fim.BoundarySet("🙂".encode() * 10).containers[0]) is fim._Array
    for k in rng.sample(range(len(text)), 400):
        assert cuts.offset(k) == len(text[:k].encode())


def test_rows(spark, monkeypatch):
    monkeypatch.setattr(fim, "BATCH_BYTES", 50)
    rng = random.Random(5)
    rows = awkward() + [(100 + k, "".join(rng.choice("aé日🙂<>PSM \n") for _ in range(k % 60)), "en") for k in range(400)]
    rows += [(900, "<<P", "en"), (901, "a<P>b", "en"), (902, "<S", "en"), (903, "><M<", "en"), (904, "\0\0x", "en")]
    docs = documents(spark, rows).withColumn("form", F.lit("clash"))
    found = fim.fill_in_middle(docs).withColumn("back", fim.restored()).collect()
    expected = [(i, *plainly(i, t), t or "") for i, t, _ in rows]
    order = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, found), key=order) == sorted(expected, key=order)
    assert {r.form for r in found} == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(documents(spark, [])).count() == 0
