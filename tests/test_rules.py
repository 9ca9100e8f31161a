"""Run rules against a plain restatement on random series, and boundary pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from shopfloor.operators.rules import with_rules
from shopfloor.operators.sequence import chunked
from shopfloor.streaming.live import count_violations


def restated(points, cl, s):
    """(index, rule) pairs, straight from the wording of the rules."""
    c = [p - cl for p in points]
    out = set()

    def windows(k):
        return [(i, c[i - k + 1 : i + 1], points[i - k + 1 : i + 1]) for i in range(k - 1, len(c))]

    for i, w, _ in windows(1):
        if abs(w[0]) > 3 * s:
            out.add((i, 1))
    for k, t, need, rule in ((3, 2 * s, 2, 2), (5, s, 4, 3)):
        for i, w, _ in windows(k):
            hi, lo = [x for x in w if x > t], [x for x in w if x < -t]
            if (len(hi) >= need and not lo) or (len(lo) >= need and not hi):
                out.add((i, rule))
    for i, w, _ in windows(8):
        if min(w) > 0 or max(w) < 0:
            out.add((i, 4))
        if min(map(abs, w)) > s and max(w) > 0 > min(w):
            out.add((i, 8))
    for i, _, p in windows(6):
        steps = np.diff(p)
        if (steps > 0).all() or (steps < 0).all():
            out.add((i, 5))
    for i, _, p in windows(14):
        steps = np.diff(p)
        if (steps != 0).all() and all(a * b < 0 for a, b in zip(steps, steps[1:])):
            out.add((i, 6))
    for i, w, _ in windows(15):
        if max(map(abs, w)) < s:
            out.add((i, 7))
    return out


def series(seed):
    r = random.Random(seed)
    n, shape = r.randint(1, 60), seed % 6
    if shape == 0:
        return [r.gauss(0, 1) for _ in range(n)]
    if shape == 1:
        return [0.1 * i + r.choice([0, 0, 0.2]) for i in range(n)]
    if shape == 2:
        return [(-1) ** i * (1.2 + r.random()) for i in range(n)]
    if shape == 3:
        return [r.choice([-3.0, -2.0, -1.0, 0.0, 1.0, 2.0, 3.0]) for _ in range(n)]
    if shape == 4:
        return [0.5 * r.random() for _ in range(n)]
    return [2.5 + r.gauss(0, 0.7) for _ in range(n)]


def fired(spark, streams, cl, s, rule_set="nelson"):
    rows = [(k, i, float(x)) for k, pts in streams.items() for i, x in enumerate(pts)]
    df = spark.createDataFrame(rows, "k string, idx long, x double").withColumns({"c": F.lit(cl), "s": F.lit(s)})
    cut, partition = chunked(df, ["k"], "idx")
    got = with_rules(cut, partition, "idx", "x", "c", "s", rule_set).where("_own")
    out = {k: set() for k in streams}
    for r in got.select("k", "idx", F.explode("rules").alias("no")).collect():
        out[r.k].add((r.idx, r.no))
    return out


def test_rules_equal_a_plain_restatement(spark, mode):
    streams = {f"s{i:03d}": series(i) for i in range(300)}
    got = fired(spark, streams, 0.1, 1.0)
    expected = {k: restated(v, 0.1, 1.0) for k, v in streams.items()}
    assert got == expected
    assert {no for v in expected.values() for _, no in v} == set(range(1, 9))


def test_live_counter_equals_the_restatement():
    for seed in range(300):
        pts = series(seed)
        expected = restated(pts, 0.1, 1.0)
        assert count_violations(np.array(pts), 0.1, 1.0, "nelson") == len(expected)
        assert count_violations(np.array(pts), 0.1, 1.0, "we") == len([1 for _, no in expected if no <= 4])


@pytest.mark.parametrize(
    ("points", "expected"),
    [
        ([3.0], set()),
        ([3.0001], {(0, 1)}),
        ([2.5, 0, 2.5], {(2, 2)}),
        ([2.5, -2.5, 2.5], set()),
        ([0.5] * 8, {(7, 4)}),
        ([0.5] * 7 + [0.0], set()),
        ([0.1, 0.2, 0.3, 0.4, 0.5, 0.6], {(5, 5)}),
        ([0.1, 0.2, 0.3, 0.3, 0.4, 0.5], set()),
        ([1.5, -1.5] * 4, {(7, 8)}),
        ([1.0, -1.5] * 4, set()),
    ],
)
def test_boundaries(spark, points, expected):
    assert fired(spark, {"a": points}, 0.0, 1.0)["a"] == expected


def test_rule_sets_and_zero_sigma(spark):
    pts = [0.1 * i for i in range(10)]
    assert fired(spark, {"a": pts}, 0.0, 10.0, "we")["a"] == {(i, 4) for i in (8, 9)}
    assert fired(spark, {"a": pts}, 0.0, 0.0)["a"] == set()
    with pytest.raises(ValueError, match="rule_set"):
        fired(spark, {"a": pts}, 0.0, 1.0, "other")
