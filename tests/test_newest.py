import random

from shopfloor.streaming import live


def test_newest_rows_know_their_position(spark):
    """Short streams are whole, long ones end where they end, and rows without a stream are one."""
    rng = random.Random(2)
    rows = [(s, t, i) for s, n in (("a", 40), ("b", 3), (None, 25)) for i, t in enumerate(sorted(rng.randrange(9) for _ in range(n)))]
    shuffled = rng.sample(rows, len(rows))
    frame = spark.createDataFrame(shuffled, "stream string, ts long, row_id long").repartition(6)
    found = live.newest_rows(frame, 10, ["ts", "row_id"]).collect()
    last = {s: [r for r in rows if r[0] == s][-10:] for s in ("a", "b", None)}
    assert {(r.stream, r.ts, r.row_id) for r in found} == {r for part in last.values() for r in part}
    assert all(r.seq == r.row_id for r in found) and len(found) == 23


def test_snapshot_of_the_newest_equals_that_of_numbered_rows(spark):
    rng = random.Random(6)
    rows = [(s, i, rng.gauss(10, 1)) for s, n in (("a", 333), ("b", 12)) for i in range(n)]
    frame = spark.createDataFrame(rows, "stream string, seq long, value double")
    for size in (1, 5):
        kept = ["stream", "n_points", "center", "ucl", "lcl", "status"]
        numbered = live.live_snapshot(frame, size).limits.select(*kept).collect()
        newest = live.live_snapshot(frame.withColumnRenamed("seq", "at"), size, order=["at"]).limits.select(*kept).collect()
        plain = lambda found: sorted(tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in found)
        assert plain(newest) == plain(numbered)
