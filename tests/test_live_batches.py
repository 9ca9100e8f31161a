"""The monitor that spreads its micro-batches, against a plain restatement and its batch twin."""

import os

import numpy as np
import pytest
from compare import connect, difference
from conftest import SMALL
from pyspark.sql import GroupedData
from pyspark.sql import functions as F
from shopfloor.functions import fixed
from shopfloor.plans import catalog, catalog_sql
from shopfloor.streaming import live


def expected(values, size, rule_set, window):
    """(subgroup, n_points, center, violations) of every complete subgroup, one at a time."""
    groups = np.array(values[: len(values) // size * size]).reshape(-1, size)
    for k in range(len(groups)):
        seen = groups[max(0, k + 1 - window) : k + 1]
        means = seen.mean(axis=1)
        if size == 1 and len(means) < 2:
            continue
        spread = np.abs(np.diff(means)).mean() if size == 1 else (seen.max(axis=1) - seen.min(axis=1)).mean()
        d2 = fixed.IMR_SIGMA if size == 1 else {r[0]: r[4] for r in fixed.XBAR_R}[size]
        yield k + 1, len(means), means.mean(), live.count_violations(means, means.mean(), spread / d2 / size**0.5, rule_set)


@pytest.mark.parametrize(("size", "rule_set", "window"), [(5, "we", 50), (1, "nelson", 20)])
def test_every_chart_over_several_batches(spark, mode, tmp_path, size, rule_set, window):
    rng = np.random.default_rng(4)
    rows = [(s, k, float(v)) for s, n in (("a", 400), (None, 60), ("b", 3)) for k, v in enumerate(rng.normal(size=n))]
    rows += [("a", 400, None), ("a", 401, float("nan"))]
    frame = spark.createDataFrame(rows, "stream string, row_id long, value double")
    frame = frame.withColumn("ts", F.timestamp_seconds(F.floor(F.col("row_id") / 7)))
    source, out = tmp_path / "in", str(tmp_path / "out")
    for low, high in ((0, 33), (33, 300), (300, 500)):
        frame.where((F.col("row_id") >= low) & (F.col("row_id") < high)).repartition(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    query = live.monitor_in_batches(stream, size, out, str(tmp_path / "ck"), rule_set=rule_set, window=window).trigger(availableNow=True).start()
    query.awaitTermination()
    assert len(query.recentProgress) >= 3 and not any(p.stateOperators for p in query.recentProgress)
    got = {}
    for r in spark.read.schema(live.OUTPUT).parquet(out).collect():
        got.setdefault(r.stream, []).append((r.subgroup, r.n_points, r.center, r.violations))
    for name in {r[0] for r in rows}:
        wanted = list(expected([r[2] for r in rows if r[0] == name and r[2] is not None and r[2] == r[2]], size, rule_set, window))
        found = sorted(got.get(name, []))
        assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in wanted]
        assert [r[2] for r in found] == pytest.approx([r[2] for r in wanted])
    assert len(list((tmp_path / "ck" / "charts").iterdir())) == 2


def test_the_query_keeps_no_stream_in_one_task(spark, mode, monkeypatch):
    def gathered(*_, **__):
        raise AssertionError("a stream's rows of a batch meet in one task")

    monkeypatch.setattr(GroupedData, "applyInPandasWithState", gathered)
    got = catalog.live_monitor_xbar_r(spark, SMALL).toPandas()
    twin = connect(SMALL).execute(catalog_sql.all_sql()["live_monitor_xbar_r"]).df()
    assert difference(got, twin) is None


def arrivals(spark, folder, batches):
    """One file a batch of (stream, row_id, seconds, value), in the order given."""
    for k, rows in enumerate(batches):
        frame = spark.createDataFrame(rows, "stream string, row_id long, s long, value double").withColumn("ts", F.timestamp_seconds("s")).drop("s")
        frame.repartition(1).write.mode("append").parquet(str(folder))
        files = [f for f in folder.glob("part-*") if not f.name.startswith("part-k")]
        for f in files:
            f.rename(folder / f"part-k{k:03d}.parquet")
            stamp = 1_700_000_000 + k  # a file source takes the oldest file first
            os.utime(folder / f"part-k{k:03d}.parquet", (stamp, stamp))
    return frame.schema


def run_monitor(spark, tmp_path, schema, size=5, window=8, **more):
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out, late = str(tmp_path / "out"), str(tmp_path / "late")
    query = live.monitor_in_batches(stream, size, out, str(tmp_path / "ck"), window=window, late=late, **more).trigger(availableNow=True).start()
    query.awaitTermination()
    charts = spark.read.schema(live.OUTPUT).parquet(out).collect()
    return sorted(((r.stream or "", r.subgroup, r.n_points, r.center, r.violations) for r in charts), key=lambda r: r[:2]), spark.read.schema(schema).parquet(late)


def test_shuffled_arrival_gives_the_charts_of_ordered_arrival(spark, mode, tmp_path):
    rng = np.random.default_rng(8)
    rows = [(s, k, k // 2, float(rng.normal())) for s, n in (("a", 120), (None, 90)) for k in range(n)]
    # A row comes up to 20 seconds after its time, and so after rows that are later.
    coming = sorted(rows, key=lambda r: r[2] + rng.uniform(0, 20))
    third = len(coming) // 3
    closing = [("end", 0, 10_000, 0.0)]
    schema = arrivals(spark, tmp_path / "in", [coming[:third], coming[third : 2 * third]])
    run_monitor(spark, tmp_path, schema, delay="20 seconds")
    later = tmp_path / "more"
    arrivals(spark, later, [coming[2 * third :], closing])
    for k, f in enumerate(sorted(later.glob("part-k*"))):  # the query is started again from its checkpoint
        target = tmp_path / "in" / f"part-k{k + 2:03d}.parquet"
        target.write_bytes(f.read_bytes())
        os.utime(target, (1_700_000_002 + k, 1_700_000_002 + k))
    got, late = run_monitor(spark, tmp_path, schema, delay="20 seconds")
    assert late.count() == 0
    for name, n in (("a", 120), (None, 90)):
        wanted = list(expected([r[3] for r in rows if r[0] == name], 5, "we", 8))
        found = [r[1:] for r in got if r[0] == (name or "")]
        assert [(r[0], r[1], r[3]) for r in found] == [(r[0], r[1], r[3]) for r in wanted]
        assert [r[2] for r in found] == pytest.approx([r[2] for r in wanted])


def test_late_rows_are_set_aside_and_idle_streams_forgotten(spark, tmp_path):
    first = [("a", k, k, 1.0 * k) for k in range(6)] + [("b", k, k, 1.0 * k) for k in range(4)]
    second = [("a", k, 100 + k, 2.0) for k in range(6, 10)]
    third = [("a", 99, 3, 7.0), ("a", 98, 101, 2.0), ("b", 50, 200, 1.0), ("b", 51, 201, 3.0)]
    fourth = [("c", 0, 300, 0.0), ("a", 97, None, 5.0)]
    schema = arrivals(spark, tmp_path / "in", [first, second, third, fourth])
    got, late = run_monitor(spark, tmp_path, schema, size=2, delay="10 seconds", idle="50 seconds")
    # The watermark was 93 when 98 and 99 came, at 101 and at 3; 97 has no time at all.
    assert sorted(r.row_id for r in late.collect()) == [97, 99]
    found = {s: [r[1] for r in got if r[0] == s] for s in "abc"}
    # Both were idle for 50 seconds before the watermark when they came back, so they count from 1 again.
    assert found == {"a": sorted([1, 2, 3, 1, 2]), "b": sorted([1, 2, 1]), "c": []}


def test_rows_before_any_watermark_wait(spark):
    empty = spark.createDataFrame([], "stream string, ts timestamp, value double")
    split = live.released(empty, empty, None, "ts", "1 minute")
    assert split.watermark is None and split.ready.count() == split.waiting.count() == split.late.count() == 0


def test_the_options_that_go_together(spark):
    for wrong in ({"delay": "1 minute"}, {"late": "x"}, {"idle": "1 minute"}):
        with pytest.raises(ValueError, match="go together|needs a delay"):
            live.monitor_in_batches(spark.range(1), 5, "o", "c", **wrong)
