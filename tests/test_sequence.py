import random
import re

from conftest import spread, whole
from pyspark.sql import functions as F
from shopfloor.operators import sequence, signals
from shopfloor.operators.capability import histogram
from shopfloor.operators.charts import control_chart, violation_summary
from shopfloor.operators.normality import shapiro_wilk
from shopfloor.operators.rules import with_rules
from shopfloor.operators.sequence import (
    attach_group,
    chunked,
    dense_sequence,
    join_groups,
    join_on,
    running_sum,
)

ROWS = [("hot", i, (i * 7919) % 1000) for i in range(300)] + [("cold", i, i) for i in range(5)] + [(None, 1, 1), (None, 2, 2)]


def frame(spark, rows=ROWS):
    # repartitioned so that the range path sees unsorted, spread input
    return spark.createDataFrame(rows, "k string, id long, v long").repartition(6, "v")


def test_dense_sequence_numbers_every_group_in_order(spark, mode):
    got = dense_sequence(frame(spark), ["k"], [F.col("v").desc(), "id"]).collect()
    expected = {}
    for k in ("hot", "cold", None):
        ordered = sorted((r for r in ROWS if r[0] == k), key=lambda r: (-r[2], r[1]))
        expected.update({(k, r[1]): i for i, r in enumerate(ordered)})
    assert {(r.k, r.id): r.seq for r in got} == expected


def test_dense_sequence_without_keys(spark, mode):
    got = dense_sequence(frame(spark).where("k is not null"), [], ["k", "id"]).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(305))
    assert [(r.k, r.id) for r in got] == sorted((r[0], r[1]) for r in ROWS if r[0])


def test_running_sum(spark, mode):
    rows = dense_sequence(frame(spark), ["k"], ["id"])
    got = {(r.k, r.id): r.total for r in running_sum(rows, ["k"], "seq", {"total": F.col("v")}).collect()}
    for k in ("hot", "cold", None):
        total = 0
        for r in sorted(r for r in ROWS if r[0] == k):
            total += r[2]
            assert got[(k, r[1])] == total


def test_chunks_are_bounded_and_led_in(spark):
    spread(spark, 20)
    try:
        rows = spark.range(105).select(F.lit("a").alias("k"), F.col("id").alias("seq"))
        cut, partition = chunked(rows, ["k"], "seq", 14)
        groups = spark.sql("select 'a' as k, 7 as limit_value")
        joined = attach_group(cut, groups, ["k"])
        by_chunk = {}
        for r in joined.collect():
            by_chunk.setdefault(r["_chunk"], []).append((r.seq, r["_own"]))
    finally:
        whole(spark)
    assert partition == ["k", "_chunk"] and sorted(by_chunk) == list(range(6))
    for chunk, rows in by_chunk.items():
        own = sorted(s for s, mine in rows if mine)
        lead = sorted(s for s, mine in rows if not mine)
        assert own == list(range(chunk * 20, min(105, chunk * 20 + 20)))
        assert lead == (list(range(chunk * 20 - 14, chunk * 20)) if chunk else [])


def test_join_groups_keeps_hot_rows_whole(spark, mode):
    groups = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, g int")
    inner = join_groups(frame(spark), groups, ["k"])
    assert inner.groupBy("k", "g").count().orderBy("k").collect() == [("cold", 2, 5), ("hot", 1, 300)]
    left = join_groups(frame(spark), groups, ["k"], "left")
    assert left.count() == 307 and left.where("g is null").count() == 2


def test_join_on_matches_null_keys(spark):
    left = spark.createDataFrame([(None, 1), ("a", 2)], "k string, x int")
    right = spark.createDataFrame([(None, 10), ("b", 20)], "k string, y int")
    assert sorted(join_on(left, right, ["k"]).collect()) == [(None, 1, 10)]
    assert {tuple(r) for r in join_on(left, right, ["k"], "left").collect()} == {(None, 1, 10), ("a", 2, None)}


def awkward_points(spark):
    """Streams with a null name, null readings in chunk-filling numbers, a NaN and a single point."""
    rows = [(k, i, None if k == "gaps" and i % 2 else float(i * i % 7)) for k in ("gaps", None, "full") for i in range(40)]
    rows += [("nan", i, float("nan") if i == 3 else 1.0 * i) for i in range(6)] + [("one", 0, 1.0)]
    return spark.createDataFrame(rows, "k string, i long, value double")


def test_chunks_change_no_row(spark):
    """Charts, runs, histograms and normality: the same rows whether groups are cut or not."""
    df = awkward_points(spark).withColumn("row_id", F.col("i"))

    def everything():
        chart = control_chart(df, "I-MR", ["k"], order=["i"], carry=["i"])
        sensors = signals.signal_charts(df, ["k"])
        finite = df.where("k is null or k != 'nan'")
        frames = [chart.limits, chart.points, sensors.limits, sensors.points, violation_summary(chart)]
        frames += [signals.present_runs(df, "i", ["k"]), histogram(finite, ["k"]), shapiro_wilk(finite, ["k"], "value", "i")]
        return [sorted(map(repr, f.collect())) for f in frames]

    plain = everything()
    spread(spark, 16)
    try:
        cut = everything()
    finally:
        whole(spark)
    assert [len(x) for x in plain] == [len(x) for x in cut]
    rounded = lambda rows: [re.sub(r"(\d\.\d{9})\d*", r"\1", r) for r in rows]
    assert list(map(rounded, plain)) == list(map(rounded, cut))
    limits, points, runs, bins = plain[0], plain[1], plain[5], plain[6]
    assert len(points) == 40 * 3 + 6 + 1 and sum("k=None" in r for r in points) == 40
    assert sum("k='nan'" in r and "not_finite" in r for r in limits) == 1
    assert sum("k=None" in r for r in runs) == 40
    assert any("k=None" in r and "n_values=0" not in r for r in bins)


def test_rules_cost_one_exchange(spark):
    rows = spark.range(100).select(F.lit("a").alias("k"), F.col("id").alias("idx"), F.rand(1).alias("x"), F.lit(0.5).alias("c"), F.lit(0.2).alias("s"))
    # the group key must not be a constant, or the planner drops the partitioning
    rows = rows.withColumn("k", F.when(F.col("idx") % 2 == 0, "a").otherwise("b"))
    plan = with_rules(rows, ["k"], "idx", "x", "c", "s")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1


def test_windows_never_run_over_a_whole_stream(spark, mode):
    rows = spark.createDataFrame([("a", i, random.Random(i).random()) for i in range(50)], "k string, idx long, x double")
    cut, partition = chunked(rows, ["k"], "idx")
    assert partition == ["k", "_chunk"]
    assert cut.where("_own").count() == 50


def test_rows_of_a_task_are_bounded_by_their_number(spark, monkeypatch):
    """Sorted sensor rows compress many times over, so tasks are cut by rows and not by bytes; segments move them once."""
    staged, stage = {}, sequence.stage
    monkeypatch.setattr(sequence, "stage", lambda df, label: staged.setdefault(label, stage(df, label)))
    monkeypatch.setattr(sequence, "ROWS_A_TASK", 1000)
    spark.conf.set("shopfloor.chunkRows", "500")
    try:
        df = spark.range(40000).select(F.lit("a").alias("k"), F.col("id").alias("row_id"), F.when(F.col("id") % 7 > 0, 5.0).alias("value"))
        tasks = sequence.tasks_for(spark, df.count())
        numbered = sequence.dense_sequence(df, ["k"], ["row_id"], out="i", tasks=tasks)
        sizes = [r["count"] for r in staged["sequence"].groupBy(F.input_file_name()).count().collect()]
        assert tasks == 40 and max(sizes) <= 2500 and "spans" in staged
        runs = signals.present_runs(numbered, "i", ["k"])
        plan = runs._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hash" not in plan and "Window" not in plan
        assert {(r.row_id, r.run) for r in runs.collect()} == {(i, i // 7) for i in range(40000) if i % 7}
    finally:
        spark.conf.unset("shopfloor.chunkRows")
