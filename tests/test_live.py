"""The streaming monitor against its batch twin."""

import pytest
from conftest import SMALL
from pyspark.sql import functions as F
from shopfloor.operators.charts import violation_summary
from shopfloor.plans import views
from shopfloor.streaming.live import last_window_rows, live_monitor, live_snapshot


@pytest.mark.parametrize(("size", "rule_set", "window"), [(5, "we", 50), (1, "nelson", 50), (3, "nelson", 20)])
def test_last_emission_equals_the_batch_snapshot(spark, tmp_path, size, rule_set, window):
    events = views.table(spark, SMALL, "events").select(
        F.col("event_type").alias("stream"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "value"
    )
    numbered = events.withColumn("part", F.ntile(3).over(__import__("pyspark").sql.Window.orderBy("ts", "row_id")))
    source = tmp_path / "in"
    for part in (1, 2, 3):
        numbered.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(source))
    name = f"live_{size}_{window}"
    query = (
        live_monitor(stream, size, rule_set=rule_set, watermark="1 hour", window=window)
        .writeStream.outputMode("append")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", str(tmp_path / "ck"))
        .start()
    )
    try:
        query.processAllAvailable()
        assert len(query.recentProgress) >= 3
    finally:
        query.stop()
    out = spark.table(name)
    per_stream = {r.stream: r for r in out.groupBy("stream").agg(F.max_by(F.struct("*"), "subgroup").alias("last")).select("last.*").collect()}
    counts = {r.event_type: r["count"] for r in views.table(spark, SMALL, "events").groupBy("event_type").count().collect()}
    assert out.count() == sum(n // size - (size == 1) for n in counts.values())

    chart = live_snapshot(views.spc_var(spark, SMALL), size, rule_set=rule_set, window=window)
    events_seen = {r.stream: r.violation_events for r in violation_summary(chart).collect()}
    for r in chart.limits.collect():
        live = per_stream[r.stream]
        assert live.n_points == r.n_points == min(window, counts[r.stream] // size)
        for column in ("center", "sigma_hat", "ucl", "lcl"):
            assert live[column] == pytest.approx(r[column], rel=1e-9)
        assert live.violations == events_seen[r.stream]


def test_snapshot_takes_only_complete_subgroups(spark):
    rows = spark.range(23).select(F.lit("a").alias("stream"), F.col("id").alias("seq"), F.col("id").cast("double").alias("value"))
    got = last_window_rows(rows, 5, window=2).orderBy("seq").collect()
    assert [r.seq for r in got] == list(range(10, 20)) and [r.subgroup for r in got] == [1] * 5 + [2] * 5


def test_bad_parameters(spark):
    with pytest.raises(ValueError, match="subgroup_size"):
        live_monitor(spark.range(1), 11)
    with pytest.raises(ValueError, match="rule_set"):
        live_monitor(spark.range(1), 5, rule_set="x")
