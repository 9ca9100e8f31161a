import pytest
from pyspark.sql import functions as F
from shopfloor.operators import signals
from shopfloor.plans import pipelines

GAP = None
# A gap inside a sensor: a position counted over present values only must still point at the right unit.
FIXTURE = {
    "spiky": [5.0, 5.1, 4.9, 5.1, 4.9, 5.0, 5.1, 4.9, 5.0, 5.1, 4.9, 8.0],
    "gapped": [5.0, 5.1, 4.9, GAP, 5.1, 4.9, 5.0, 5.1, 8.0, 5.0, 5.1, 4.9],
    "calm": [2.0, 2.1, 1.9, 2.1, 1.9, 2.0, 2.1, 1.9, 2.1, 1.9, 2.0, 2.1],
    "stuck": [7.0] * 12,
}


def long(spark, columns):
    rows = [(i, name, None if v is None else float(v)) for name, vs in columns.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "row_id long, signal string, value double")


def labels(spark, failed, n):
    return spark.createDataFrame([(i, 1 if i in failed else -1) for i in range(n)], "row_id long, label int")


def test_pareto_blames_the_right_unit(spark, mode):
    """Units 8 and 11 failed. By hand: spiky has mean 5.25 and mean range 0.418, so unit 11 is beyond three
    sigma and unit 8 the ninth below the mean; gapped has mean 5.28 and, over nine ranges that skip the gap,
    0.767, so unit 8 (its eighth value) is beyond three sigma; calm breaks no rule."""
    study = pipelines.sensor_study(long(spark, FIXTURE), labels(spark, {8, 11}, 12), signals.ScreeningCriteria(min_present=5))
    got = [tuple(r) for r in study.pareto.orderBy("cumulative_pct", "signal").collect()]
    assert [g[:2] for g in got] == [("spiky", 2), ("gapped", 1)]
    assert [round(x, 3) for g in got for x in g[2:]] == [66.667, 66.667, 33.333, 100]
    assert {r.signal: r.reason for r in study.audit.collect()}["stuck"] == "constant"


def test_moving_ranges_stop_at_gaps(spark, mode):
    df = long(spark, {"a": [1, GAP, 4, 6, GAP, GAP, 7], "lonely": [GAP, 3, GAP, 8, GAP, GAP, GAP]})
    chart = signals.signal_charts(df)
    limits = {r.signal: r for r in chart.limits.collect()}
    assert limits["a"].mrbar == 2 and limits["a"].center == 4.5 and limits["a"].n_points == 4
    assert limits["lonely"].mrbar == 0 and limits["lonely"].status == "zero_sigma"
    runs = signals.present_runs(df.withColumn("pos", F.col("row_id")), "pos").where("signal = 'a'").orderBy("row_id")
    assert [(r.row_id, r.run) for r in runs.collect()] == [(0, 0), (2, 1), (3, 1), (6, 2)]


def test_autocorrelation_spans_gaps(spark, mode):
    values = [1, 2, GAP, 3, 4, 5, 6, 7, 8, GAP, 9, 10]
    got = signals.autocorrelation(signals.signal_charts(long(spark, {"a": values, "flat": [2] * 12}))).collect()
    present = [v for v in values if v is not None]
    mean = sum(present) / len(present)
    c = [v - mean for v in present]
    r = sum(x * y for x, y in zip(c, c[1:])) / sum(x * x for x in c)
    by = {g.signal: g for g in got}
    assert by["a"].lag1_autocorr == pytest.approx(r) and by["a"].autocorr_flag and by["a"].n_used == 10
    assert by["flat"].lag1_autocorr == 0 and not by["flat"].autocorr_flag


def test_audit_reasons_and_boundaries(spark, mode):
    columns = {
        "at_floor": [float(i) for i in range(100)] + [GAP] * 100,
        "below_floor": [float(i) for i in range(99)] + [GAP] * 101,
        "constant": [5] * 200,
        "nzv": [1] * 190 + [2] * 10,
        "ratio_just_below": [1] * 189 + [2] * 10 + [3],
        "ties": [1, 2] * 100,
        "empty": [GAP] * 200,
    }
    got = {r.signal: r for r in signals.screening_audit(long(spark, columns)).collect()}
    assert {k: r.reason for k, r in got.items()} == {
        "at_floor": "ok", "below_floor": "too_missing", "constant": "constant", "nzv": "near_zero_variance",
        "ratio_just_below": "ok", "ties": "ok", "empty": "too_missing",
    }
    assert got["nzv"].freq_ratio == 19 and got["nzv"].percent_unique == 0.01 and got["constant"].freq_ratio == float("inf")
    assert got["ties"].freq_ratio == 1 and got["at_floor"].n_distinct == 100 and got["at_floor"].missing_frac == 0.5
    assert got["empty"].variance == 0 and got["empty"].percent_unique == 0 and got["empty"].n_distinct == 0
    missing = {r.signal: r.n_missing for r in signals.missingness(long(spark, columns)).collect()}
    assert missing["at_floor"] == 100 and missing["empty"] == 200


def test_yield(spark):
    df = labels(spark, set(range(104)), 1567)
    (y,) = signals.yield_summary(df).collect()
    assert (y.n_total, y.n_pass, y.n_fail, y.status) == (1567, 1463, 104, "ok")
    assert y.yield_pct == pytest.approx(93.363, abs=1e-3) and y.dppm == pytest.approx(66368.86, abs=1e-2)
    assert signals.yield_summary(df.where("row_id < 0")).count() == 0
    assert signals.yield_summary(df.withColumn("label", F.lit(0))).first().status == "bad_label"


def test_signal_capability_statuses(spark):
    df = long(spark, {"a": FIXTURE["spiky"], "b": FIXTURE["calm"], "c": [5] * 12})
    spec = spark.createDataFrame([("a", 1.0, 9.0), ("b", None, None), ("c", 1.0, None)], "signal string, lsl double, usl double")
    got = {r.signal: r for r in signals.signal_capability(df, signals.signal_charts(df), spec).collect()}
    assert got["a"].status == "ok" and not got["a"].stable and "nelson signal(s)" in got["a"].stability_warning and got["a"].cp > 0
    assert got["b"].status == "no_limits" and got["c"].status == "zero_sigma" and got["c"].cpk is None
