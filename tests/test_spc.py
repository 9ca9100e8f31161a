"""Charts, capability and normality on hand-computed inputs."""

import math
import statistics

import pytest
from pyspark.sql import functions as F
from shopfloor.functions import normal
from shopfloor.operators import capability
from shopfloor.operators.charts import control_chart, require_ok, violation_summary
from shopfloor.operators.normality import shapiro_wilk
from shopfloor.plans import reports


def individuals(spark, streams):
    rows = [(k, i + 1, float(x)) for k, xs in streams.items() for i, x in enumerate(xs)]
    return spark.createDataFrame(rows, "stream string, subgroup long, value double")


def one(df, **where):
    for k, v in where.items():
        df = df.where(F.col(k) == v)
    (row,) = df.collect()
    return row.asDict()


def test_individuals_by_hand(spark, mode):
    chart = control_chart(individuals(spark, {"a": [10, 12, 11, 13], "b": [5], "c": [4, 4, 4]}), "I-MR", ["stream"])
    a = one(chart.limits, stream="a")
    mr = 5 / 3
    assert a["center"] == 11.5 and a["mrbar"] == pytest.approx(mr) and a["status"] == "ok"
    assert a["ucl"] == pytest.approx(11.5 + 2.66 * mr) and a["lcl"] == pytest.approx(11.5 - 2.66 * mr)
    assert a["ucl_mr"] == pytest.approx(3.267 * mr) and a["sigma_hat"] == pytest.approx(mr / 1.128)
    assert one(chart.limits, stream="b")["status"] == "too_few_points"
    assert one(chart.limits, stream="b")["center"] is None
    assert one(chart.limits, stream="c")["status"] == "zero_sigma"
    assert [r.mr for r in chart.points.where("stream = 'a'").orderBy("idx").collect()] == [None, 2, 1, 2]
    with pytest.raises(ValueError, match="not computable"):
        require_ok(chart.limits)


@pytest.mark.parametrize(
    ("kind", "spread", "k_mean", "k_high", "k_sigma"),
    [("Xbar-R", 2.0, 1.023, 2.574, 1.693), ("Xbar-S", 1.0, 1.954, 2.568, 0.8862)],
)
def test_subgroup_charts_by_hand(spark, kind, spread, k_mean, k_high, k_sigma):
    rows = [("a", g, float(g + x)) for g in range(1, 5) for x in (-1, 0, 1)]
    rows += [("ragged", 1, 1.0), ("ragged", 1, 2.0), ("ragged", 2, 1.0)]
    rows += [("big", 1, float(x)) for x in range(13)] + [("single", g, 1.0) for g in (1, 2)]
    chart = control_chart(spark.createDataFrame(rows, "stream string, subgroup long, value double"), kind, ["stream"])
    a = one(chart.limits, stream="a")
    assert a["center"] == 2.5 and a["n"] == 3 and a["n_points"] == 4
    assert a["ucl"] == pytest.approx(2.5 + k_mean * spread) and a["lcl"] == pytest.approx(2.5 - k_mean * spread)
    assert a["ucl_spread"] == pytest.approx(k_high * spread) and a["lcl_spread"] == 0
    assert a["sigma_hat"] == pytest.approx(spread / k_sigma)
    assert a["sigma_zone"] == pytest.approx(spread / k_sigma / math.sqrt(3))
    statuses = {r.stream: r.status for r in chart.limits.collect()}
    assert statuses == {"a": "ok", "ragged": "ragged", "big": "unsupported_n", "single": "unsupported_n"}


def test_attribute_charts_by_hand(spark):
    rows = [("a", 1, 5.0, 100.0), ("a", 2, 15.0, 50.0), ("bad", 1, 1.0, 0.0), ("bad", 2, 1.0, 10.0)]
    df = spark.createDataFrame(rows, "stream string, subgroup long, value double, sample_size double")
    p = control_chart(df, "p", ["stream"])
    limits = one(p.limits, stream="a")
    pbar = 20 / 150
    assert limits["center"] == pytest.approx(pbar)
    assert limits["sigma_zone"] == pytest.approx(math.sqrt(pbar * (1 - pbar) / 75))
    assert one(p.limits, stream="bad")["status"] == "bad_sample_size"
    first = p.points.where("stream = 'a'").orderBy("idx").first()
    assert first.point == pytest.approx(0.05)
    assert first.ucl == pytest.approx(pbar + 3 * math.sqrt(pbar * (1 - pbar) / 100)) and first.lcl == pytest.approx(
        max(0, pbar - 3 * math.sqrt(pbar * (1 - pbar) / 100))
    )
    u = control_chart(df.where("stream = 'a'"), "u", ["stream"]).points.orderBy("idx").collect()
    assert u[1].ucl == pytest.approx(pbar + 3 * math.sqrt(pbar / 50)) and u[1].lcl == 0
    c = one(control_chart(df.where("stream = 'a'"), "c", ["stream"]).limits)
    assert c["center"] == 10 and c["ucl"] == pytest.approx(10 + 3 * math.sqrt(10)) and c["lcl"] == pytest.approx(10 - 3 * math.sqrt(10))
    everything = control_chart(df.where("stream = 'a'").withColumn("value", F.col("sample_size")), "p", ["stream"])
    assert one(everything.limits)["status"] == "zero_sigma" and everything.points.where("ucl > 1").count() == 0
    with pytest.raises(ValueError, match="kind"):
        control_chart(df, "np", ["stream"])


def test_reports(spark):
    chart = control_chart(individuals(spark, {"=a": [1, 1.1, 0.9, 1, 1.1, 0.9, 1, 9]}), "I-MR", ["stream"], rule_set="we")
    points = reports.point_report(chart).orderBy("Point").collect()
    assert [p.Point for p in points] == list(range(1, 9))
    assert points[0].Status == "OK" and points[-1].Status == "Western Electric Rule 1"
    rows = {r.label: r.value for r in reports.chart_summary(chart).collect()}
    assert rows["Process Stream"] == "'=a" and rows["Rule Set"] == "Western Electric" and rows["Data Points"] == "8"
    assert rows["Violation @ Point 8"] == "Western Electric Rule 1" and rows["Rule Violations"] == "1"
    seen = one(violation_summary(chart))
    assert seen["violating_points"] == 1 and seen["rules"] == ["Western Electric Rule 1"]


def test_capability_sides(spark):
    df = individuals(spark, {k: [9, 10, 11, 10, 9, 11, 10, 10] for k in ("both", "low", "high", "none")})
    chart = control_chart(df, "I-MR", ["stream"], rule_set="we")
    spec = spark.createDataFrame([("both", 7.0, 13.0), ("low", 7.0, None), ("high", None, 13.0), ("none", None, None)], "stream string, lsl double, usl double")
    got = {r.stream: r for r in capability.gated_capability(df, chart, spec).collect()}
    sigma = one(chart.limits, stream="both")["sigma_hat"]
    overall = statistics.stdev([9, 10, 11, 10, 9, 11, 10, 10])
    assert got["both"].cp == pytest.approx(6 / (6 * sigma)) and got["both"].pp == pytest.approx(6 / (6 * overall))
    assert got["low"].cp is None and got["low"].cpk == pytest.approx(3 / (3 * sigma))
    assert got["high"].ppk == pytest.approx(3 / (3 * overall))
    assert got["none"].cpk is None and got["none"].cpk_rating == "N/A" and got["none"].status == "ok"
    assert got["both"].stable and got["both"].stability == "In statistical control"
    needing = capability.gated_capability(df, chart, spec, need_limits=True)
    assert one(needing, stream="none")["status"] == "no_limits"


def test_default_limits_take_the_first_present_in_order(spark):
    df = spark.createDataFrame([("a", 2, 5.0, None), ("a", 1, None, 9.0), ("a", 3, 6.0, 8.0), ("b", 1, None, None)], "stream string, subgroup long, lsl double, usl double")
    got = {r.stream: (r.lsl, r.usl) for r in capability.default_limits(df, ["stream"], ["subgroup"]).collect()}
    assert got == {"a": (5.0, 9.0), "b": (None, None)}


def test_histogram_counts_everything(spark, mode):
    df = individuals(spark, {"a": [i % 17 for i in range(100)], "flat": [2.0] * 5})
    bins = capability.histogram(df, ["stream"]).toPandas()
    a = bins[bins.stream == "a"]
    assert len(a) == 20 and a.n_values.sum() == 100
    assert (a.density * (a.bin_to - a.bin_from)).sum() == pytest.approx(1.0)
    assert bins[bins.stream == "flat"].n_values.sum() == 5


def test_normal_functions(spark):
    df = spark.range(1, 1000).select((F.col("id") / 1000.0).alias("p"))
    nd = statistics.NormalDist()
    for r in df.select("p", normal.quantile(F.col("p")).alias("q"), normal.upper_tail((F.col("p") - 0.5) * 14).alias("t")).collect():
        assert r.q == pytest.approx(nd.inv_cdf(r.p), abs=1e-12)
        assert r.t == pytest.approx(0.5 * math.erfc((r.p - 0.5) * 14 / math.sqrt(2)), abs=1e-10)


# Published worked examples: (values, W, p)
EXAMPLES = {
    "weights": ([148, 154, 158, 160, 161, 162, 166, 170, 182, 195, 236], 0.78881, 0.0067038),
    "three": ([1, 2, 4], 0.9642857, 0.6368868),
    "twenty": (
        [0.11, 7.87, 4.61, 10.14, 7.95, 3.14, 0.46, 4.43, 0.21, 4.75, 0.71, 1.52, 3.24, 0.93, 0.42, 4.97, 9.53, 4.55, 0.47, 6.66],
        0.90047,
        0.0420896,
    ),
}


def test_shapiro_wilk_against_published_examples(spark, mode):
    streams = {k: v[0] for k, v in EXAMPLES.items()} | {"pair": [1, 2], "flat": [3] * 6}
    got = {r.stream: r for r in shapiro_wilk(individuals(spark, streams), ["stream"], "value", "subgroup").collect()}
    for name, (_, w, p) in EXAMPLES.items():
        assert got[name].w_stat == pytest.approx(w, abs=1e-4) and got[name].p_value == pytest.approx(p, abs=1e-4)
        assert got[name].is_normal == (p > 0.05)
    assert got["pair"].status == "too_few_points" and got["flat"].status == "zero_range"
