"""A null stream has its sigma, limits and signals like any other."""

from shopfloor.operators.capability import default_limits, gated_capability
from shopfloor.operators.charts import control_chart


def test_a_null_stream_equals_a_named_one(spark):
    readings = [float(k % 5) for k in range(40)] + [30.0]
    rows = [(s, k, v, -5.0, 40.0) for s in ("a", None) for k, v in enumerate(readings)]
    frame = spark.createDataFrame(rows, "stream string, seq long, value double, lsl double, usl double")
    chart = control_chart(frame, "I-MR", ["stream"], position="seq", rule_set="we")
    found = gated_capability(frame, chart, default_limits(frame, ["stream"], ["seq"]), need_limits=True).collect()
    got = {r.stream: r.asDict() | {"stream": ""} for r in found}
    assert got[None] == got["a"]
    assert got[None]["status"] == "ok" and got[None]["signals"] > 0 and not got[None]["stable"] and got[None]["cpk"] > 0
