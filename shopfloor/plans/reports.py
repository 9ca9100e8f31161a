"""Report tables: what the printed reports show, as rows for every group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions import text
from shopfloor.operators.charts import CHART_TITLES, ControlChart
from shopfloor.operators.feedback import RULE_SET_LABELS
from shopfloor.operators.rules import rule_names

# Metric strip by chart: (label, limits column, decimals).
METRICS = {
    "Xbar-R": [("Xbarbar", "center", 4), ("Rbar", "rbar", 4), ("Sigma Hat", "sigma_hat", 4)],
    "Xbar-S": [("Xbarbar", "center", 4), ("Sbar", "sbar", 4), ("Sigma Hat", "sigma_hat", 4)],
    "I-MR": [("Xbar", "center", 4), ("MRbar", "mrbar", 4), ("Sigma Hat", "sigma_hat", 4)],
    "p": [("pbar", "center", 4), ("Avg N", "avg_n", 1), ("Points", "n_points", 0)],
    "c": [("cbar", "center", 4), ("UCL", "ucl", 4), ("Points", "n_points", 0)],
    "u": [("ubar", "center", 4), ("Avg N", "avg_n", 2), ("Points", "n_points", 0)],
}


def key_value_rows(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, Column]], first: int = 1) -> DataFrame:
    """One (keys, ord, label, value) row per pair."""
    entries = [
        F.struct(F.lit(first + i).alias("ord"), F.lit(label).alias("label"), value.cast("string").alias("value"))
        for i, (label, value) in enumerate(pairs)
    ]
    return df.select(*keys, F.explode(F.array(*entries)).alias("e")).select(*keys, "e.*")


def _metric_pairs(kind: str) -> list[tuple[str, Column]]:
    return [
        (label, text.fixed_point(F.col(c), digits) if digits else F.col(c).cast("string"))
        for label, c, digits in METRICS[kind]
    ]


def metric_strip(chart: ControlChart) -> DataFrame:
    """The three headline figures of a chart."""
    return key_value_rows(chart.limits, chart.keys, _metric_pairs(chart.kind))


def point_report(chart: ControlChart) -> DataFrame:
    """Point (from 1), value, the limits it was tested against, and OK or the rules that fired."""
    status = F.when(F.size("rules") == 0, "OK").otherwise(F.concat_ws("; ", rule_names(F.col("rules"))))
    return chart.points.select(
        *chart.keys,
        (F.col("idx") + 1).alias("Point"),
        F.round("point", 6).alias("Value"),
        F.round("ucl", 6).alias("UCL"),
        F.round("lcl", 6).alias("LCL"),
        status.alias("Status"),
    )


def chart_summary(chart: ControlChart, label: str | None = None) -> DataFrame:
    """Summary rows of a chart report, then one row per violation in rule order.

    ``point`` is null on summary rows; violation rows sort by (ord, point).
    """
    keys = chart.keys
    events = chart.points.groupBy(*keys).agg(F.sum(F.size("rules")).alias("_events"))
    limits = chart.limits.join(events, keys, "left")
    varies = F.lit("varies (per subgroup)")
    per_point = chart.kind in ("p", "u")
    pairs = [
        ("Chart Type", F.lit(CHART_TITLES[chart.kind])),
        ("Process Stream", text.spreadsheet_safe(F.col(label or keys[-1]).cast("string"))),
        ("Rule Set", F.lit(RULE_SET_LABELS[chart.rule_set])),
        ("Center Line (CL)", text.fixed_point(F.col("center"), 4)),
        ("UCL", varies if per_point else text.fixed_point(F.col("ucl"), 4)),
        ("LCL", varies if per_point else text.fixed_point(F.col("lcl"), 4)),
        ("Data Points", F.col("n_points")),
        ("Rule Violations", F.coalesce(F.col("_events"), F.lit(0))),
        *_metric_pairs(chart.kind),
    ]
    rows = key_value_rows(limits, keys, pairs).withColumn("point", F.lit(None).cast("long"))
    point = F.col("idx") + 1
    fired = chart.violations.select(
        *keys,
        (F.lit(100) + F.col("rule_no")).alias("ord"),
        F.concat(F.lit("Violation @ Point "), point.cast("string")).alias("label"),
        F.col("rule").alias("value"),
        point.alias("point"),
    )
    return rows.unionByName(fired)


def capability_report(gated: DataFrame, normality: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detail rows of a capability report."""
    keys = list(keys)
    t = gated.join(normality.select(*keys, "p_value", "is_normal"), keys, "left")
    pairs = [
        ("Process Stream", text.spreadsheet_safe(F.col(keys[-1]).cast("string"))),
        ("Data Points", F.col("n")),
        ("LSL", text.fixed_point(F.col("lsl"), 4)),
        ("USL", text.fixed_point(F.col("usl"), 4)),
        ("Cp", text.fixed_point(F.col("cp"), 4)),
        ("Cpk", text.fixed_point(F.col("cpk"), 4)),
        ("Pp", text.fixed_point(F.col("pp"), 4)),
        ("Ppk", text.fixed_point(F.col("ppk"), 4)),
        ("Cpk Rating", F.col("cpk_rating")),
        ("Mean", text.fixed_point(F.col("mean"), 4)),
        ("Sigma Hat (within)", text.fixed_point(F.col("sigma_hat"), 4)),
        ("Sigma Overall", text.fixed_point(F.col("sigma_overall"), 4)),
        ("Normality (Shapiro-Wilk p)", text.fixed_point(F.col("p_value"), 4)),
        ("Approximately Normal?", F.when(F.col("is_normal"), "Yes").otherwise("No")),
        ("Stability", F.col("stability")),
    ]
    return key_value_rows(t, keys, pairs)


def gage_report(results: DataFrame, keys: Sequence[str] = ("study_id",), lsl: float | None = None, usl: float | None = None) -> DataFrame:
    """Detail rows of a gage study report."""
    pairs = [
        ("EV (Repeatability)", text.fixed_point(F.col("ev"), 6)),
        ("AV (Reproducibility)", text.fixed_point(F.col("av"), 6)),
        ("GR&R", text.fixed_point(F.col("grr"), 6)),
        ("PV (Part Variation)", text.fixed_point(F.col("pv"), 6)),
        ("TV (Total Variation)", text.fixed_point(F.col("tv"), 6)),
        ("%GRR (Study)", text.percent(F.col("pgrr_study"))),
        ("%GRR (Tolerance)", text.percent(F.col("pgrr_tolerance"))),
        ("ndc", F.col("ndc")),
        ("Verdict", F.col("verdict")),
        ("Verdict Interpretation", text.verdict_sentence(F.col("verdict"))),
        ("Parts", F.col("n_parts")),
        ("Appraisers", F.col("n_appraisers")),
        ("Trials", F.col("n_trials")),
        ("USL", text.fixed_point(F.lit(usl).cast("double"), 6)),
        ("LSL", text.fixed_point(F.lit(lsl).cast("double"), 6)),
        ("Mean", text.fixed_point(F.col("mean"), 6)),
    ]
    return key_value_rows(results, keys, pairs)


def points_with_values(df: DataFrame, keys: Sequence[str], position: str, value: str = "value") -> DataFrame:
    """Numbered values of a capability report."""
    return df.select(*keys, (F.col(position) + 1).alias("Point"), F.round(value, 6).alias("Value"))
