"""End-to-end flows over several operators."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.operators import actions as tracked
from shopfloor.operators import plan as planning
from shopfloor.operators import relational, risk, signals
from shopfloor.operators.charts import ControlChart, control_chart
from shopfloor.operators.feedback import occurrence_feedback
from shopfloor.operators.sequence import dense_sequence
from shopfloor.sources.contracts import FMEA, ROW_NO
from shopfloor.sources.staging import stage


def risk_pipeline(df: DataFrame, basis: str = "rpn", *, strict: bool = False) -> DataFrame:
    """Score and rank failure-mode rows; ``strict`` first validates raw rows (needs ``_row_no``)."""
    rows = FMEA.require_valid(df).drop(ROW_NO) if strict else df
    return risk.rank(risk.score(rows), basis)


def risk_pipeline_relational(model: relational.RiskModel, actions: DataFrame | None = None, basis: str = "rpn") -> DataFrame:
    """The same for a normalised model, with nine action columns when any action is recorded."""
    flat = relational.to_flat(model, ordered=False)
    if actions is not None:
        recorded = tracked.recorded_actions(actions)
        if not recorded.isEmpty():
            flat = tracked.effectiveness(flat, recorded, how="left").drop("RPN", "AP", "AP_Reduced")
    return risk_pipeline(flat, basis)


@dataclass(frozen=True)
class ClosedLoop:
    plan: DataFrame
    index: DataFrame
    chart: ControlChart
    feedback: DataFrame


def closed_loop(
    flat: DataFrame,
    measurements: DataFrame,
    binding: DataFrame | None = None,
    *,
    kind: str = "I-MR",
    rule_set: str = "we",
    streams: DataFrame | None = None,
    **chart_options: object,
) -> ClosedLoop:
    """Risk table to plan, to charts of the bound streams, to candidate occurrence ratings.

    Without a ``binding`` (characteristic, stream) the first plan rows are paired
    with the streams in name order.
    """
    named = planning.named_modes(relational.to_relational(flat))
    plan, index = planning.control_plan(named), planning.source_index(named)
    chart = control_chart(measurements, kind, ["stream"], rule_set=rule_set, **chart_options)
    if binding is None:
        names = (streams if streams is not None else measurements.select("stream")).distinct()
        numbered = dense_sequence(names, [], ["stream"], out="_n").withColumn("plan_order", F.col("_n") + 1)
        binding = plan.select("plan_order", "characteristic").join(numbered, "plan_order").select("characteristic", "stream")
    return ClosedLoop(plan, index, chart, occurrence_feedback(chart, binding, index))


@dataclass(frozen=True)
class SensorStudy:
    audit: DataFrame
    chart: ControlChart
    yields: DataFrame
    labels: DataFrame

    @cached_property
    def pareto(self) -> DataFrame:
        """Violations on failed units per sensor; charts every point when it is first asked for."""
        return signals.failing_signal_pareto(self.chart, self.labels)


def sensor_study(
    readings: DataFrame,
    labels: DataFrame,
    criteria: signals.ScreeningCriteria = signals.ScreeningCriteria(),
    *,
    position: str | None = None,
    rule_set: str = "nelson",
    carry: Sequence[str] = ("row_id",),
) -> SensorStudy:
    """Screen sensors, chart the kept ones, and relate their violations to failed units."""
    # One row a sensor; the charts' ordering samples what it sorts, which must not run the audit again.
    audit = stage(signals.screening_audit(readings, criteria), "audit")
    chart = signals.signal_charts(
        signals.kept(readings, audit), position=position, rule_set=rule_set, carry=carry
    )
    return SensorStudy(audit, chart, signals.yield_summary(labels), labels)
