"""Registered queries: every operator over the shared test tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions import scoring
from shopfloor.operators import actions, capability, charts, gage, plan, relational, risk, signals
from shopfloor.operators.feedback import occurrence_feedback
from shopfloor.operators.normality import shapiro_wilk
from shopfloor.operators.sequence import dense_sequence, tasks_for
from shopfloor.plans import pipelines, reports, views
from shopfloor.sources import contracts, export, ingest, scales, sensors
from shopfloor.sources.staging import stage, workspace
from shopfloor.streaming.live import OUTPUT, live_snapshot, monitor_in_batches

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six digits and arrays to text, so two engines can be compared."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DoubleType):
            return F.round(c, 6).alias(f.name)
        if isinstance(f.dataType, T.ArrayType):
            return F.concat_ws("; ", c).alias(f.name)
        return c

    return df.select(*[cell(f) for f in df.schema.fields])


# Control charts


def individuals(spark: SparkSession, d: str, rule_set: str = "nelson") -> charts.ControlChart:
    return charts.control_chart(
        views.spc_var(spark, d), "I-MR", ["stream"], position="seq", carry=["row_id"], rule_set=rule_set
    )


@query
def spc_imr_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(individuals(spark, d).limits)


@query
def spc_rules_we(spark: SparkSession, d: str) -> DataFrame:
    return individuals(spark, d, "we").violations


@query
def spc_rules_nelson(spark: SparkSession, d: str) -> DataFrame:
    return individuals(spark, d).violations


@query
def spc_violation_summary(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.violation_summary(individuals(spark, d)))


def _subgrouped(spark: SparkSession, d: str, kind: str, size: int) -> charts.ControlChart:
    return charts.control_chart(views.spc_subgroups(spark, d, size), kind, ["stream"])


@query
def spc_xbar_r(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_subgrouped(spark, d, "Xbar-R", 5).limits)


@query
def spc_xbar_r_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_subgrouped(spark, d, "Xbar-R", 5).points)


@query
def spc_xbar_s(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_subgrouped(spark, d, "Xbar-S", 12).limits)


@query
def spc_xbar_s_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(_subgrouped(spark, d, "Xbar-S", 12).points)


@query
def spc_p(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_p(spark, d), "p", ["stream"]).points)


@query
def spc_p_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_p(spark, d), "p", ["stream"]).limits)


@query
def spc_c(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_p(spark, d), "c", ["stream"]).points)


@query
def spc_c_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_p(spark, d), "c", ["stream"]).limits)


@query
def spc_u(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_u(spark, d), "u", ["stream"]).points)


@query
def spc_u_limits(spark: SparkSession, d: str) -> DataFrame:
    return rounded(charts.control_chart(views.spc_u(spark, d), "u", ["stream"]).limits)


@query
def spc_chart_points(spark: SparkSession, d: str) -> DataFrame:
    return rounded(individuals(spark, d).points)


@query
def spc_report_points(spark: SparkSession, d: str) -> DataFrame:
    return reports.point_report(individuals(spark, d, "we"))


@query
def spc_metrics(spark: SparkSession, d: str) -> DataFrame:
    made = [
        (individuals(spark, d), "I-MR"),
        (_subgrouped(spark, d, "Xbar-R", 5), "Xbar-R"),
        (charts.control_chart(views.spc_p(spark, d), "p", ["stream"]), "p"),
    ]
    out = [reports.metric_strip(chart).withColumn("chart", F.lit(kind)) for chart, kind in made]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def spc_report_summary(spark: SparkSession, d: str) -> DataFrame:
    return reports.chart_summary(charts.control_chart(views.spc_u(spark, d), "u", ["stream"]))


# Capability


@query
def spc_default_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits carried on measurement rows, missing on some of them."""
    rows = views.spc_var(spark, d).withColumns(
        {
            "lsl": F.when(F.col("seq") % 7 == 3, F.col("value") - 100.0),
            "usl": F.when((F.col("seq") % 11 == 5) & (F.col("stream") != "view"), F.col("value") + 200.0),
        }
    )
    return rounded(capability.default_limits(rows, ["stream"], ["seq", "row_id"]))


def _gated(spark: SparkSession, d: str) -> DataFrame:
    chart = individuals(spark, d, "we")
    return capability.gated_capability(views.spc_var(spark, d), chart, views.spc_limits(spark))


@query
def spc_capability(spark: SparkSession, d: str) -> DataFrame:
    chart = individuals(spark, d)
    return rounded(
        capability.capability(views.spc_var(spark, d), ["stream"], chart.limits, views.spc_limits(spark))
    )


@query
def spc_capability_gated(spark: SparkSession, d: str) -> DataFrame:
    return _gated(spark, d).select("stream", F.round("cpk", 6).alias("cpk"), "signals", "stable", "stability", "cpk_rating")


@query
def spc_normality(spark: SparkSession, d: str) -> DataFrame:
    return rounded(shapiro_wilk(views.spc_var(spark, d), ["stream"], "value", "row_id"))


@query
def spc_capability_report(spark: SparkSession, d: str) -> DataFrame:
    normality = shapiro_wilk(views.spc_var(spark, d), ["stream"], "value", "row_id")
    return reports.capability_report(_gated(spark, d), normality, ["stream"])


@query
def spc_histogram(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events").select(F.col("event_type").alias("stream"), "value")
    return rounded(capability.histogram(events, ["stream"]))


@query
def spc_normal_curve(spark: SparkSession, d: str) -> DataFrame:
    events = views.table(spark, d, "events").select(F.col("event_type").alias("stream"), "value")
    return rounded(capability.normal_curve(events, ["stream"]))


# Risk


def scored(spark: SparkSession, d: str) -> DataFrame:
    return risk.score(views.fmea_flat(spark, d))


@query
def risk_score(spark: SparkSession, d: str) -> DataFrame:
    return scored(spark, d).select(
        "ID", "RPN", "Flag_High_RPN", "Flag_High_Severity", "Flag_Action_Priority_H", "Risk_Tier", "score_status"
    )


@query
def risk_ap(spark: SparkSession, d: str) -> DataFrame:
    rows = scored(spark, d)
    return rows.select("ID", "Severity", "Occurrence", "Detection", "AP", scoring.ap_tier(F.col("AP")).alias("AP_Tier"))


@query
def risk_rank_rpn(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.risk_pipeline(views.fmea_flat(spark, d), "rpn").select("rank", "ID", "RPN", "Risk_Tier", "AP")


@query
def risk_rank_ap(spark: SparkSession, d: str) -> DataFrame:
    return pipelines.risk_pipeline(views.fmea_flat(spark, d), "ap").select("rank", "ID", "RPN", "Risk_Tier", "AP")


@query
def risk_rank_per_step(spark: SparkSession, d: str) -> DataFrame:
    return risk.rank(scored(spark, d), "rpn", ["Process_Step"]).select("Process_Step", "rank", "ID", "RPN")


@query
def risk_counters(spark: SparkSession, d: str) -> DataFrame:
    return risk.counters(scored(spark, d))


@query
def risk_counters_per_step(spark: SparkSession, d: str) -> DataFrame:
    return risk.counters(scored(spark, d), ["Process_Step"])


@query
def risk_distribution(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.distribution(scored(spark, d)))


@query
def risk_insight(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.insight(scored(spark, d)))


@query
def risk_health(spark: SparkSession, d: str) -> DataFrame:
    return risk.health_warnings(views.fmea_flat(spark, d))


@query
def risk_heatmap(spark: SparkSession, d: str) -> DataFrame:
    return risk.heatmap(scored(spark, d))


@query
def risk_pareto(spark: SparkSession, d: str) -> DataFrame:
    return rounded(risk.pareto(scored(spark, d)))


@query
def risk_topn_others(spark: SparkSession, d: str) -> DataFrame:
    return risk.top_with_others(scored(spark, d))


@query
def risk_filter(spark: SparkSession, d: str) -> DataFrame:
    kept = risk.filter_view(scored(spark, d), 100, True, ["ECONOMY", "SMALL", "PROMO"])
    return kept.select("ID", "Process_Step", "RPN", "Severity")


@query
def risk_process_steps(spark: SparkSession, d: str) -> DataFrame:
    return risk.process_steps(views.fmea_flat(spark, d))


@query
def risk_critical(spark: SparkSession, d: str) -> DataFrame:
    return risk.critical_items(scored(spark, d), "ap")


@query
def risk_critical_h(spark: SparkSession, d: str) -> DataFrame:
    return risk.critical_items(scored(spark, d), "rpn")


@query
def risk_flags_text(spark: SparkSession, d: str) -> DataFrame:
    return risk.with_flags_text(scored(spark, d)).select("ID", "Flags")


# Ingest and export


def dirty_fmea(spark: SparkSession, d: str) -> DataFrame:
    flat = views.fmea_flat(spark, d)
    k = F.col("ID") % 97
    texts = flat.select((F.col("ID") + 1).alias(contracts.ROW_NO), k.alias("k"), *[F.col(c).cast("string").alias(c) for c in flat.columns])
    k = F.col("k")
    return texts.withColumns(
        {
            "ID": F.when(k == 8, (F.col("ID").cast("long") - 1).cast("string")).when(k == 9, "0").otherwise(F.col("ID")),
            "Severity": F.when(k == 1, "").when(k == 2, "abc").when(k == 5, "inf").otherwise(F.col("Severity")),
            "Occurrence": F.when(k == 3, "5.0").otherwise(F.col("Occurrence")),
            "Detection": F.when(k == 4, "11").otherwise(F.col("Detection")),
            "Failure_Mode": F.when(k == 6, "   ").otherwise(F.col("Failure_Mode")),
            "Cause": F.when(k == 7, "").otherwise(F.col("Cause")),
            "Effect": F.when(k == 10, F.repeat(F.lit("x"), F.lit(2001))).otherwise(F.col("Effect")),
        }
    ).drop("k")


def dirty_spc(spark: SparkSession, d: str) -> DataFrame:
    rows = views.spc_var(spark, d)
    k = F.col("row_id") % 97
    return rows.select(
        (F.col("row_id") + 2).alias(contracts.ROW_NO),
        F.when(k == 1, "   ").when(k == 2, "").otherwise(F.col("stream")).alias("stream"),
        F.when(k == 3, "abc").when(k == 4, "5.0").when(k == 5, "0").when(k == 6, "2.5")
        .otherwise((F.col("seq") + 1).cast("string")).alias("subgroup"),
        F.when(k == 7, "abc").when(k == 8, "inf").when(k == 9, "").otherwise("1.5").alias("value"),
    )


def dirty_gage(spark: SparkSession, d: str) -> DataFrame:
    rows = dense_sequence(views.gage(spark, d), [], ["study_id", "part", "appraiser", "trial"], out="n")
    k = F.col("n") % 97
    return rows.select(
        (F.col("n") + 2).alias(contracts.ROW_NO),
        F.when(k == 1, "").otherwise(F.concat_ws("-", "study_id", "part")).alias("part"),
        F.when(k == 2, "  ").otherwise(F.col("appraiser")).alias("appraiser"),
        F.when(k == 3, "0").when(k == 4, "abc").when(k >= 90, "1").otherwise(F.col("trial").cast("string")).alias("trial"),
        F.when(k == 5, "inf").when(k == 6, "abc").otherwise("2.5").alias("measurement"),
    )


def dirty_plan(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("p_partkey") % 97, F.col("p_partkey")
    return views.table(spark, d, "part").select(
        (key + 2).alias(contracts.ROW_NO),
        F.when(k == 1, " ").when(k == 2, F.concat(F.lit("Char "), (key - 1).cast("string")))
        .otherwise(F.concat(F.lit("Char "), key.cast("string"))).alias("characteristic"),
        F.when(k == 3, "abc").when(k == 4, "9").when(k == 14, "").otherwise("1").alias("lsl"),
        F.when(k == 5, "inf").when(k == 15, "").otherwise("8").alias("usl"),
        F.when(k == 6, "12").when(k == 7, "4").otherwise("").alias("target"),
        F.when(k == 8, F.repeat(F.lit("m"), F.lit(201))).otherwise("Gauge").alias("measurement_method"),
        F.when(k == 9, "0").when(k == 10, "3.5").otherwise("5").alias("sample_size"),
        F.when(k == 11, "").otherwise("per shift").alias("frequency"),
        F.when(k == 12, "EWMA").when(k == 13, "Xbar-R").otherwise("").alias("recommended_chart"),
        F.lit("Contain").alias("reaction_plan"),
        F.when(k == 16, "  ").otherwise("F1::F1-M1::F1-M1-C1").alias("source_cause_id"),
    )


@query
def ingest_errors_risk(spark: SparkSession, d: str) -> DataFrame:
    return contracts.FMEA.errors(dirty_fmea(spark, d))


@query
def ingest_errors_spc(spark: SparkSession, d: str) -> DataFrame:
    return contracts.SPC.errors(dirty_spc(spark, d))


@query
def ingest_errors_gage(spark: SparkSession, d: str) -> DataFrame:
    return contracts.GAGE.errors(dirty_gage(spark, d))


@query
def ingest_errors_plan(spark: SparkSession, d: str) -> DataFrame:
    return contracts.PLAN.errors(dirty_plan(spark, d))


@query
def ingest_duplicates(spark: SparkSession, d: str) -> DataFrame:
    """Lines of an order beyond its first: the order key is declared unique and is not."""
    lines = views.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("ID"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate", "l_tax", "l_discount", "l_returnflag", "l_linestatus").alias("at"),
    )
    numbered = dense_sequence(lines, [], ["ID", "at"], out=contracts.ROW_NO).drop("at")
    return contracts.FMEA.duplicates(numbered).select("row_no", "value", "msg")


@query
def export_sanitized(spark: SparkSession, d: str) -> DataFrame:
    lead = F.element_at(
        F.array(*[F.lit(x) for x in ("=", "+", "-", "@", "\t", "\r", " =", "  -", "'=", " x", "")]),
        (F.col("ID") % 11 + 1).cast("int"),
    )
    rows = views.fmea_flat(spark, d).select("ID", F.concat(lead, "Cause").alias("note"), "Severity")
    return export.sanitized(rows)


@query
def export_risk_report(spark: SparkSession, d: str) -> DataFrame:
    tracked = actions.effectiveness(views.fmea_flat(spark, d), views.fmea_actions(spark, d), how="left")
    return export.sanitized(export.risk_report(risk.score(tracked.drop("RPN", "AP"))))


# Relational model


def model(spark: SparkSession, d: str) -> relational.RiskModel:
    return relational.to_relational(views.fmea_flat(spark, d))


@query
def rel_functions(spark: SparkSession, d: str) -> DataFrame:
    return relational.to_relational(views.fmea_flat(spark, d), materialize=False).functions


@query
def rel_failure_modes(spark: SparkSession, d: str) -> DataFrame:
    return relational.to_relational(views.fmea_flat(spark, d), materialize=False).failure_modes


@query
def rel_entities(spark: SparkSession, d: str) -> DataFrame:
    out = None
    for name, frame in model(spark, d).entities().items():
        rating = relational.ENTITIES[name][3]
        rows = frame.select(*relational.MODE, F.lit(name).alias("kind"), "id", "description", F.col(rating).alias("rating"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query
def rel_links(spark: SparkSession, d: str) -> DataFrame:
    return model(spark, d).links


@query
def rel_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    return relational.to_flat(model(spark, d))


@query
def rel_errors(spark: SparkSession, d: str) -> DataFrame:
    """A model with links dropped, repeated and pointed at unknown entities."""
    sound = model(spark, d)
    r = F.col("row_id")
    links = sound.links.where(r % 13 != 0).withColumn(
        "cause_id", F.when(r % 29 == 5, F.concat("cause_id", F.lit("x"))).otherwise(F.col("cause_id"))
    )
    broken = relational.with_links(sound, links.unionByName(links.where(r % 31 == 7)))
    return relational.model_errors(broken)


# Actions and scales


@query
def action_effectiveness(spark: SparkSession, d: str) -> DataFrame:
    done = actions.effectiveness(views.fmea_flat(spark, d), views.fmea_actions(spark, d))
    return done.select(
        "ID", "Action_Owner", "Action_Status", "S_After", "O_After", "D_After", "RPN", "AP", "RPN_Revised", "AP_Revised", "RPN_Delta", "AP_Reduced"
    )


@query
def action_tracked_rows(spark: SparkSession, d: str) -> DataFrame:
    """Ranked rows of the model with action columns, blank where no action is recorded."""
    ranked = pipelines.risk_pipeline_relational(model(spark, d), views.fmea_actions(spark, d))
    return ranked.select("rank", "ID", "RPN", "AP", "Action_Owner", "Action_Status", "O_After", "D_After", "RPN_Revised", "AP_Revised", "RPN_Delta")


@query
def action_rollup(spark: SparkSession, d: str) -> DataFrame:
    return actions.action_rollup(actions.effectiveness(views.fmea_flat(spark, d), views.fmea_actions(spark, d)))


@query
def action_attach(spark: SparkSession, d: str) -> DataFrame:
    """Edited twice: the second edit wins, rows edited to a blank owner record nothing."""
    first = views.fmea_actions(spark, d).withColumn("edit", F.lit(1))
    r = F.col("row_id")
    second = first.where(r % 12 == 0).withColumns(
        {"owner": F.when(r % 24 == 0, "  ").otherwise(" Reassigned "), "edit": F.lit(2), "status": F.lit("Closed")}
    )
    kept = actions.recorded_actions(first.unionByName(second), "edit")
    return kept.select("row_id", "owner", "status", "o_after", "d_after")


@query
def action_errors(spark: SparkSession, d: str) -> DataFrame:
    edited = views.fmea_actions(spark, d)
    r = F.col("row_id")
    edited = edited.select(
        "row_id",
        F.when(r % 40 == 0, " ").otherwise(F.col("owner")).alias("owner"),
        F.when(r % 28 == 0, "Done").otherwise(F.col("status")).alias("status"),
        F.when(r % 36 == 0, "soon").otherwise("2026-03-01").alias("due"),
        F.when(r % 44 == 0, 11).alias("s_after"),
        "o_after",
        F.when(r % 52 == 0, 0).otherwise(F.col("d_after")).alias("d_after"),
    )
    return contracts.action_errors(edited).select("row_id", "column", "value", "message")


@query
def rating_scale_labels(spark: SparkSession, d: str) -> DataFrame:
    rows = views.fmea_flat(spark, d).select("ID", "Severity", "Occurrence", "Detection")
    return scales.label_ratings(rows, scales.default_scales(spark))


# Control plan


@query
def plan_build(spark: SparkSession, d: str) -> DataFrame:
    return plan.control_plan(plan.named_modes(model(spark, d)))


@query
def plan_export(spark: SparkSession, d: str) -> DataFrame:
    return export.sanitized(export.plan_export(plan.control_plan(plan.named_modes(model(spark, d)))))


@query
def plan_export_checked(spark: SparkSession, d: str) -> DataFrame:
    """The plan held against its contract before it leaves."""
    made = plan.control_plan(plan.named_modes(model(spark, d)))
    numbered = dense_sequence(made, [], ["characteristic"], out=contracts.ROW_NO)
    return export.sanitized(export.checked_plan_export(numbered, contracts.ROW_NO))


@query
def plan_source_index(spark: SparkSession, d: str) -> DataFrame:
    return plan.source_index(plan.named_modes(model(spark, d)))


@query
def plan_recommend(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.when(F.col("p_partkey") % 3 == 0, "attribute").otherwise("variable").alias("data_type"),
        (F.col("p_size") % 14).alias("subgroup_size"),
        (F.col("p_partkey") % 2 == 0).alias("defect_based"),
        (F.col("p_size") % 2 == 0).alias("constant_sample"),
    )
    chart = scoring.recommended_chart(*[F.col(c) for c in ("data_type", "subgroup_size", "defect_based", "constant_sample")])
    return rows.withColumn("chart", chart)


@query
def plan_config(spark: SparkSession, d: str) -> DataFrame:
    k, key = F.col("p_partkey") % 10, F.col("p_partkey")
    rows = views.table(spark, d, "part").select(
        key.alias("plan_order"),
        F.concat(F.lit("Char "), F.floor(key / 2).cast("string")).alias("characteristic"),
        F.when(k == 0, "EWMA").when(k == 2, "Xbar-R").when(k == 4, " ").otherwise("I-MR").alias("recommended_chart"),
        F.when(k != 6, F.col("p_size").cast("double")).alias("lsl"),
        F.when(k != 8, F.col("p_size") + 10.0).alias("usl"),
        F.lit(None).cast("double").alias("target"),
        F.col("p_size").alias("sample_size"),
        F.when(k == 2, "").otherwise("per shift").alias("frequency"),
    )
    return plan.chart_config(rows)


# Gage studies


@query
def gage_rr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gage.gage_rr(views.gage(spark, d)))


@query
def gage_rr_tolerance(spark: SparkSession, d: str) -> DataFrame:
    return rounded(gage.gage_rr(views.gage(spark, d), tolerance=60.0))


@query
def gage_checks(spark: SparkSession, d: str) -> DataFrame:
    """One study per order-line status and supplier group, most of them not analysable."""
    lines = views.table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_returnflag", "l_linestatus", (F.col("l_suppkey") % 7).cast("string")).alias("study_id"),
        (F.col("l_partkey") % (F.col("l_suppkey") % 7 + 1)).cast("string").alias("part"),
        (F.col("l_orderkey") % (F.col("l_suppkey") % 4 + 1)).cast("string").alias("appraiser"),
        F.col("l_quantity").alias("measurement"),
    )
    cols = ["study_id", "n_parts", "n_appraisers", "n_trials", "n_measurements", "missing_cells", "is_balanced", "status"]
    return gage.gage_rr(lines).select(*cols)


@query
def gage_applicable(spark: SparkSession, d: str) -> DataFrame:
    """Which tables carry the columns of a gage study: readings, order lines and events."""
    tables = [("readings", views.gage(spark, d)), ("order lines", views.table(spark, d, "lineitem")), ("events", views.table(spark, d, "events"))]
    found = [
        gage.gage_applicability(frame).select(F.lit(name).alias("source"), "*").withColumn("n_rows", frame.agg(F.count(F.lit(1))).scalar())
        for name, frame in tables
    ]
    return rounded(reduce(DataFrame.unionByName, found))


@query
def gage_report(spark: SparkSession, d: str) -> DataFrame:
    return reports.gage_report(gage.gage_rr(views.gage(spark, d), tolerance=60.0), lsl=0.0, usl=60.0)


@query
def gage_results_export(spark: SparkSession, d: str) -> DataFrame:
    return export.gage_results_export(gage.gage_rr(views.gage(spark, d)))


@query
def gage_study_export(spark: SparkSession, d: str) -> DataFrame:
    return rounded(export.sanitized(export.study_export(views.gage(spark, d), ("study_id",))))


@query
def gage_tolerance_problem(spark: SparkSession, d: str) -> DataFrame:
    rows = views.table(spark, d, "part").select(
        F.col("p_partkey").alias("part_id"),
        F.when(F.col("p_partkey") % 5 != 0, F.col("p_size").cast("double")).alias("lsl"),
        F.when(F.col("p_partkey") % 7 != 0, 25.0).alias("usl"),
    )
    return rows.withColumn("problem", scoring.tolerance_problem(F.col("lsl"), F.col("usl")))


# Sensors


def readings(spark: SparkSession, d: str) -> DataFrame:
    return stage(views.signals(spark, d), "readings")


def sensor_study(spark: SparkSession, d: str) -> pipelines.SensorStudy:
    rows = readings(spark, d)
    labels = views.table(spark, d, "orders").select(
        F.col("o_orderkey").alias("row_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("label")
    )
    return pipelines.sensor_study(rows, labels)


@query
def signals_missingness(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.missingness(views.signals(spark, d)))


@query
def signals_audit(spark: SparkSession, d: str) -> DataFrame:
    audit = signals.screening_audit(readings(spark, d))
    return rounded(audit.withColumn("variance", F.round("variance", 2)))


@query
def signals_imr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensor_study(spark, d).chart.limits)


@query
def signals_autocorr(spark: SparkSession, d: str) -> DataFrame:
    return rounded(signals.autocorrelation(sensor_study(spark, d).chart))


@query
def signals_violations(spark: SparkSession, d: str) -> DataFrame:
    return sensor_study(spark, d).chart.violations


@query
def signals_runs(spark: SparkSession, d: str) -> DataFrame:
    """Length of each contiguous run of present readings."""
    rows = readings(spark, d)
    rows = dense_sequence(rows, ["signal"], ["row_id"], out="pos", tasks=tasks_for(spark, rows.count()))
    runs = signals.present_runs(rows, "pos")
    return runs.groupBy("signal", "run").agg(F.count(F.lit(1)).alias("n_values"), F.min("row_id").alias("first_row"))


@query
def signals_capability(spark: SparkSession, d: str) -> DataFrame:
    limits = spark.sql(
        "select signal, cast(lsl as double) as lsl, cast(usl as double) as usl from values "
        "('sensor_001', 1000.0, 90000.0), ('sensor_002', null, 95000.0), ('sensor_003', 2000.0, null), "
        "('sensor_004', null, null), ('sensor_005', 9.0, 1.0) as t(signal, lsl, usl)"
    )
    rows = readings(spark, d)
    wanted = signals.signal_capability(rows, signals.signal_charts(rows), limits)
    return rounded(wanted.select("signal", "n", "mean", "sigma_hat", "sigma_overall", "cp", "cpk", "pp", "ppk", "signals", "stable", "stability_warning", "status"))


@query
def yield_summary(spark: SparkSession, d: str) -> DataFrame:
    labels = views.table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("label"))
    return rounded(signals.yield_summary(labels))


@query
def yield_by_priority(spark: SparkSession, d: str) -> DataFrame:
    labels = views.table(spark, d, "orders").select(
        F.col("o_orderpriority").alias("priority"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("label")
    )
    return rounded(signals.yield_summary(labels, ["priority"]))


@query
def signals_pareto(spark: SparkSession, d: str) -> DataFrame:
    return rounded(sensor_study(spark, d).pareto)


def sensor_files(spark: SparkSession, d: str) -> tuple[str, str]:
    """Orders as a sensor matrix, a line an order, and their labels, written as two sets of part files cut differently."""
    reading = F.struct(F.col("l_linenumber").cast("int").alias("n"), F.col("l_extendedprice").cast("double").alias("v"))
    lines = views.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber").agg(
        F.max("l_extendedprice").alias("l_extendedprice")
    )
    cells = lines.groupBy("o_orderkey").agg(F.map_from_entries(F.collect_list(reading)).alias("_by"))  # seven lines at most
    units = views.table(spark, d, "orders").join(cells, "o_orderkey", "left").select(
        "o_orderkey",
        F.transform(F.sequence(F.lit(1), F.lit(7)), lambda n: F.col("_by")[n]).alias("cells"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("label"),
        F.col("o_orderdate").cast("timestamp").alias("timestamp"),
    )
    path = f"{workspace(spark)}/sensors-{uuid4().hex}"
    sensors.write_matrix(units, f"{path}.data", "o_orderkey", files=24)
    sensors.write_labels(units.drop("cells"), f"{path}.labels", "o_orderkey", files=7)
    return f"{path}.data", f"{path}.labels"


def _stamped(df: DataFrame) -> DataFrame:
    return df.withColumn("timestamp", F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"))


@query
def sensor_matrix_file(spark: SparkSession, d: str) -> DataFrame:
    """The matrix read back from its part files, a row per reading."""
    return sensors.read_matrix(spark, sensor_files(spark, d)[0])


@query
def sensor_labels_file(spark: SparkSession, d: str) -> DataFrame:
    """The labels read back from their part files."""
    return _stamped(sensors.read_labels(spark, sensor_files(spark, d)[1]))


@query
def sensor_labelled_files(spark: SparkSession, d: str) -> DataFrame:
    """Matrix and labels joined row for row."""
    return _stamped(sensors.read_labelled(spark, *sensor_files(spark, d)))


# Loop


@query
def feedback(spark: SparkSession, d: str) -> DataFrame:
    """Charts of the streams bound by name to characteristics without a plan source."""
    chart = individuals(spark, d)
    binding = views.table(spark, d, "events").select(
        F.concat(F.lit("Char "), "event_type").alias("characteristic"), F.col("event_type").alias("stream")
    ).distinct()
    index = plan.source_index(plan.named_modes(model(spark, d)))
    return rounded(occurrence_feedback(chart, binding, index))


@query
def loop_end_to_end(spark: SparkSession, d: str) -> DataFrame:
    loop = pipelines.closed_loop(
        views.fmea_flat(spark, d),
        views.spc_var(spark, d),
        position="seq",
        streams=views.table(spark, d, "events").select(F.col("event_type").alias("stream")),
    )
    return rounded(loop.feedback)


@query
def spc_occurrence_rank(spark: SparkSession, d: str) -> DataFrame:
    """Incident rate of each customer's priority orders, banded to an occurrence rank."""
    orders = views.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("customer")).agg(
        F.count_if(F.col("o_orderpriority") == "1-URGENT").alias("incidents"), F.count(F.lit(1)).alias("opportunities")
    )
    rate = F.col("incidents") / F.col("opportunities")
    return orders.withColumn("occurrence_rank", scoring.occurrence_rank(rate))


# Live


@query
def live_snapshot_xbar_r(spark: SparkSession, d: str) -> DataFrame:
    chart = live_snapshot(views.measurements(spark, d), 5, order=["ts", "row_id"])
    found = charts.violation_summary(chart).select("stream", "violation_events")
    cols = ["stream", "n_points", "center", "sigma_hat", "ucl", "lcl"]
    return rounded(chart.limits.select(*cols).join(found, "stream"))


@query
def live_snapshot_imr(spark: SparkSession, d: str) -> DataFrame:
    chart = live_snapshot(views.measurements(spark, d), 1, order=["ts", "row_id"], rule_set="nelson")
    found = charts.violation_summary(chart).select("stream", "violation_events")
    cols = ["stream", "n_points", "center", "sigma_hat", "ucl", "lcl"]
    return rounded(chart.limits.select(*cols).join(found, "stream"))


@query
def live_monitor_xbar_r(spark: SparkSession, d: str) -> DataFrame:
    """The monitor run over all events as a stream; the last state of each chart."""
    path = f"{d}/events.parquet"
    # A pattern, as the table may be a file and a stream reads folders.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path}*")
    rows = events.select(F.col("event_type").alias("stream"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    out = f"{workspace(spark)}/live-{uuid4().hex}"
    # The batches of the files that are there are as large as the table, so they are spread.
    monitor_in_batches(rows, 5, out, f"{out}-state").trigger(availableNow=True).start().awaitTermination()
    last = spark.read.schema(OUTPUT).parquet(out).groupBy("stream").agg(F.max_by(F.struct("*"), "subgroup").alias("last"))
    cols = [F.col("n_points").cast("long"), "center", "sigma_hat", "ucl", "lcl", F.col("violations").cast("long").alias("violation_events")]
    return rounded(last.select("last.*").select("stream", *cols))


@query
def live_monitor_event_time(spark: SparkSession, d: str) -> DataFrame:
    """The monitor by event time, started again for each third of the events as they come.

    Every event comes up to two days after its time, so in another order than it
    happened. The last state of each chart; the last two days still wait.
    """
    events = spark.read.parquet(f"{d}/events.parquet")
    rows = events.select(F.col("event_type").alias("stream"), F.col("event_id").alias("row_id"), F.col("ts").cast("timestamp").alias("ts"), "value")
    delayed = F.unix_timestamp("ts") + F.pmod(F.xxhash64("row_id"), F.lit(2 * 86_400))
    coming = rows.withColumn("_at", delayed)
    first, last = coming.agg(F.min("_at"), F.max("_at")).first()
    third = F.floor(3 * (F.col("_at") - (first or 0)) / ((last or 0) - (first or 0) + 1))
    base = f"{workspace(spark)}/live-{uuid4().hex}"
    for k in range(3):
        coming.where(third == k).drop("_at").write.mode("append").parquet(f"{base}-in")
        stream = spark.readStream.schema(rows.schema).parquet(f"{base}-in")
        monitor = monitor_in_batches(stream, 5, base, f"{base}-state", delay="2 days", late=f"{base}-late")
        monitor.trigger(availableNow=True).start().awaitTermination()
    last_rows = spark.read.schema(OUTPUT).parquet(base).groupBy("stream").agg(F.max_by(F.struct("*"), "subgroup").alias("last"))
    late = spark.read.schema(rows.schema).parquet(f"{base}-late").agg(F.count("*"))
    cols = [F.col("n_points").cast("long"), "center", "sigma_hat", "ucl", "lcl", F.col("violations").cast("long").alias("violation_events")]
    (late_rows,) = late.first()
    return rounded(last_rows.select("last.*").select("stream", *cols, F.lit(late_rows).alias("late_rows")))


# Files


@query
def file_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """All failure-mode rows out as CSV, and in again through the strict contract."""
    path = f"{workspace(spark)}/upload-{uuid4().hex}.csv"
    export.write_csv(views.fmea_flat(spark, d), path)
    return ingest.load_table(spark, path, contracts.FMEA)


@query
def risk_meanings_from_file(spark: SparkSession, d: str) -> DataFrame:
    """Meanings of all ratings, from a scale document read and checked as a file."""
    entry = F.struct(F.col("score").cast("string"), "meaning")
    one_map = lambda f: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("factor") == f, entry)))).alias(f)
    document = scales.default_scales(spark).agg(*[one_map(f) for f in scales.FACTORS])  # thirty rows
    path = f"{workspace(spark)}/scale-{uuid4().hex}"
    document.select(F.to_json(F.struct(F.lit("own").alias("name"), *scales.FACTORS)).alias("value")).coalesce(1).write.text(path)
    rows = views.fmea_flat(spark, d).select("ID", "Severity", "Occurrence", "Detection")
    return scales.label_ratings(rows, scales.load_scales(spark, path))
