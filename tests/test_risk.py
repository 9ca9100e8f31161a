import itertools

import pytest
from pyspark.sql import functions as F
from shopfloor.functions import fixed, scoring
from shopfloor.operators import actions, feedback, plan, relational, risk
from shopfloor.operators.charts import control_chart
from shopfloor.plans import pipelines
from shopfloor.sources import export

COLUMNS = "ID long, Process_Step string, Component string, Function string, Failure_Mode string, Effect string, Severity int, Cause string, Occurrence int, Current_Control string, Detection int"


def row(ident, s, o, d, step="Weld", component="Bracket", function="Hold", mode="Crack", effect="E", cause="C", control="K"):
    return (ident, step, component, function, mode, effect, s, cause, o, control, d)


def flat(spark, rows):
    return spark.createDataFrame(rows, COLUMNS)


def banded(s, o, d):
    for lo, hi, o_lo, o_hi, *cells in fixed.ACTION_PRIORITY:
        if lo <= s <= hi and o_lo <= o <= o_hi:
            return next(c for (a, b), c in zip(fixed.DETECTION_BANDS, cells) if a <= d <= b)


def test_all_thousand_priorities(spark):
    grid = spark.createDataFrame(list(itertools.product(range(1, 11), repeat=3)), "Severity int, Occurrence int, Detection int")
    got = {(r.Severity, r.Occurrence, r.Detection): r.AP for r in scoring.with_action_priority(grid, "Severity", "Occurrence", "Detection").collect()}
    assert got == {k: banded(*k) for k in got} and len(got) == 1000
    table = {(r.ap_s, r.ap_o, r.ap_d): r.ap for r in scoring.action_priority_table(spark).collect()}
    assert table == got
    # severity never auto-escalates, and a higher rating never lowers the priority
    level = {"Low": 1, "Medium": 2, "High": 3}
    for s, o, d in got:
        for worse in ((s + 1, o, d), (s, o + 1, d), (s, o, d + 1)):
            if worse in got:
                assert level[got[worse]] >= level[got[(s, o, d)]]


@pytest.mark.parametrize(
    ("s", "o", "d", "ap"),
    # cells of the published table, from each severity band
    [
        (9, 8, 1, "High"), (10, 4, 6, "High"), (9, 2, 7, "High"), (8, 9, 9, "High"), (7, 4, 2, "Medium"), (7, 2, 5, "Medium"),
        (6, 8, 5, "High"), (4, 6, 7, "Medium"), (5, 3, 10, "Low"), (2, 9, 7, "Medium"), (3, 8, 1, "Low"), (1, 10, 10, "Low"),
    ],
)
def test_spot_priorities(spark, s, o, d, ap):
    assert banded(s, o, d) == ap


def test_scores_flags_tiers(spark):
    rows = [row(1, 10, 2, 5), row(2, 5, 5, 4), row(3, 5, 5, 2), row(4, 7, 7, 1), row(5, 8, 5, 5), row(6, 11, 1, 1)]
    got = {r.ID: r for r in risk.with_flags_text(risk.score(flat(spark, rows))).collect()}
    assert [got[i].RPN for i in range(1, 7)] == [100, 100, 50, 49, 200, None]
    assert [got[i].Risk_Tier for i in range(1, 7)] == ["Red", "Yellow", "Yellow", "Green", "Red", None]
    assert got[1].Flags == "Sev>=9, AP-H" and got[2].Flags == "-" and got[5].Flags == "High RPN, AP-H"
    assert got[6].score_status == "off_scale" and got[6].AP is None


def test_ranking_ties_and_bases(spark, mode):
    rows = [row(4, 2, 5, 10), row(3, 5, 2, 10), row(2, 5, 10, 2), row(1, 5, 10, 2), row(5, 9, 10, 1)]
    ranked = pipelines.risk_pipeline(flat(spark, rows)).orderBy("rank").collect()
    assert [r.ID for r in ranked] == [1, 2, 3, 4, 5] and [r["rank"] for r in ranked] == [1, 2, 3, 4, 5]
    assert [r.ID for r in pipelines.risk_pipeline(flat(spark, rows), "ap").orderBy("rank").collect()][0] == 5
    with pytest.raises(KeyError):
        risk.rank(flat(spark, rows), "rpn")


def test_summaries_on_small_and_empty_tables(spark):
    scored = risk.score(flat(spark, [row(1, 10, 1, 1), row(2, 1, 1, 1), row(3, 5, 5, 5), row(4, 2, 2, 2)]))
    insight = risk.insight(scored).first()
    assert (insight.total, insight.top_n, insight.highest_rpn, insight.red) == (4, 3, 125, 2)
    assert insight.top_pct == pytest.approx(100 * 143 / 144)
    assert risk.insight(scored.where("ID = 1")).count() == 0 and risk.distribution(scored.where("ID > 9")).count() == 0
    assert risk.counters(scored.where("ID > 9")).first().total == 0
    top = risk.top_with_others(scored, k=2).orderBy("rank").collect()
    assert [r.RPN for r in top] == [125, 10, 9] and top[-1].Failure_Mode == "Others (N=2)" and top[-1].Risk_Tier == "Green"
    assert risk.top_with_others(scored, k=4).count() == 4
    grid = risk.heatmap(scored)
    assert grid.count() == 100 and grid.agg(F.sum("n_rows")).first()[0] == 4 and grid.where("worst_tier is not null").count() == 4
    assert risk.filter_view(scored, 9).count() == 2 and risk.filter_view(scored, 0, True).count() == 1
    assert risk.filter_view(scored, 0, False, ["Nope"]).count() == 0
    assert risk.pareto(scored).where("rank = 4").first().cumulative_pct == pytest.approx(100)


def test_occurrence_bands(spark):
    cases = [(0.0, 1), (1 / 1.5e6, 1), (1 / 1.5e6 + 1e-12, 2), (1 / 150000, 2), (1 / 15000, 3), (1 / 2000, 4), (1 / 400, 5), (1 / 80, 6), (1 / 20, 7), (1 / 8, 8), (1 / 3, 9), (1 / 2, 10), (1.0, 10)]
    df = spark.createDataFrame(cases, "rate double, rank int")
    assert df.where(scoring.occurrence_rank(F.col("rate")) != F.col("rank")).count() == 0


def test_relational_ids_round_trip_and_errors(spark, mode):
    rows = [
        row(3, 5, 4, 4, effect="Leak"),
        row(1, 5, 5, 5, component="Arm"),
        row(2, 5, 4, 4, effect="Leak", cause="Heat"),
        row(4, 6, 4, 4, effect="Leak", mode="Bend"),
        row(5, 5, 9, 4, effect="Leak"),
    ]
    model = relational.to_relational(flat(spark, rows))
    assert [tuple(r) for r in model.links.orderBy("row_id").collect()] == [
        ("F1", "F1-M1", 1, "F1-M1-E1", "F1-M1-C1", "F1-M1-CT1"),
        ("F2", "F2-M1", 2, "F2-M1-E1", "F2-M1-C1", "F2-M1-CT1"),
        ("F2", "F2-M1", 3, "F2-M1-E1", "F2-M1-C2", "F2-M1-CT1"),
        ("F2", "F2-M2", 4, "F2-M2-E1", "F2-M2-C1", "F2-M2-CT1"),
        ("F2", "F2-M1", 5, "F2-M1-E1", "F2-M1-C3", "F2-M1-CT1"),
    ]
    assert sorted(map(tuple, relational.to_flat(model).collect())) == sorted(rows)
    assert relational.model_errors(model).count() == 0
    broken = relational.with_links(model, model.links.where("row_id <> 4").withColumn("cause_id", F.when(F.col("row_id") == 5, "zz").otherwise(F.col("cause_id"))))
    found = {(r.item, r.message) for r in relational.model_errors(broken).collect()}
    assert ("F2-M2", "failure mode without links") in found and ("zz", "link row 5: unknown cause ID") in found
    assert ("F2-M1-C3", "unreferenced cause ID") in found and ("F2-M2-E1", "unreferenced effect ID") in found


def test_plan_names_order_and_index(spark, mode):
    rows = [row(i, 1, 1, 1, step=f"Step {i}", mode="weld") for i in range(1, 5)]
    rows += [row(10, 3, 3, 3, component="Arm", control="K1"), row(11, 9, 8, 8, component="Arm", effect="Worst", control="K2"), row(12, 5, 5, 5, component="Arm")]
    rows += [row(20, 5, 5, 5, component="Z", mode="Alpha"), row(21, 5, 5, 5, component="Z", mode="Beta")]
    named = plan.named_modes(relational.to_relational(flat(spark, rows)))
    made = plan.control_plan(named).orderBy("plan_order").collect()
    names = [r.characteristic for r in made]
    assert names[0] == "Arm — Crack" and made[0].measurement_method == "K2" and "Worst" in made[0].reaction_plan
    assert names.index("Z — Beta") < names.index("Z — Alpha")
    assert {n for n in names if n.startswith("Bracket")} == {"Bracket — weld", "Bracket — weld (F2-M1)", "Bracket — weld (F3-M1)", "Bracket — weld (F4-M1)"}
    assert set(names) == {r.characteristic for r in plan.source_index(named).collect()}
    assert made[0].source_cause_id == "F5::F5-M1::F5-M1-C2" and {r.plan_status for r in made} == {"ok"}
    config = plan.config_for(plan.control_plan(named), "Arm — Crack").first()
    assert config.sample_size == 1 and config.chart_key is None and config.frequency == "per shift"
    with pytest.raises(KeyError):
        plan.config_for(plan.control_plan(named), "nothing")
    assert export.plan_export(plan.control_plan(named)).columns == plan.PLAN_COLUMNS


def test_plan_counts_up_when_ids_repeat(spark):
    """Failure-mode ids are unique only inside a function."""
    base = relational.to_relational(flat(spark, [row(i, 1, 1, 1, step=f"S{i}", mode="weld") for i in range(1, 6)]))
    same = lambda df: df.withColumn("failure_mode_id", F.lit("M1"))
    model = relational.RiskModel(base.functions, same(base.failure_modes), same(base.effects), same(base.causes), same(base.controls), same(base.links))
    names = {r.characteristic for r in plan.named_modes(model).collect()}
    assert names == {"Bracket — weld", "Bracket — weld (M1)", "Bracket — weld (M1) #2", "Bracket — weld (M1) #3", "Bracket — weld (M1) #4"}


def test_chart_recommendation(spark):
    cases = [("variable", 1, False, True, "I-MR"), ("variable", 2, False, True, "Xbar-R"), ("variable", 9, False, True, "Xbar-R"), ("variable", 10, False, True, "Xbar-S"), ("variable", 0, False, True, None), ("attribute", 5, False, False, "p"), ("attribute", 5, True, True, "c"), ("attribute", 5, True, False, "u")]
    df = spark.createDataFrame(cases, "t string, n int, d boolean, c boolean, chart string")
    assert df.where(~scoring.recommended_chart(F.col("t"), F.col("n"), F.col("d"), F.col("c")).eqNullSafe(F.col("chart"))).count() == 0


def test_actions(spark):
    rows = flat(spark, [row(1, 9, 5, 5), row(2, 5, 5, 5)])
    edited = spark.createDataFrame([(1, " Ann ", None, None, 2, 1), (2, "  ", "Open", 1, 1, 1)], "row_id long, owner string, status string, s_after int, o_after int, d_after int")
    recorded = actions.recorded_actions(edited)
    assert [(r.row_id, r.owner, r.status) for r in recorded.collect()] == [(1, "Ann", "Open")]
    (e,) = actions.effectiveness(rows, recorded).collect()
    assert (e.RPN, e.RPN_Revised, e.RPN_Delta, e.AP, e.AP_Revised, e.AP_Reduced) == (225, 18, -207, "High", "Low", True)
    both = {r.ID: r for r in actions.effectiveness(rows, recorded, how="left").collect()}
    assert both[2].RPN_Revised is None and both[2].Action_Owner is None and both[1].RPN_Delta == -207
    assert tuple(actions.action_rollup(actions.effectiveness(rows, recorded)).first()) == (1, -207)
    model = relational.to_relational(rows)
    assert not set(actions.ACTION_COLUMNS) & set(pipelines.risk_pipeline_relational(model, edited.where("row_id = 2")).columns)
    tracked = pipelines.risk_pipeline_relational(model, edited)
    assert set(actions.ACTION_COLUMNS) <= set(tracked.columns)
    plain = pipelines.risk_pipeline(rows).select("ID", "rank", "RPN", "AP")
    assert sorted(map(tuple, tracked.select("ID", "rank", "RPN", "AP").collect())) == sorted(map(tuple, plain.collect()))


def test_closed_loop(spark):
    rows = flat(spark, [row(1, 7, 4, 6, step="Riveting", component="Hinge", mode="Loose pin", cause="Worn die"), row(2, 3, 3, 3, component="Core")])
    wild = [("pin", i, float(x)) for i, x in enumerate([0, 20] * 10)] + [("calm", i, x) for i, x in enumerate([1.0, 1.1, 0.9, 1.0, 1.1, 0.95])]
    data = spark.createDataFrame(wild + [("pin", 20, 90.0), ("pin", 21, 90.0)], "stream string, subgroup long, value double")
    binding = spark.createDataFrame([("Hinge — Loose pin", "pin"), ("Core — Crack", "calm"), ("Unknown", "pin")], "characteristic string, stream string")
    loop = pipelines.closed_loop(rows, data, binding, rule_set="we")
    got = {r.characteristic: r for r in loop.feedback.collect()}
    assert set(got) == {"Hinge — Loose pin", "Unknown"}
    known = got["Hinge — Loose pin"]
    assert known.source_cause_id == "F1::F1-M1::F1-M1-C1" and known.source_failure_mode_id == "F1-M1" and known.current_occurrence == 4
    assert known.suggested_occurrence == 8 and known.ooc_rate == pytest.approx(2 / 22) and "Occurrence 4" in known.capa_prompt
    assert got["Unknown"].current_occurrence is None and "an unlinked cause" in got["Unknown"].capa_prompt and "unknown" in got["Unknown"].capa_prompt
    calm = control_chart(data.where("stream = 'calm'"), "I-MR", ["stream"])
    assert feedback.occurrence_feedback(calm, binding, loop.index).count() == 0
