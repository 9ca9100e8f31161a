"""Control plan: one monitored characteristic per failure mode, from its worst link."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import fixed, scoring, text
from shopfloor.operators.relational import MODE, RiskModel, resolved_links
from shopfloor.operators.sequence import dense_sequence, join_groups

PLAN_COLUMNS = [
    "characteristic",
    "lsl",
    "usl",
    "target",
    "measurement_method",
    "sample_size",
    "frequency",
    "recommended_chart",
    "reaction_plan",
    "source_cause_id",
]
DEFAULT_SAMPLE_SIZE = 1
DEFAULT_FREQUENCY = "per shift"


def worst_links(model: RiskModel) -> DataFrame:
    """The link of each failure mode with the highest (priority, RPN, row id).

    max_by keeps one candidate per failure mode in the map-side aggregation, so a
    failure mode with very many links costs no more than another.
    """
    links = scoring.with_action_priority(resolved_links(model), "Severity", "Occurrence", "Detection")
    links = links.withColumn("RPN", scoring.rpn(F.col("Severity"), F.col("Occurrence"), F.col("Detection")))
    kept = ["row_id", "effect_id", "cause_id", "control_id", "Effect", "Cause", "Occurrence", "Current_Control", "RPN", "AP"]
    risk = F.struct(scoring.ap_rank(F.col("AP")), F.col("RPN"), F.col("row_id"))
    return links.groupBy(*MODE).agg(F.max_by(F.struct(*kept), risk).alias("w")).select(*MODE, "w.*")


def named_modes(model: RiskModel) -> DataFrame:
    """Worst links with their characteristic name, the one source of plan and index.

    The first failure mode to use ``component — description`` keeps it; later
    ones add their id, and then a counter. ``name_clash`` marks a name that is
    still not unique because some text happens to equal a generated name.
    """
    functions = model.functions.select("function_id", F.col("ord").alias("_f"), "component")
    modes = model.failure_modes.select(*MODE, F.col("ord").alias("_m"), "description")
    modes = join_groups(modes, functions, ["function_id"])
    modes = modes.withColumn("_base", F.concat("component", F.lit(" — "), "description"))
    order = ["_f", "_m", "failure_mode_id"]
    modes = dense_sequence(modes, ["_base"], order, out="_use")
    second = F.concat("_base", F.lit(" ("), "failure_mode_id", F.lit(")"))
    modes = modes.withColumn("_long", F.when(F.col("_use") > 0, second))
    modes = dense_sequence(modes, ["_base", "_long"], order, out="_again")
    counter = F.when(F.col("_again") > 0, F.concat(F.lit(" #"), (F.col("_again") + 1).cast("string"))).otherwise("")
    modes = modes.withColumn("characteristic", F.coalesce(F.concat("_long", counter), F.col("_base")))
    uses = modes.groupBy("characteristic").agg((F.count(F.lit(1)) > 1).alias("name_clash"))
    named = modes.join(uses, "characteristic")
    return named.join(worst_links(model), MODE).select(
        "characteristic",
        *MODE,
        "component",
        *["row_id", "effect_id", "cause_id", "control_id", "Effect", "Cause", "Occurrence", "Current_Control", "RPN", "AP"],
        F.concat_ws("::", *MODE, "cause_id").alias("source_cause_id"),
        "name_clash",
    )


def control_plan(named: DataFrame) -> DataFrame:
    """Plan rows with their 1-based ``plan_order``: priority, RPN and name, all descending.

    Limits, target and chart stay empty: the risk model does not hold them.
    ``plan_status`` flags rows the plan contract would reject.
    """
    status = (
        F.when(F.col("name_clash"), "name_clash")
        .when((F.length("characteristic") > 200) | (F.length("Current_Control") > 200), "too_long")
        .when(F.length(text.reaction_plan(F.col("Effect"))) > 2000, "too_long")
        .otherwise("ok")
    )
    order = [scoring.ap_rank(F.col("AP")).desc(), F.col("RPN").desc(), F.col("characteristic").desc(), F.col("source_cause_id")]
    ranked = dense_sequence(named, [], order, out="_n")
    none = F.lit(None)
    return ranked.select(
        (F.col("_n") + 1).alias("plan_order"),
        "characteristic",
        none.cast("double").alias("lsl"),
        none.cast("double").alias("usl"),
        none.cast("double").alias("target"),
        F.col("Current_Control").alias("measurement_method"),
        F.lit(DEFAULT_SAMPLE_SIZE).alias("sample_size"),
        F.lit(DEFAULT_FREQUENCY).alias("frequency"),
        none.cast("string").alias("recommended_chart"),
        text.reaction_plan(F.col("Effect")).alias("reaction_plan"),
        "source_cause_id",
        "AP",
        "RPN",
        status.alias("plan_status"),
    )


def source_index(named: DataFrame) -> DataFrame:
    """Characteristic to its source cause; same keys as the plan."""
    return named.select(
        "characteristic",
        "failure_mode_id",
        F.col("source_cause_id").alias("cause_id"),
        F.col("Cause").alias("cause_description"),
        F.col("Occurrence").alias("occurrence"),
        "component",
    )


def chart_config(plan: DataFrame, order: str = "plan_order") -> DataFrame:
    """Chart settings of every characteristic; the first plan row of a name wins."""

    def cell(name: str) -> Column:
        if name not in plan.columns:
            return F.lit(None).cast("string")
        return text.blank_to_null(F.col(name).cast("string"))

    chart = cell("recommended_chart")
    config = plan.select(
        "characteristic",
        F.when(chart.isin(*fixed.CHART_KEYS), chart).alias("chart_key"),
        *[cell(c).cast("double").alias(c) for c in ("lsl", "usl", "target")],
        cell("sample_size").cast("double").cast("int").alias("sample_size"),
        cell("frequency").alias("frequency"),
        F.col(order).alias("_order"),
    )
    first = Window.partitionBy("characteristic").orderBy("_order")
    return config.withColumn("_nth", F.row_number().over(first)).where("_nth = 1").drop("_nth", "_order")


def config_for(plan: DataFrame, characteristic: str, order: str = "plan_order") -> DataFrame:
    """The one-row configuration of a characteristic; unknown names are an error."""
    found = chart_config(plan.where(F.col("characteristic") == characteristic), order)
    if found.isEmpty():
        raise KeyError(f"characteristic not found in plan: {characteristic!r}")
    return found
