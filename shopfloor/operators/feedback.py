"""From out-of-control charts back to the failure cause they speak about.

The result is a candidate table; nothing writes to the risk table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shopfloor.functions import scoring, text
from shopfloor.functions.maths import ratio
from shopfloor.operators.charts import ControlChart, violation_summary

RULE_SET_LABELS = {"we": "Western Electric", "nelson": "Nelson"}


def occurrence_feedback(chart: ControlChart, binding: DataFrame, index: DataFrame, stream: str = "stream") -> DataFrame:
    """One candidate row per bound characteristic whose chart has violations.

    ``binding`` pairs ``characteristic`` with ``stream``; ``index`` is the source
    index of the plan. A characteristic missing from it keeps null source fields.
    """
    seen = violation_summary(chart).where(F.col("violating_points") > 0)
    bound = binding.select("characteristic", F.col("stream").alias(stream)).join(seen, stream)
    rate = F.coalesce(ratio(F.col("violating_points").cast("double"), F.col("n_points")), F.lit(1.0))
    rated = bound.withColumn("ooc_rate", rate)
    rated = rated.withColumn("suggested_occurrence", scoring.occurrence_rank(F.col("ooc_rate")))
    joined = rated.join(index, "characteristic", "left")
    prompt = text.capa_prompt(
        F.col("characteristic"),
        F.col("violating_points"),
        F.col("rules"),
        F.col("cause_description"),
        F.col("occurrence"),
        F.col("suggested_occurrence"),
    )
    return joined.select(
        "characteristic",
        F.col(stream).alias("stream"),
        F.lit(RULE_SET_LABELS[chart.rule_set]).alias("rule_set"),
        F.lit(True).alias("ooc"),
        "violating_points",
        "rules",
        "ooc_rate",
        F.col("failure_mode_id").alias("source_failure_mode_id"),
        F.col("cause_id").alias("source_cause_id"),
        F.col("cause_description").alias("source_cause_description"),
        F.col("occurrence").alias("current_occurrence"),
        "suggested_occurrence",
        "component",
        prompt.alias("capa_prompt"),
    )
