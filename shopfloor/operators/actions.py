"""Tracked actions on failure-mode rows and what they achieved."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import scoring

ACTION_COLUMNS = [
    "Action_Owner",
    "Action_Status",
    "Action_Due",
    "S_After",
    "O_After",
    "D_After",
    "RPN_Revised",
    "AP_Revised",
    "RPN_Delta",
]


def recorded_actions(edited: DataFrame, order: str | None = None) -> DataFrame:
    """Actions of an edited table: blank owners drop out, the last row per id wins.

    ``order`` is the edit order and is needed only when ids can repeat.
    """
    owner = F.trim("owner")
    kept = edited.withColumns({"owner": owner, "status": F.coalesce(F.col("status"), F.lit("Open"))}).where(
        F.coalesce(F.length("owner"), F.lit(0)) > 0
    )
    if order is None:
        return kept
    latest = Window.partitionBy("row_id").orderBy(F.col(order).desc())
    return kept.withColumn("_nth", F.row_number().over(latest)).where("_nth = 1").drop("_nth", order)


def effectiveness(rows: DataFrame, actions: DataFrame, how: str = "inner") -> DataFrame:
    """RPN and Action Priority before and after the action; unset re-ratings stay as they were.

    ``how='left'`` keeps rows without an action, with nulls in the action columns.
    """
    a = actions.select(
        F.col("row_id").alias("ID"),
        F.col("owner").alias("Action_Owner"),
        F.col("status").alias("Action_Status"),
        *[F.col("due").cast("date").alias("Action_Due") if "due" in actions.columns else F.lit(None).cast("date").alias("Action_Due")],
        F.col("s_after").cast("int").alias("S_After"),
        F.col("o_after").cast("int").alias("O_After"),
        F.col("d_after").cast("int").alias("D_After"),
    )
    joined = rows.join(a, "ID", how).withColumns(
        {
            "_s": F.coalesce("S_After", "Severity"),
            "_o": F.coalesce("O_After", "Occurrence"),
            "_d": F.coalesce("D_After", "Detection"),
        }
    )
    joined = joined.withColumns(
        {
            "RPN": scoring.rpn(F.col("Severity"), F.col("Occurrence"), F.col("Detection")),
            "RPN_Revised": scoring.rpn(F.col("_s"), F.col("_o"), F.col("_d")),
        }
    )
    joined = scoring.with_action_priority(joined, "Severity", "Occurrence", "Detection", "AP")
    joined = scoring.with_action_priority(joined, "_s", "_o", "_d", "AP_Revised").drop("_s", "_o", "_d")
    tracked = F.col("Action_Owner").isNotNull()
    joined = joined.withColumn("RPN_Delta", F.col("RPN_Revised") - F.col("RPN"))
    joined = joined.withColumn("AP_Reduced", scoring.ap_rank(F.col("AP_Revised")) < scoring.ap_rank(F.col("AP")))
    if how == "inner":
        return joined
    after = ["RPN_Revised", "AP_Revised", "RPN_Delta", "AP_Reduced"]
    return joined.withColumns({c: F.when(tracked, F.col(c)) for c in after})


def action_rollup(effects: DataFrame) -> DataFrame:
    """Number of tracked actions and the total RPN change they bring."""
    return effects.where(F.col("Action_Owner").isNotNull()).agg(
        F.count(F.lit(1)).alias("n_actions"), F.coalesce(F.sum("RPN_Delta"), F.lit(0)).alias("total_rpn_delta")
    )
