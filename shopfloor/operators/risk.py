"""Risk scoring, ranking and summaries of failure-mode rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import fixed, scoring
from shopfloor.operators.sequence import dense_sequence, join_groups, running_sum

# The columns of the critical-items table, in order.
CRITICAL_COLUMNS = [
    "Failure_Mode",
    "Process_Step",
    "Component",
    "Cause",
    "Severity",
    "Occurrence",
    "Detection",
    "RPN",
    "AP",
    "Risk_Tier",
    "Current_Control",
]
LABEL_LENGTH = 40
PARETO_TOP = 30


def score(df: DataFrame, *, priority: bool = True) -> DataFrame:
    """RPN, the three flags, the risk tier and (optionally) the Action Priority.

    A projection: no join and no shuffle. Rows rated off the
    scale get null scores and ``score_status = 'off_scale'``.
    """
    s, o, d = (F.col(c) for c in ("Severity", "Occurrence", "Detection"))
    scored = df.withColumn("RPN", scoring.rpn(s, o, d))
    on_scale = F.col("RPN").isNotNull()
    scored = scored.withColumns(
        {
            "Flag_High_RPN": F.col("RPN") > fixed.RPN_HIGH_ABOVE,
            "Flag_High_Severity": F.when(on_scale, s >= fixed.SEVERITY_CRITICAL_FROM),
            "Flag_Action_Priority_H": F.when(
                on_scale, (F.col("RPN") >= fixed.RPN_ACTION_H_FROM) | (s >= fixed.SEVERITY_CRITICAL_FROM)
            ),
            "Risk_Tier": F.when(on_scale, scoring.risk_tier(F.col("RPN"), s)),
            "score_status": F.when(on_scale, "ok").otherwise("off_scale"),
        }
    )
    return scoring.with_action_priority(scored, "Severity", "Occurrence", "Detection") if priority else scored


def rank_order(columns: Sequence[str], basis: str) -> list[Column]:
    """Sort keys of the two ranking bases; absent columns are skipped."""
    if basis == "rpn":
        wanted = [("RPN", True), ("Severity", True), ("Occurrence", True), ("ID", False)]
    elif basis == "ap":
        wanted = [("AP", True), ("RPN", True), ("Severity", True), ("ID", False)]
    else:
        raise ValueError(f"basis must be 'rpn' or 'ap', got {basis!r}")
    out = []
    for name, descending in wanted:
        if name in columns:
            key = scoring.ap_rank(F.col("AP")) if name == "AP" else F.col(name)
            out.append(key.desc() if descending else key.asc())
    return out


def rank(df: DataFrame, basis: str = "rpn", keys: Sequence[str] = ()) -> DataFrame:
    """Add the 1-based ``rank`` by RPN or by Action Priority."""
    if basis == "ap" and "AP" not in df.columns:
        raise KeyError("'AP' column not found; score with priority=True first")
    if basis == "rpn" and "RPN" not in df.columns:
        raise KeyError("'RPN' column not found; score first")
    ranked = dense_sequence(df, keys, rank_order(df.columns, basis), out="rank")
    return ranked.withColumn("rank", F.col("rank") + 1)


def filter_view(df: DataFrame, rpn_min: int = 0, severe_only: bool = False, process_steps: Sequence[str] = ()) -> DataFrame:
    """Rows at or above an RPN, optionally safety-critical only, in the named steps."""
    kept = df.where(F.col("RPN") >= rpn_min)
    if severe_only:
        kept = kept.where(F.col("Severity") >= fixed.SEVERITY_CRITICAL_FROM)
    if process_steps:
        kept = kept.where(F.col("Process_Step").isin(*process_steps))
    return kept


def process_steps(df: DataFrame) -> DataFrame:
    return df.select("Process_Step").distinct().orderBy("Process_Step")


def critical_items(df: DataFrame, basis: str = "rpn") -> DataFrame:
    wanted = F.col("AP") == "High" if basis == "ap" else F.col("Flag_Action_Priority_H")
    return df.where(wanted).select(*[c for c in CRITICAL_COLUMNS if c in df.columns])


def with_flags_text(df: DataFrame, out: str = "Flags") -> DataFrame:
    text = scoring.flags_text(F.col("Flag_High_RPN"), F.col("Flag_High_Severity"), F.col("Flag_Action_Priority_H"))
    return df.withColumn(out, text)


def counters(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Every badge of the summary strip in one aggregation."""
    tier, ap = F.col("Risk_Tier"), F.col("AP")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(tier == "Red").alias("red"),
        F.count_if(tier == "Yellow").alias("yellow"),
        F.count_if(tier == "Green").alias("green"),
        F.count_if("Flag_High_RPN").alias("high_rpn"),
        F.count_if("Flag_High_Severity").alias("high_severity"),
        F.count_if("Flag_Action_Priority_H").alias("action_priority_h"),
        F.count_if(ap == "High").alias("ap_high"),
        F.count_if(ap == "Medium").alias("ap_medium"),
        F.count_if(ap == "Low").alias("ap_low"),
    )


def distribution(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Shares per tier and priority with average, maximum and total RPN."""
    share = {"red": "Red", "yellow": "Yellow", "green": "Green"}
    total = F.count(F.lit(1))
    parts = [(100.0 * F.count_if(F.col("Risk_Tier") == v) / total).alias(f"pct_{k}") for k, v in share.items()]
    parts += [
        (100.0 * F.count_if(F.col("AP") == v) / total).alias(f"pct_ap_{v.lower()}") for v in ("High", "Medium", "Low")
    ]
    # Grouping by a constant keeps an empty table empty, where a global aggregate would yield a row.
    group, rows = (list(keys), df) if keys else (["_all"], df.withColumn("_all", F.lit(0)))
    return (
        rows.groupBy(*group)
        .agg(
            total.alias("total"),
            *parts,
            F.avg("RPN").alias("avg_rpn"),
            F.max("RPN").alias("max_rpn"),
            F.sum("RPN").alias("total_rpn"),
        )
        .drop("_all")
    )


def _first_rows(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str) -> DataFrame:
    """Top k rows per group; the planner trims to k per task before shuffling."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(window)).where(F.col(out) <= k)


def insight(df: DataFrame, keys: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Share of total RPN held by the top k rows, the top row, Red and critical counts."""
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    totals = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("total"),
        F.sum("RPN").alias("total_rpn"),
        F.count_if(F.col("Risk_Tier") == "Red").alias("red"),
        F.count_if("Flag_High_Severity").alias("high_severity"),
    )
    top = _first_rows(rows, keys, rank_order(df.columns, "rpn"), k, "_nth")
    top = top.groupBy(*keys).agg(
        F.sum("RPN").alias("top_rpn"),
        F.min_by("Failure_Mode", "_nth").alias("top_failure_mode"),
        F.min_by("Process_Step", "_nth").alias("top_process_step"),
        F.max("RPN").alias("highest_rpn"),
    )
    # Two one-row-per-group frames are put side by side by an aggregation over their union.
    both = totals.unionByName(top, allowMissingColumns=True)
    values = [c for c in both.columns if c not in keys]
    joined = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in values]).where("total >= 2")
    share = F.when(F.col("total_rpn") > 0, 100.0 * F.col("top_rpn") / F.nullif(F.col("total_rpn"), F.lit(0))).otherwise(0.0)
    return joined.select(
        *[c for c in keys if c != "_all"],
        "total",
        F.least(F.lit(k), F.col("total")).cast("long").alias("top_n"),
        share.alias("top_pct"),
        F.substring("top_failure_mode", 1, 60).alias("top_failure_mode"),
        "top_process_step",
        "highest_rpn",
        "red",
        "high_severity",
    )


def health_warnings(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Rows at the ends of a scale and over-long texts, one warning row per finding."""
    checks = []
    # The texts below are output.
    for c in ("Severity", "Occurrence", "Detection"):
        if c in df.columns:
            checks.append((F.col(c) == 10, f" row(s) have {c} = 10 (maximum score)"))
            checks.append((F.col(c) == 1, f" row(s) have {c} = 1 (minimum score)"))
    for c in ("Failure_Mode", "Effect", "Cause"):
        if c in df.columns:
            checks.append((F.length(c) > 120, f" row(s) have long '{c}' text (>120 chars — may truncate in PDF)"))
    counted = df.groupBy(*keys).agg(*[F.count_if(cond).alias(f"c{i}") for i, (cond, _) in enumerate(checks)])
    findings = F.array(
        *[
            F.struct(F.lit(i).alias("ord"), F.col(f"c{i}").alias("n"), F.lit(message).alias("text"))
            for i, (_, message) in enumerate(checks)
        ]
    )
    return (
        counted.select(*keys, F.explode(findings).alias("f"))
        .where("f.n > 0")
        .select(*keys, "f.ord", F.col("f.n").alias("n_rows"), F.concat(F.col("f.n").cast("string"), F.col("f.text")).alias("warning"))
    )


def heatmap(df: DataFrame) -> DataFrame:
    """10 x 10 severity by occurrence grid with row count and worst tier (null when empty)."""
    cells = df.groupBy("Severity", "Occurrence").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(scoring.tier_rank(F.col("Risk_Tier"))).alias("_worst")
    )
    axis = F.sequence(F.lit(fixed.RATING_MIN), F.lit(fixed.RATING_MAX))
    grid = df.sparkSession.range(1).select(F.explode(axis).alias("Severity")).select(
        "Severity", F.explode(axis).alias("Occurrence")
    )
    worst = F.element_at(F.array(F.lit("Green"), F.lit("Yellow"), F.lit("Red")), F.col("_worst"))
    return grid.join(cells, ["Severity", "Occurrence"], "left").select(
        "Severity",
        "Occurrence",
        F.coalesce("n_rows", F.lit(0)).cast("long").alias("n_rows"),
        F.when(F.col("_worst").isNotNull(), worst).alias("worst_tier"),
    )


def pareto(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Ranked rows with their cumulative share of total RPN."""
    keys = list(keys)
    ranked = rank(df, "rpn", keys).select(
        *keys,
        "rank",
        "ID",
        F.substring("Failure_Mode", 1, LABEL_LENGTH).alias("label"),
        "RPN",
        "Risk_Tier",
    )
    summed = running_sum(ranked, keys, "rank", {"_running": F.col("RPN")})
    if keys:
        totals = df.groupBy(*keys).agg(F.sum("RPN").alias("_total"))
        summed = join_groups(summed, totals, keys)
    else:
        summed = summed.withColumn("_total", df.agg(F.sum("RPN")).scalar())
    share = F.when(F.col("_total") > 0, 100.0 * F.col("_running") / F.nullif(F.col("_total"), F.lit(0))).otherwise(0.0)
    return summed.select(*keys, "rank", "ID", "label", "RPN", "Risk_Tier", share.alias("cumulative_pct"))


def top_with_others(df: DataFrame, keys: Sequence[str] = (), k: int = PARETO_TOP) -> DataFrame:
    """The k highest-RPN rows and one 'Others (N=...)' row for the rest of each group."""
    keys = list(keys) or ["_all"]
    rows = df.withColumn("_all", F.lit(0)) if keys == ["_all"] else df
    top = _first_rows(rows, keys, rank_order(df.columns, "rpn"), k, "rank")
    # What is left is the group's total less its top rows: one more small aggregation, no join.
    amounts = [F.sum("RPN").alias("_rpn"), F.count(F.lit(1)).alias("_n")]
    shown_part = top.groupBy(*keys).agg(*amounts).select(*keys, (-F.col("_rpn")).alias("_rpn"), (-F.col("_n")).alias("_n"))
    rest = rows.groupBy(*keys).agg(*amounts).unionByName(shown_part)
    others = (
        rest.groupBy(*keys)
        .agg(F.sum("_rpn").alias("RPN"), F.sum("_n").alias("_n"))
        .where("_n > 0")
        .select(
            *keys,
            F.lit(k + 1).alias("rank"),
            F.concat(F.lit("Others (N="), F.col("_n").cast("string"), F.lit(")")).alias("Failure_Mode"),
            "RPN",
            F.lit("Green").alias("Risk_Tier"),
        )
    )
    shown = top.select(
        *keys, "rank", F.substring("Failure_Mode", 1, LABEL_LENGTH).alias("Failure_Mode"), "RPN", "Risk_Tier"
    )
    both = shown.unionByName(others)
    return both.drop("_all") if keys == ["_all"] else both
