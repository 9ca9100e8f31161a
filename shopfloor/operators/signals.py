"""Wide sensor studies in long form: screening, charts with gaps, yield, Pareto.

Input rows are (row_id, signal, value), one per unit and sensor, with a null
value where the reading is missing. All sensors are computed in one job.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import fixed
from shopfloor.functions.maths import ratio
from shopfloor.operators import rules as run_rules
from shopfloor.operators.capability import gated_capability
from shopfloor.operators.charts import ControlChart, individuals_limits
from shopfloor.operators.segments import segments
from shopfloor.operators.sequence import dense_sequence, join_groups, running_sum, tasks_for
from shopfloor.sources.staging import stage


@dataclass(frozen=True)
class ScreeningCriteria:
    min_present: int = fixed.SCREEN_MIN_PRESENT
    freq_ratio: float = fixed.SCREEN_FREQ_RATIO
    percent_unique: float = fixed.SCREEN_PERCENT_UNIQUE


def missingness(df: DataFrame, keys: Sequence[str] = ("signal",)) -> DataFrame:
    rows = F.count(F.lit(1))
    return df.groupBy(*keys).agg(
        F.count("value").alias("n_present"),
        (rows - F.count("value")).alias("n_missing"),
        ((rows - F.count("value")) / rows).alias("missing_frac"),
    )


def screening_audit(
    df: DataFrame, criteria: ScreeningCriteria = ScreeningCriteria(), keys: Sequence[str] = ("signal",)
) -> DataFrame:
    """Keep or drop every sensor, with the first failing reason."""
    keys = list(keys)
    rows = F.count(F.lit(1))
    moments = df.groupBy(*keys).agg(
        F.count("value").alias("n_present"),
        ((rows - F.count("value")) / rows).alias("missing_frac"),
        F.coalesce(F.var_samp("value"), F.lit(0.0)).alias("variance"),
    )
    # Value counts, then how many values share each count: at most sqrt(2n)
    # distinct counts per sensor, so no sensor is ever gathered in full.
    counts = df.where("value is not null").groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c"))
    shared = counts.groupBy(*keys, "c").agg(F.count(F.lit(1)).alias("m"))
    nth = Window.partitionBy(*keys).orderBy(F.col("c").desc())
    distinct = shared.groupBy(*keys).agg(F.sum("m").alias("n_distinct"))
    two = shared.withColumn("nth", F.row_number().over(nth)).where("nth <= 2").groupBy(*keys).agg(
        F.max(F.when(F.col("nth") == 1, F.col("c"))).alias("first"),
        F.max(F.when(F.col("nth") == 1, F.col("m"))).alias("first_shared"),
        F.max(F.when(F.col("nth") == 2, F.col("c"))).alias("second"),
    )
    t = moments.join(distinct, keys, "left").join(two, keys, "left")
    second = F.when(F.col("first_shared") > 1, F.col("first")).otherwise(F.col("second"))
    t = t.select(
        *keys,
        "n_present",
        "missing_frac",
        F.coalesce("n_distinct", F.lit(0)).cast("long").alias("n_distinct"),
        "variance",
        F.coalesce(F.col("first") / second, F.lit(float("inf"))).alias("freq_ratio"),
        F.coalesce(ratio(F.col("n_distinct").cast("double"), F.col("n_present")), F.lit(0.0)).alias("percent_unique"),
    )
    reason = (
        F.when(F.col("n_present") < criteria.min_present, "too_missing")
        .when(F.col("variance") == 0.0, "constant")
        .when(
            (F.col("freq_ratio") >= criteria.freq_ratio) & (F.col("percent_unique") <= criteria.percent_unique),
            "near_zero_variance",
        )
        .otherwise("ok")
    )
    return t.withColumn("status", F.when(reason == "ok", "keep").otherwise("drop")).withColumn("reason", reason)


def kept(df: DataFrame, audit: DataFrame, keys: Sequence[str] = ("signal",)) -> DataFrame:
    """Rows of the sensors the audit keeps (one audit row per sensor, so the join filters)."""
    return join_groups(df, audit.where("status = 'keep'").select(*keys), keys)


def signal_charts(
    df: DataFrame,
    keys: Sequence[str] = ("signal",),
    *,
    position: str | None = None,
    rule_set: str = "nelson",
    carry: Sequence[str] = ("row_id",),
) -> ControlChart:
    """Individuals charts of all sensors, with missing readings.

    Moving ranges never bridge a gap: both neighbours of a missing row yield
    none. Rules, mean and autocorrelation run over the present values joined up.
    ``position`` names a dense 0-based row number, otherwise rows are numbered by
    ``row_id``.
    """
    keys, carry = list(keys), list(dict.fromkeys(carry))
    rows = df.select(*dict.fromkeys([*keys, "row_id", *carry, "value", *([position] if position else [])]))
    if position:
        rows = rows.withColumn("_pos", F.col(position))
    else:
        rows = dense_sequence(rows, keys, ["row_id"], out="_pos", tasks=tasks_for(df.sparkSession, df.count()))
    rows = rows.withColumn("value", F.col("value").cast("double"))
    cut = segments(rows.withColumnRenamed("value", "point"), keys, "_pos", "point")

    stats = cut.carried.groupBy(*keys).agg(
        F.sum("_present").alias("n_points"), F.sum("_total").alias("_total"), F.sum("_moved").alias("_moved"), F.sum("_moves").alias("_moves")
    )
    limits = individuals_limits(
        stats.select(
            *keys, "n_points", ratio(F.col("_total"), F.col("n_points")).alias("center"), ratio(F.col("_moved"), F.col("_moves")).alias("mrbar")
        ),
        keys,
    )
    present = cut.with_carried(limits.select(*keys, "center", "sigma_zone", "ucl", "lcl"))
    # The last values of earlier segments go in before a segment's first, so that rules see them.
    back = F.when(F.col("_nth") == 1, F.sequence(-F.size("_lead"), F.lit(0))).otherwise(F.array(F.lit(0)))
    present = present.withColumn("mr", F.abs(F.col("point") - cut.before())).withColumn("_back", F.explode(back))
    present = present.withColumns(
        {
            "idx": F.col("_seen") + F.col("_nth") - 1 + F.col("_back"),
            "point": F.when(F.col("_back") == 0, F.col("point")).otherwise(F.get("_lead", F.size("_lead") + F.col("_back"))),
        }
    )
    partition = [*keys, "_chunk"]
    present = present.repartition(cut.tasks, *partition)
    tested = run_rules.with_rules(present, partition, "idx", "point", "center", "sigma_zone", rule_set)
    before = F.lag("point").over(Window.partitionBy(*partition).orderBy("idx"))
    charted = tested.withColumn("previous", before).where("_back = 0")
    points = charted.select(*keys, "idx", *carry, "point", "mr", "previous", "center", "ucl", "lcl", "rules")
    return ControlChart("I-MR", keys, carry, rule_set, limits, points)


def autocorrelation(chart: ControlChart) -> DataFrame:
    """Lag-1 autocorrelation of the present values and whether it exceeds white noise."""
    c, before = F.col("point") - F.col("center"), F.col("previous") - F.col("center")
    sums = chart.points.groupBy(*chart.keys).agg(
        F.count(F.lit(1)).alias("n_used"), F.sum(c * before).alias("_cross"), F.sum(c * c).alias("_square")
    )
    r = F.when(F.col("_square") > 0, ratio(F.coalesce("_cross", F.lit(0.0)), F.col("_square"))).otherwise(0.0)
    bound = fixed.AUTOCORRELATION_Z / F.sqrt(F.col("n_used").cast("double"))
    t = sums.withColumn("lag1_autocorr", r)
    return t.select(*chart.keys, "n_used", "lag1_autocorr", (F.abs("lag1_autocorr") > bound).alias("autocorr_flag"))


def present_runs(df: DataFrame, position: str, keys: Sequence[str] = ("signal",)) -> DataFrame:
    """Number the contiguous runs of present values of each sensor, from 0."""
    cut = segments(df, keys, position, "value")
    run = F.col("_runs") + F.col("_nth_run") - F.col("_joins") - 1
    return cut.with_carried().withColumn("run", run).select(*df.columns, "run")


def signal_capability(df: DataFrame, chart: ControlChart, limits: DataFrame) -> DataFrame:
    """Capability of each sensor against the limits the caller supplies."""
    wanted = join_groups(df, limits.select(*chart.keys), chart.keys)
    return gated_capability(wanted, chart, limits, need_limits=True)


def yield_summary(labels: DataFrame, keys: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Pass and fail counts, yield and defective units per million.

    An empty table gives no row; a label outside pass and fail gives
    ``status = 'bad_label'``.
    """
    group, rows = (list(keys), labels) if keys else (["_all"], labels.withColumn("_all", F.lit(0)))
    n = F.count(F.lit(1))
    good, bad = F.count_if(F.col(label) == fixed.UNIT_PASS), F.count_if(F.col(label) == fixed.UNIT_FAIL)
    t = rows.groupBy(*group).agg(n.alias("n_total"), good.alias("n_pass"), bad.alias("n_fail"))
    ok = F.col("n_pass") + F.col("n_fail") == F.col("n_total")
    passed = F.col("n_pass") / F.col("n_total")
    return t.select(
        *keys,
        "n_total",
        "n_pass",
        "n_fail",
        F.when(ok, passed).alias("yield_fraction"),
        F.when(ok, passed * 100.0).alias("yield_pct"),
        F.when(ok, F.col("n_fail") / F.col("n_total") * 1000000.0).alias("dppm"),
        F.when(ok, "ok").otherwise("bad_label").alias("status"),
    )


def failing_signal_pareto(chart: ControlChart, labels: DataFrame, label: str = "label") -> DataFrame:
    """Rule violations on failed units per sensor, with running share."""
    failed = labels.where(F.col(label) == fixed.UNIT_FAIL).select("row_id")
    hits = chart.violations.select(*chart.keys, "row_id").join(failed, "row_id", "left_semi")
    # One row per sensor after all the charting work: staged so that work runs once.
    counts = stage(hits.groupBy(*chart.keys).agg(F.count(F.lit(1)).alias("n_fail_violations")), "pareto")
    ranked = dense_sequence(counts, [], [F.col("n_fail_violations").desc(), *chart.keys], out="_nth")
    ranked = running_sum(ranked, [], "_nth", {"_running": F.col("n_fail_violations")})
    ranked = ranked.withColumn("_total", counts.agg(F.sum("n_fail_violations")).scalar())
    return ranked.select(
        *chart.keys,
        "n_fail_violations",
        (F.col("n_fail_violations") / F.col("_total") * 100.0).alias("pct"),
        (F.col("_running") / F.col("_total") * 100.0).alias("cumulative_pct"),
    )
