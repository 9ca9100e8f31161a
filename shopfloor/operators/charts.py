"""Control charts over all streams of a table at once."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import fixed
from shopfloor.operators import rules as run_rules
from shopfloor.operators.sequence import attach_group, chunked, dense_sequence, join_on

KINDS = tuple(fixed.CHART_KEYS)
CHART_TITLES = {
    "Xbar-R": "Xbar-R Chart",
    "Xbar-S": "Xbar-S Chart",
    "I-MR": "Individuals Chart",
    "p": "p Chart",
    "c": "c Chart",
    "u": "u Chart",
}


@dataclass(frozen=True)
class ControlChart:
    """The three frames of a chart.

    ``limits`` has one row per group; ``points`` one per plotted point, with the
    limits it was tested against and the rule numbers that fired; ``violations``
    one per point and rule.
    """

    kind: str
    keys: list[str]
    carry: list[str]
    rule_set: str
    limits: DataFrame
    points: DataFrame

    @property
    def violations(self) -> DataFrame:
        return run_rules.violations(self.points, [*self.keys, "idx", *self.carry])


def subgroup_points(df: DataFrame, keys: Sequence[str], subgroup: str, value: str) -> DataFrame:
    """Mean, range, sample deviation and size of each rational subgroup."""
    v = F.col(value)
    return df.groupBy(*keys, F.col(subgroup).alias("subgroup")).agg(
        F.avg(v).alias("point"),
        (F.max(v) - F.min(v)).alias("rng"),
        F.stddev_samp(v).alias("sd"),
        F.count(v).alias("n"),
    )


def _subgroup_limits(points: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    """Two-level aggregate: subgroup statistics to group means, then constants by size."""
    spark = points.sparkSession
    if kind == "Xbar-R":
        spread, name = "rng", "rbar"
        table = fixed.lookup_table(spark, "k_n, k_mean, k_low, k_high, k_sigma", fixed.XBAR_R)
    else:
        spread, name = "sd", "sbar"
        table = fixed.lookup_table(spark, "k_n, k_mean, k_low, k_high, k_sigma", fixed.XBAR_S)
    means = points.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_points"),
        F.min("n").alias("n"),
        F.max("n").alias("_n_max"),
        F.avg("point").alias("center"),
        F.avg(spread).alias("spread"),
    )
    sized = means.join(F.broadcast(table), means["n"] == table["k_n"], "left")
    status = (
        F.when(F.col("n") != F.col("_n_max"), "ragged")
        .when(F.col("k_n").isNull(), "unsupported_n")
        .when(F.col("spread") <= 0, "zero_sigma")
        .otherwise("ok")
    )
    usable = status.isin("ok", "zero_sigma")
    spread_col = F.col("spread")
    sigma = spread_col / F.col("k_sigma")
    values = {
        "center": F.col("center"),
        name: spread_col,
        "ucl": F.col("center") + F.col("k_mean") * spread_col,
        "lcl": F.col("center") - F.col("k_mean") * spread_col,
        "ucl_spread": F.col("k_high") * spread_col,
        "lcl_spread": F.greatest(F.lit(0.0), F.col("k_low") * spread_col),
        "sigma_hat": sigma,
        "sigma_zone": sigma / F.sqrt(F.col("n").cast("double")),
    }
    return sized.select(
        *keys,
        "n_points",
        "n",
        *[F.when(usable, c).alias(k) for k, c in values.items()],
        status.alias("status"),
    )


def not_finite(name: str) -> Column:
    """True for NaN and infinities, false for null."""
    return F.coalesce(F.isnan(name) | (F.abs(name) == float("inf")), F.lit(False))


def imr_limits(points: DataFrame, keys: Sequence[str], value: str = "point", moving_range: str = "mr") -> DataFrame:
    """Individuals limits from points that already carry their moving range."""
    stats = points.groupBy(*keys).agg(
        F.count(value).alias("n_points"), F.avg(value).alias("center"), F.avg(moving_range).alias("mrbar")
    )
    return individuals_limits(stats, keys)


def individuals_limits(stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Individuals limits from n_points, center (mean) and mrbar (mean moving range, null if there is none)."""
    status = (
        F.when(F.col("n_points") < 2, "too_few_points")
        .when(not_finite("center") | not_finite("mrbar"), "not_finite")
        .when(F.coalesce(F.col("mrbar"), F.lit(0.0)) <= 0, "zero_sigma")
        .otherwise("ok")
    )
    mean_range = F.coalesce(F.col("mrbar"), F.lit(0.0))
    values = {
        "center": F.col("center"),
        "mrbar": mean_range,
        "ucl": F.col("center") + fixed.IMR_LIMIT * mean_range,
        "lcl": F.col("center") - fixed.IMR_LIMIT * mean_range,
        "ucl_mr": fixed.IMR_RANGE_LIMIT * mean_range,
        "lcl_mr": F.lit(0.0),
        "sigma_hat": mean_range / fixed.IMR_SIGMA,
        "sigma_zone": mean_range / fixed.IMR_SIGMA,
    }
    enough = ~status.isin("too_few_points", "not_finite")
    return stats.select(
        *keys, "n_points", *[F.when(enough, c).alias(k) for k, c in values.items()], status.alias("status")
    )


def _attribute_limits(points: DataFrame, keys: Sequence[str], kind: str) -> DataFrame:
    size = F.col("size")
    if kind == "c":
        stats = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_points"), F.avg("count").alias("center"))
        bad = F.lit(False)
        spread = F.sqrt(F.when(F.col("center") >= 0, F.col("center")))
        sizes = []
    else:
        stats = points.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("n_points"),
            F.sum("count").alias("_count"),
            F.sum("size").alias("_size"),
            F.avg("size").alias("avg_n"),
            F.count_if(size.isNull() | (size <= 0)).alias("_bad"),
        )
        bad = F.col("_bad") > 0
        stats = stats.withColumn("center", F.when(~bad, F.col("_count") / F.when(~bad, F.col("_size"))))
        center = F.col("center")
        variance = center * (1.0 - center) if kind == "p" else center
        spread = F.sqrt(F.when(variance >= 0, variance) / F.when(~bad, F.col("avg_n")))
        sizes = ["avg_n"]
    status = F.when(bad, "bad_sample_size").when(F.coalesce(spread, F.lit(0.0)) <= 0, "zero_sigma").otherwise("ok")
    limits = stats.select(
        *keys,
        "n_points",
        *sizes,
        "center",
        F.when(~bad, F.coalesce(spread, F.lit(0.0))).alias("sigma_zone"),
        status.alias("status"),
    )
    if kind == "c":
        limits = limits.withColumns(
            {
                "ucl": F.col("center") + 3.0 * F.col("sigma_zone"),
                "lcl": F.greatest(F.lit(0.0), F.col("center") - 3.0 * F.col("sigma_zone")),
            }
        )
    return limits


def _point_limits(points: DataFrame, kind: str) -> DataFrame:
    """Per-point limits of p and u charts, whose sample sizes vary."""
    center, size = F.col("center"), F.when(F.col("size") > 0, F.col("size"))
    variance = center * (1.0 - center) if kind == "p" else center
    reach = 3.0 * F.sqrt(F.when(variance >= 0, variance) / size)
    upper, lower = center + reach, F.greatest(F.lit(0.0), center - reach)
    if kind == "p":
        upper = F.least(F.lit(1.0), upper)
    # greatest/least skip nulls, so an undefined reach must blank both limits.
    return points.withColumns({"ucl": F.when(reach.isNotNull(), upper), "lcl": F.when(reach.isNotNull(), lower)})


def moving_range(value: str, partition: Sequence[str], seq: str) -> Column:
    """|x - previous x|; null at the start and on both sides of a missing value."""
    return F.abs(F.col(value) - F.lag(value).over(Window.partitionBy(*partition).orderBy(seq)))


def control_chart(
    df: DataFrame,
    kind: str,
    keys: Sequence[str],
    *,
    value: str = "value",
    subgroup: str = "subgroup",
    order: Sequence[str] | None = None,
    position: str | None = None,
    sample_size: str = "sample_size",
    carry: Sequence[str] = (),
    rule_set: str = "nelson",
) -> ControlChart:
    """Limits, points and rule violations of one chart type for every group.

    ``order`` must be total inside a group (default: the subgroup number).
    ``position`` names a column that already holds the 0-based position of the
    plotted point and saves the numbering step. ``carry`` columns of individual
    points are kept on points and violations.
    """
    if kind not in KINDS:
        raise ValueError(f"kind must be one of {KINDS}, got {kind!r}")
    keys, carry = list(keys), list(carry)
    run_rules.rule_count(rule_set)

    if kind in ("Xbar-R", "Xbar-S"):
        points = subgroup_points(df, keys, subgroup, value)
        carry = ["subgroup"]
        order, extra = ["subgroup"], ["rng", "sd", "n"]
    else:
        order = list(order) if order else [subgroup]
        keep = {c: F.col(c) for c in [*keys, *carry]}
        if position:
            keep[position] = F.col(position)
        else:
            keep.update({f"_o{i}": F.col(c) for i, c in enumerate(order)})
            order = [f"_o{i}" for i in range(len(order))]
        if kind == "I-MR":
            keep["point"], extra = F.col(value).cast("double"), ["mr"]
        elif kind == "c":
            keep["count"] = F.col(value).cast("double")
            keep["point"], extra = F.col(value).cast("double"), []
        else:
            size = F.col(sample_size).cast("double")
            keep["count"], keep["size"] = F.col(value).cast("double"), size
            keep["point"], extra = F.col(value).cast("double") / F.when(size > 0, size), ["size"]
        points = df.select(*[c.alias(name) for name, c in keep.items()])

    if position:
        points = points.withColumn("idx", F.col(position).cast("long"))
    else:
        points = dense_sequence(points, keys, order, out="idx")

    rows, partition = chunked(points, keys, "idx")
    if kind == "I-MR":
        rows = rows.withColumn("mr", moving_range("point", partition, "idx"))
        limits = imr_limits(rows.where("_own"), keys)
    elif kind in ("Xbar-R", "Xbar-S"):
        limits = _subgroup_limits(points, keys, kind)
    else:
        limits = _attribute_limits(points, keys, kind)

    per_group = ["center", "sigma_zone"] + ([] if kind in ("p", "u") else ["ucl", "lcl"])
    tested = attach_group(rows, limits.select(*keys, *per_group), keys)
    if kind in ("p", "u"):
        tested = _point_limits(tested, kind)
    charted = run_rules.with_rules(tested, partition, "idx", "point", "center", "sigma_zone", rule_set)
    columns = [*keys, "idx", *carry, "point", *extra, "center", "ucl", "lcl", "rules"]
    columns = list(dict.fromkeys(columns))
    return ControlChart(kind, keys, carry, rule_set, limits, charted.where("_own").select(*columns))


def require_ok(limits: DataFrame) -> DataFrame:
    """Strict mode: raise on the first group whose chart could not be computed."""
    bad = limits.where(F.col("status") != "ok").take(1)
    if bad:
        raise ValueError(f"chart not computable: {bad[0].asDict()}")
    return limits


def violation_summary(chart: ControlChart) -> DataFrame:
    """Per group: plotted points, distinct violating points, events and rule names."""
    fired = chart.points.where(F.size("rules") > 0).groupBy(*chart.keys).agg(
        F.count(F.lit(1)).alias("violating_points"),
        F.sum(F.size("rules")).alias("violation_events"),
        # Eight rules make at most 255 distinct arrays, so the set stays small for any group.
        F.array_sort(F.flatten(F.collect_set("rules"))).alias("_numbers"),
    )
    rules_seen = F.array_sort(run_rules.rule_names(F.array_distinct("_numbers")))
    joined = join_on(chart.limits, fired, chart.keys, "left")
    return joined.select(
        *chart.keys,
        "n_points",
        F.coalesce("violating_points", F.lit(0)).cast("long").alias("violating_points"),
        F.coalesce("violation_events", F.lit(0)).cast("long").alias("violation_events"),
        F.coalesce(rules_seen, F.array().cast("array<string>")).alias("rules"),
        "status",
    )
