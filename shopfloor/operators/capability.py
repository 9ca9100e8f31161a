"""Process capability, gated on the stability of the stream's control chart."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions import scoring, text
from shopfloor.functions.maths import ratio
from shopfloor.operators.charts import ControlChart, violation_summary
from shopfloor.operators.sequence import join_groups, join_on


def default_limits(df: DataFrame, keys: Sequence[str], order: Sequence[str], lsl: str = "lsl", usl: str = "usl") -> DataFrame:
    """First non-missing limit of each group in row order, one row per group."""

    def first(column: str) -> Column:
        present = F.when(F.col(column).isNotNull(), F.struct(*order))
        return F.min_by(column, present).cast("double").alias(column)

    return df.groupBy(*keys).agg(first(lsl), first(usl))


def spread_index(lsl: Column, usl: Column, sigma: Column) -> Column:
    """Cp / Pp: null unless both limits are given."""
    return (usl - lsl) / (6.0 * F.when(sigma > 0, sigma))


def centred_index(mean: Column, lsl: Column, usl: Column, sigma: Column) -> Column:
    """Cpk / Ppk: the worse side, or the one side that has a limit."""
    positive = F.when(sigma > 0, sigma)
    # least() ignores nulls, which is the one-sided rule.
    return F.least((usl - mean) / (3.0 * positive), (mean - lsl) / (3.0 * positive))


def overall_statistics(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    v = F.col(value)
    return df.groupBy(*keys).agg(
        F.count(v).alias("n"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("sigma_overall"),
        F.min(v).alias("min_value"),
        F.max(v).alias("max_value"),
    )


def capability(
    df: DataFrame,
    keys: Sequence[str],
    sigma: DataFrame,
    limits: DataFrame,
    *,
    value: str = "value",
    need_limits: bool = False,
) -> DataFrame:
    """Cp, Cpk, Pp and Ppk of every group.

    ``sigma`` carries the within-group ``sigma_hat`` and chart ``status`` per
    group, ``limits`` the nullable ``lsl`` and ``usl``. With ``need_limits`` a
    group without limits, or with crossed ones, gets a status instead of indices.
    """
    keys = list(keys)
    within = sigma.select(*keys, "sigma_hat", F.col("status").alias("_chart"))
    joined = join_on(overall_statistics(df, keys, value), within, keys, "left")
    joined = join_on(joined, limits.select(*keys, "lsl", "usl"), keys, "left")
    lsl, usl, mean = F.col("lsl"), F.col("usl"), F.col("mean")
    status = F.when(F.col("n") < 2, "too_few_points").when(F.col("_chart") != "ok", F.col("_chart"))
    status = status.when(F.coalesce(F.col("sigma_hat"), F.lit(0.0)) <= 0, "zero_sigma")
    if need_limits:
        status = status.when(lsl.isNull() & usl.isNull(), "no_limits").when(lsl >= usl, "bad_limits")
    joined = joined.withColumn("status", status.otherwise("ok"))

    def shown(index: Column) -> Column:
        return F.when(F.col("status") == "ok", index)

    return joined.select(
        *keys,
        "n",
        "mean",
        "sigma_hat",
        "sigma_overall",
        "min_value",
        "max_value",
        "lsl",
        "usl",
        shown(spread_index(lsl, usl, F.col("sigma_hat"))).alias("cp"),
        shown(centred_index(mean, lsl, usl, F.col("sigma_hat"))).alias("cpk"),
        shown(spread_index(lsl, usl, F.col("sigma_overall"))).alias("pp"),
        shown(centred_index(mean, lsl, usl, F.col("sigma_overall"))).alias("ppk"),
        "status",
    )


def gated_capability(
    df: DataFrame, chart: ControlChart, limits: DataFrame, *, value: str = "value", need_limits: bool = False
) -> DataFrame:
    """Capability plus whether the chart was stable; indices are reported either way."""
    keys = chart.keys
    measured = capability(df, keys, chart.limits, limits, value=value, need_limits=need_limits)
    events = violation_summary(chart).select(*keys, F.col("violation_events").alias("signals"))
    gated = join_on(measured, events, keys, "left").withColumn("signals", F.coalesce("signals", F.lit(0)).cast("long"))
    return gated.select(
        "*",
        (F.col("signals") == 0).alias("stable"),
        text.stability_warning(F.col("signals"), chart.rule_set).alias("stability_warning"),
        text.stability_note(F.col("signals")).alias("stability"),
        scoring.cpk_rating(F.col("cpk")).alias("cpk_rating"),
    )


def histogram(df: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Equal-width density histogram with min(20, max(8, n div 2)) bins per group."""
    keys = list(keys)
    stats = overall_statistics(df, keys, value).select(
        *keys,
        "n",
        F.col("min_value").alias("lo"),
        F.col("max_value").alias("hi"),
        F.least(F.lit(20), F.greatest(F.lit(8), F.floor(F.col("n") / 2))).cast("int").alias("bins"),
    )
    width = (F.col("hi") - F.col("lo")) / F.col("bins")
    # Equal values are counted before the lookup, so neither a hot value nor a hot group lands in one task.
    values = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_c"))
    counts = join_groups(values, stats, keys)
    place = F.floor(ratio(F.col("_v") - F.col("lo"), width))
    counts = counts.withColumn("bin", F.least(F.coalesce(place, F.lit(0)), F.col("bins") - 1).cast("int"))
    counts = counts.groupBy(*keys, "bin").agg(F.sum("_c").alias("n_values"))
    grid = stats.withColumn("bin", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)))
    n_values = F.coalesce(F.col("n_values"), F.lit(0)).cast("long")
    return join_on(grid, counts, [*keys, "bin"], "left").select(
        *keys,
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_from"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_to"),
        n_values.alias("n_values"),
        ratio(n_values, F.col("n") * width).alias("density"),
    )


def normal_curve(df: DataFrame, keys: Sequence[str], value: str = "value", points: int = 400) -> DataFrame:
    """Normal density over [min - 3 sigma, max + 3 sigma] for the histogram overlay."""
    stats = overall_statistics(df, keys, value).where("sigma_overall > 0")
    sigma, mean = F.col("sigma_overall"), F.col("mean")
    start, stop = F.col("min_value") - 3.0 * sigma, F.col("max_value") + 3.0 * sigma
    placed = stats.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn(
        "x", start + F.col("i") * ((stop - start) / F.lit(float(points - 1)))
    )
    z = (F.col("x") - mean) / sigma
    density = (1.0 / (sigma * F.sqrt(F.lit(2.0) * F.pi()))) * F.exp(-0.5 * z * z)
    return placed.select(*keys, "i", "x", density.alias("density"))
