"""Column expressions for risk scoring and the other small rule tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from shopfloor.functions import fixed


def in_scale(rating: Column) -> Column:
    return rating.between(fixed.RATING_MIN, fixed.RATING_MAX)


def rpn(severity: Column, occurrence: Column, detection: Column) -> Column:
    """Risk priority number; null when a rating is off the 1-10 scale."""
    product = severity.cast("long") * occurrence.cast("long") * detection.cast("long")
    return F.when(in_scale(severity) & in_scale(occurrence) & in_scale(detection), product)


def action_priority_table(spark: SparkSession) -> DataFrame:
    """All 1000 (S, O, D) combinations with their priority, for equi-joins and lookups.

    Joining on equality keeps such a plan a hash join; a join on the published
    bands would be a nested loop over three range conditions.
    """
    bands = fixed.lookup_table(
        spark,
        "s_lo, s_hi, o_lo, o_hi, d_lo, d_hi, ap",
        [
            (*row[:4], lo, hi, priority)
            for row in fixed.ACTION_PRIORITY
            for (lo, hi), priority in zip(fixed.DETECTION_BANDS, row[4:])
        ],
    )
    return (
        bands.select("*", F.explode(F.sequence("s_lo", "s_hi")).alias("ap_s"))
        .select("*", F.explode(F.sequence("o_lo", "o_hi")).alias("ap_o"))
        .select("ap_s", "ap_o", F.explode(F.sequence("d_lo", "d_hi")).alias("ap_d"), "ap")
    )


def _band(rating: Column, bands: list[tuple[int, int]]) -> Column:
    """Index of the inclusive band that holds the rating, null when none does."""
    place = None
    for i, (low, high) in enumerate(bands):
        inside = rating.between(low, high)
        place = F.when(inside, i) if place is None else place.when(inside, i)
    return place


def action_priority(severity: Column, occurrence: Column, detection: Column) -> Column:
    """Action Priority from the published table; null when a rating is off the scale.

    The 100 cells are one constant array indexed by the three bands, so scoring
    stays a projection without any join.
    """
    s_bands = list(dict.fromkeys(row[0:2] for row in fixed.ACTION_PRIORITY))
    o_bands = list(dict.fromkeys(row[2:4] for row in fixed.ACTION_PRIORITY))
    d_bands = fixed.DETECTION_BANDS
    cells = F.array(*[F.lit(cell) for row in fixed.ACTION_PRIORITY for cell in row[4:]])
    line = _band(severity, s_bands) * len(o_bands) + _band(occurrence, o_bands)
    # try_element_at: under ANSI mode element_at ignores a null index on an array without nulls.
    return F.try_element_at(cells, line * len(d_bands) + _band(detection, d_bands) + 1)


def with_action_priority(df: DataFrame, severity: str, occurrence: str, detection: str, out: str = "AP") -> DataFrame:
    return df.withColumn(out, action_priority(F.col(severity), F.col(occurrence), F.col(detection)))


def ap_rank(ap: Column) -> Column:
    return F.when(ap == "High", 3).when(ap == "Medium", 2).when(ap == "Low", 1)


def ap_tier(ap: Column) -> Column:
    return F.when(ap == "High", "Red").when(ap == "Medium", "Yellow").otherwise("Green")


def risk_tier(rpn_value: Column, severity: Column) -> Column:
    return (
        F.when((rpn_value > fixed.RPN_HIGH_ABOVE) | (severity >= fixed.SEVERITY_CRITICAL_FROM), "Red")
        .when(rpn_value >= fixed.RPN_YELLOW_FROM, "Yellow")
        .otherwise("Green")
    )


def tier_rank(tier: Column) -> Column:
    return F.when(tier == "Red", 3).when(tier == "Yellow", 2).otherwise(1)


def flags_text(high_rpn: Column, high_severity: Column, action_h: Column, none: str = "-") -> Column:
    joined = F.concat_ws(
        ", ",
        F.when(high_rpn, "High RPN"),
        F.when(high_severity, "Sev>=9"),
        F.when(action_h, "AP-H"),
    )
    return F.when(joined == "", none).otherwise(joined)


def occurrence_rank(rate: Column) -> Column:
    """First band whose upper incident rate is not below the observed rate."""
    ranked = None
    for rank, one_in in fixed.OCCURRENCE_ONE_IN:
        reached = rate <= F.lit(1.0) / F.lit(float(one_in))
        ranked = F.when(reached, rank) if ranked is None else ranked.when(reached, rank)
    return F.when(rate.isNotNull(), ranked.otherwise(fixed.RATING_MAX))


def cpk_rating(cpk: Column) -> Column:
    return (
        F.when(cpk.isNull(), "N/A")
        .when(cpk >= fixed.CPK_CAPABLE_FROM, "Capable")
        .when(cpk >= fixed.CPK_MARGINAL_FROM, "Marginal")
        .otherwise("Not capable")
    )


def recommended_chart(data_type: Column, subgroup_size: Column, defect_based: Column, constant_sample: Column) -> Column:
    """Chart choice for a characteristic; null when the subgroup size is below one."""
    variable = F.when(subgroup_size == 1, "I-MR").when(subgroup_size <= 9, "Xbar-R").otherwise("Xbar-S")
    attribute = F.when(~defect_based, "p").when(constant_sample, "c").otherwise("u")
    return F.when(subgroup_size >= 1, F.when(data_type == "variable", variable).otherwise(attribute))


def tolerance_problem(lsl: Column, usl: Column) -> Column:
    # Fixed value: the text is output.
    return F.when(
        lsl.isNotNull() & usl.isNotNull() & (usl <= lsl),
        "USL must be greater than LSL — tolerance ignored until corrected.",
    )
