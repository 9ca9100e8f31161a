"""Shapiro-Wilk normality test for every group of a table.

The statistic is a ratio of sums once each value's rank is known, so the test is
one distributed ranking followed by two aggregations; no group is gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shopfloor.functions import normal
from shopfloor.functions.maths import ratio
from shopfloor.operators.sequence import attach_group, chunked, dense_sequence, join_on

VALIDATED_UP_TO = 5000


def _score(rank: Column, n: Column) -> Column:
    """Expected normal order statistic of the 1-based rank."""
    return normal.quantile((rank - 0.375) / (n + 0.25))


def shapiro_wilk(df: DataFrame, keys: Sequence[str], value: str, row_id: str, alpha: float = 0.05) -> DataFrame:
    """W, its p-value and whether normality is not rejected, per group.

    Groups under three values get ``too_few_points``, constant groups
    ``zero_range``. Above 5000 values the approximation is outside its validated
    range: the numbers are still given, with status ``beyond_validated_n``.
    """
    keys = list(keys)
    values = df.select(*keys, F.col(value).cast("double").alias("_x"), F.col(row_id).alias("_id")).where("_x is not null")
    stats = values.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), (F.var_samp("_x") * (F.count(F.lit(1)) - 1)).alias("_ss")
    )
    rows, _ = chunked(dense_sequence(values, keys, ["_x", "_id"], out="_seq"), keys, "_seq", lead_in=0)
    ranked = attach_group(rows, stats.select(*keys, "n"), keys)
    n, rank, x = F.col("n").cast("double"), F.col("_seq") + 1.0, F.col("_x")

    def at(position: Column) -> Column:
        return F.max(F.when(F.col("_seq") == position, x))

    scored = ranked.withColumn("_m", _score(rank, n))
    sums = scored.groupBy(*keys).agg(
        F.sum(F.col("_m") * F.col("_m")).alias("_mm"),
        F.sum(F.col("_m") * x).alias("_mx"),
        at(F.lit(0)).alias("_x1"),
        at(F.lit(1)).alias("_x2"),
        at(F.col("n") - 2).alias("_y2"),
        at(F.col("n") - 1).alias("_y1"),
    )
    t = join_on(stats, sums, keys, "left").withColumns({"_m1": _score(F.lit(1.0), n), "_m2": _score(F.lit(2.0), n)})
    return _significance(_statistic(t), keys, alpha)


def _statistic(sums: DataFrame) -> DataFrame:
    """W from the rank sums: the two outermost pairs carry corrected weights."""
    n, m1, m2, a1, a2 = (F.col(c) for c in ("n", "_m1", "_m2", "_a1", "_a2"))
    root, shrink = F.sqrt("_mm"), ratio(F.lit(1.0), F.sqrt(n))
    last = normal.polynomial(normal.WEIGHT_LAST, shrink) - ratio(m1, root)
    weighted = sums.withColumns(
        {
            "_a1": F.when(n == 3, F.sqrt(F.lit(0.5))).otherwise(last),
            "_a2": normal.polynomial(normal.WEIGHT_NEXT, shrink) - ratio(m2, root),
            "_end": F.col("_y1") - F.col("_x1"),
            "_next": F.col("_y2") - F.col("_x2"),
        }
    )
    end, nxt, mm, mx = (F.col(c) for c in ("_end", "_next", "_mm", "_mx"))
    one_pair = F.sqrt(ratio(mm - 2 * m1 * m1, 1.0 - 2 * a1 * a1))
    two_pairs = F.sqrt(ratio(mm - 2 * m1 * m1 - 2 * m2 * m2, 1.0 - 2 * a1 * a1 - 2 * a2 * a2))
    weighted = weighted.withColumn(
        "_linear",
        F.when(n == 3, a1 * end)
        .when(n <= 5, a1 * end + ratio(mx + m1 * end, one_pair))
        .otherwise(a1 * end + a2 * nxt + ratio(mx + m1 * end + m2 * nxt, two_pairs)),
    )
    w = F.least(ratio(F.col("_linear") * F.col("_linear"), F.col("_ss")), F.lit(1.0))
    return weighted.withColumn("w_stat", F.when((n >= 3) & (F.col("_ss") > 0), w))


def _significance(measured: DataFrame, keys: list[str], alpha: float) -> DataFrame:
    n, w, y, gamma = F.col("n"), F.col("w_stat"), F.col("_y"), F.col("_gamma")
    log_n = F.log(n)
    measured = measured.withColumns(
        {"_y": F.log(F.when(w < 1.0, 1.0 - w)), "_gamma": normal.polynomial(normal.SMALL_GAMMA, n)}
    )
    small = (-F.log(F.when(y < gamma, gamma - y)) - normal.polynomial(normal.SMALL_MEAN, n)) / F.exp(
        normal.polynomial(normal.SMALL_LOG_SD, n)
    )
    large = (y - normal.polynomial(normal.LARGE_MEAN, log_n)) / F.exp(normal.polynomial(normal.LARGE_LOG_SD, log_n))
    measured = measured.withColumn("_z", F.when(n <= 11, small).otherwise(large))
    of_three = F.greatest(F.lit(0.0), 6.0 / F.pi() * (F.asin(F.sqrt(w)) - F.asin(F.sqrt(F.lit(0.75)))))
    p = (
        F.when(w.isNull(), F.lit(None).cast("double"))
        .when(w >= 1.0, 1.0)
        .when(n == 3, of_three)
        .when((n <= 11) & (y >= gamma), 1e-99)
        .otherwise(normal.upper_tail(F.col("_z")))
    )
    status = (
        F.when(n < 3, "too_few_points")
        .when(~(F.col("_ss") > 0), "zero_range")
        .when(n > VALIDATED_UP_TO, "beyond_validated_n")
        .otherwise("ok")
    )
    return measured.withColumn("p_value", p).select(
        *keys, "n", "w_stat", "p_value", (F.col("p_value") > alpha).alias("is_normal"), status.alias("status")
    )
