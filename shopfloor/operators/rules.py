"""Run rules on control charts: the four Western Electric and four Nelson rules.

All eight rules are window functions over one partitioning and one order, so a
chart's rules cost a single shuffle whatever the rule set.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shopfloor.functions import fixed

RULE_SETS = {"we": 4, "nelson": 8}


def rule_count(rule_set: str) -> int:
    try:
        return RULE_SETS[rule_set]
    except KeyError:
        raise ValueError(f"rule_set must be one of {sorted(RULE_SETS)}, got {rule_set!r}") from None


def with_rules(
    df: DataFrame,
    partition: Sequence[str],
    seq: str,
    value: str,
    center: str,
    sigma: str,
    rule_set: str = "nelson",
    out: str = "rules",
) -> DataFrame:
    """Add the array of rule numbers that fire at each point.

    A rule fires at the last point of its window. ``seq`` is the 0-based position
    in the whole group; rows must carry enough predecessors in ``partition`` for
    a 15-point frame. A sigma that is null or not positive fires nothing.
    """
    # Written as SQL text: the same expressions built call by call took longer than running them on a small chart.
    wanted = rule_count(rule_set)
    i, s, v, mid = (f"`{name}`" for name in (seq, sigma, value, center))
    over = f"partition by {', '.join(f'`{p}`' for p in partition)} order by {i}"
    so_far = f"({over} rows between unbounded preceding and current row)"

    # Looking back over a few points is a lag each, and "k in a row" is the distance
    # to the last point that broke the row: both cost the same whatever the window
    # length, where a sliding ROWS sum is recomputed over its frame at every point.
    def latest(condition: str) -> str:
        """Position of the last point meeting the condition, before the first point if none."""
        return f"coalesce(max(if({condition}, {i}, null)) over {so_far}, _start - 1)"

    def in_a_row(condition: str, points: int) -> str:
        return f"{i} - {latest(f'not coalesce({condition}, false)')} >= {points}"

    def one_sided(multiple: str, points: int, needed: int) -> str:
        window = ["_c", *[f"_c{k}" for k in range(1, points)]]
        above = " + ".join(f"if({x} > {multiple} * {s}, 1, 0)" for x in window)
        below = " + ".join(f"if({x} < -({multiple} * {s}), 1, 0)" for x in window)
        return f"{i} >= {points - 1} and ({above} >= {needed} and {below} = 0 or {below} >= {needed} and {above} = 0)"

    fired = [
        f"abs(_c) > 3.0D * {s}",
        one_sided("2.0D", 3, 2),
        one_sided("1.0D", 5, 4),
        f"{in_a_row('_c > 0', 8)} or {in_a_row('_c < 0', 8)}",
    ]
    helpers = [f"lag(_c, {k}) over ({over}) as _c{k}" for k in range(1, 5)] + [f"min({i}) over {so_far} as _start"]
    staged = df.selectExpr("*", f"{v} - {mid} as _c")
    if wanted > 4:
        fired += [
            f"{in_a_row('_d > 0', 5)} or {in_a_row('_d < 0', 5)}",
            in_a_row("_turn < 0", 12),
            in_a_row(f"abs(_c) < {s}", 15),
            f"{in_a_row(f'abs(_c) > {s}', 8)} and {i} - {latest('_c > 0')} < 8 and {i} - {latest('_c < 0')} < 8",
        ]
        staged = staged.selectExpr("*", *helpers, f"signum({v} - lag({v}) over ({over})) as _d")
        staged = staged.selectExpr("*", f"_d * lag(_d) over ({over}) as _turn")
    else:
        staged = staged.selectExpr("*", *helpers)
    numbers = ", ".join(f"if({s} > 0 and ({rule}), {no}, null)" for no, rule in enumerate(fired, 1))
    return staged.selectExpr(*[f"`{c}`" for c in df.columns if c != out], f"array_compact(array({numbers})) as `{out}`")


def rule_name(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(n) for n in fixed.RULE_NAMES]), number)


def rule_names(numbers: Column) -> Column:
    return F.transform(numbers, rule_name)


def violations(charted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per point and rule: ``columns`` plus ``rule_no`` and ``rule``."""
    fired = charted.select(*columns, F.explode("rules").alias("rule_no"))
    return fired.withColumn("rule", rule_name(F.col("rule_no")))
