"""Published constants the operators depend on.

These are fixed values taken from the quality standards; results are only right
when they match the standards digit for digit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Rating scale bounds.
RATING_MIN = 1
RATING_MAX = 10

# Risk thresholds.
RPN_HIGH_ABOVE = 100
RPN_YELLOW_FROM = 50
RPN_ACTION_H_FROM = 200
SEVERITY_CRITICAL_FROM = 9

# Action Priority bands of the 2019 harmonised handbook.
# severity from, to, occurrence from, to, then the priority for
# detection 7-10, detection 5-6, detection 2-4 and detection 1.
ACTION_PRIORITY = [
    (9, 10, 8, 10, "High", "High", "High", "High"),
    (9, 10, 6, 7, "High", "High", "High", "High"),
    (9, 10, 4, 5, "High", "High", "High", "Medium"),
    (9, 10, 2, 3, "High", "Medium", "Low", "Low"),
    (9, 10, 1, 1, "Low", "Low", "Low", "Low"),
    (7, 8, 8, 10, "High", "High", "High", "High"),
    (7, 8, 6, 7, "High", "High", "High", "Medium"),
    (7, 8, 4, 5, "High", "Medium", "Medium", "Medium"),
    (7, 8, 2, 3, "Medium", "Medium", "Low", "Low"),
    (7, 8, 1, 1, "Low", "Low", "Low", "Low"),
    (4, 6, 8, 10, "High", "High", "Medium", "Medium"),
    (4, 6, 6, 7, "Medium", "Medium", "Medium", "Low"),
    (4, 6, 4, 5, "Medium", "Low", "Low", "Low"),
    (4, 6, 2, 3, "Low", "Low", "Low", "Low"),
    (4, 6, 1, 1, "Low", "Low", "Low", "Low"),
    (2, 3, 8, 10, "Medium", "Medium", "Low", "Low"),
    (2, 3, 6, 7, "Low", "Low", "Low", "Low"),
    (2, 3, 4, 5, "Low", "Low", "Low", "Low"),
    (2, 3, 2, 3, "Low", "Low", "Low", "Low"),
    (2, 3, 1, 1, "Low", "Low", "Low", "Low"),
    (1, 1, 8, 10, "Low", "Low", "Low", "Low"),
    (1, 1, 6, 7, "Low", "Low", "Low", "Low"),
    (1, 1, 4, 5, "Low", "Low", "Low", "Low"),
    (1, 1, 2, 3, "Low", "Low", "Low", "Low"),
    (1, 1, 1, 1, "Low", "Low", "Low", "Low"),
]
DETECTION_BANDS = [(7, 10), (5, 6), (2, 4), (1, 1)]

# X-bar / R chart constants by subgroup size (n, A2, D3, D4, d2).
XBAR_R = [
    (2, 1.880, 0.000, 3.267, 1.128),
    (3, 1.023, 0.000, 2.574, 1.693),
    (4, 0.729, 0.000, 2.282, 2.059),
    (5, 0.577, 0.000, 2.114, 2.326),
    (6, 0.483, 0.000, 2.004, 2.534),
    (7, 0.419, 0.076, 1.924, 2.704),
    (8, 0.373, 0.136, 1.864, 2.847),
    (9, 0.337, 0.184, 1.816, 2.970),
    (10, 0.308, 0.223, 1.777, 3.078),
]

# X-bar / S chart constants by subgroup size (n, A3, B3, B4, c4).
XBAR_S = [
    (2, 2.659, 0.000, 3.267, 0.7979),
    (3, 1.954, 0.000, 2.568, 0.8862),
    (4, 1.628, 0.000, 2.266, 0.9213),
    (5, 1.427, 0.000, 2.089, 0.9400),
    (6, 1.287, 0.030, 1.970, 0.9515),
    (7, 1.182, 0.118, 1.882, 0.9594),
    (8, 1.099, 0.185, 1.815, 0.9650),
    (9, 1.032, 0.239, 1.761, 0.9693),
    (10, 0.975, 0.284, 1.716, 0.9727),
    (11, 0.927, 0.321, 1.679, 0.9754),
    (12, 0.886, 0.354, 1.646, 0.9776),
]

# Individuals / moving range chart, moving range of two.
IMR_LIMIT = 2.660
IMR_RANGE_LIMIT = 3.267
IMR_SIGMA = 1.128

# Gage study K constants by trials, appraisers and parts.
GAGE_K1 = [(2, 0.8862), (3, 0.5908)]
GAGE_K2 = [(2, 0.7071), (3, 0.5231)]
GAGE_K3 = [
    (2, 0.7071),
    (3, 0.5231),
    (4, 0.4467),
    (5, 0.4030),
    (6, 0.3742),
    (7, 0.3534),
    (8, 0.3375),
    (9, 0.3249),
    (10, 0.3146),
]
GAGE_NDC_FACTOR = 1.41
GAGE_NDC_MAX = 100

# Occurrence rank and "one in" incident rate it reaches up to.
OCCURRENCE_ONE_IN = [
    (1, 1500000),
    (2, 150000),
    (3, 15000),
    (4, 2000),
    (5, 400),
    (6, 80),
    (7, 20),
    (8, 8),
    (9, 3),
]

# Run rule names in rule-number order.
RULE_NAMES = [
    "Western Electric Rule 1",
    "Western Electric Rule 2",
    "Western Electric Rule 3",
    "Western Electric Rule 4",
    "Nelson Rule 5",
    "Nelson Rule 6",
    "Nelson Rule 7",
    "Nelson Rule 8",
]

# Chart keys a control plan may name.
CHART_KEYS = ["Xbar-R", "Xbar-S", "I-MR", "p", "c", "u"]

# Action states.
ACTION_STATUSES = ["Open", "In-Progress", "Closed"]

# Capability bands on Cpk.
CPK_CAPABLE_FROM = 1.33
CPK_MARGINAL_FROM = 1.00

# Sensor screening defaults.
SCREEN_MIN_PRESENT = 100
SCREEN_FREQ_RATIO = 19.0
SCREEN_PERCENT_UNIQUE = 0.10

# Fixed value: two-sided 95 % white-noise bound for lag-1 autocorrelation.
AUTOCORRELATION_Z = 1.96

# Labels of a tested unit.
UNIT_PASS = -1
UNIT_FAIL = 1


def lookup_table(spark: SparkSession, columns: str, rows: list[tuple]) -> DataFrame:
    """A constant table as an inline relation, so the planner sees its exact size."""

    def literal(value: object) -> str:
        if isinstance(value, str):
            return "'" + value.replace("'", "''") + "'"
        if isinstance(value, float):
            return f"{value!r}D"
        return str(value)

    body = ", ".join("(" + ", ".join(literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select * from values {body} as t({columns})")
