"""Sinks: fixed column orders and spreadsheet-safe CSV."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from shopfloor.functions import text
from shopfloor.operators.actions import ACTION_COLUMNS
from shopfloor.operators.plan import PLAN_COLUMNS
from shopfloor.sources.contracts import PLAN

RISK_REPORT_COLUMNS = [
    "ID",
    "Process_Step",
    "Component",
    "Failure_Mode",
    "Effect",
    "Severity",
    "Occurrence",
    "Detection",
    "RPN",
    "AP",
    "Risk_Tier",
    "Flag_High_RPN",
    "Flag_High_Severity",
    "Flag_Action_Priority_H",
]
STUDY_COLUMNS = ["part", "appraiser", "trial", "measurement"]


def sanitized(df: DataFrame) -> DataFrame:
    """Escape risky text cells of all string columns; numbers stay as they are."""

    def cell(f: T.StructField) -> Column:
        c = F.col(f"`{f.name}`")
        return text.spreadsheet_safe(c).alias(f.name) if isinstance(f.dataType, T.StringType) else c

    return df.select(*[cell(f) for f in df.schema.fields])


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    """UTF-8 CSV with header, one part file per partition, escaped for spreadsheets."""
    sanitized(df).write.mode(mode).option("header", True).option("escape", '"').csv(path)


def risk_report(df: DataFrame) -> DataFrame:
    """The report columns that are present, action columns last."""
    return df.select(*[c for c in [*RISK_REPORT_COLUMNS, *ACTION_COLUMNS] if c in df.columns])


def plan_export(plan: DataFrame) -> DataFrame:
    return plan.select(*PLAN_COLUMNS)


def checked_plan_export(plan: DataFrame, row_no: str) -> DataFrame:
    """The plan for export, after its contract: an edited plan that breaks it raises."""
    return plan_export(PLAN.require_valid(plan, row_no))


def study_export(study: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    return study.select(*keys, *STUDY_COLUMNS)


def gage_results_export(results: DataFrame, keys: tuple[str, ...] = ("study_id",)) -> DataFrame:
    """One formatted line per study."""
    return results.select(
        *keys,
        text.fixed_point(F.col("ev"), 6).alias("EV"),
        text.fixed_point(F.col("av"), 6).alias("AV"),
        text.fixed_point(F.col("grr"), 6).alias("GRR"),
        text.fixed_point(F.col("pv"), 6).alias("PV"),
        text.fixed_point(F.col("tv"), 6).alias("TV"),
        text.percent(F.col("pgrr_study")).alias("%GRR Study"),
        text.percent(F.col("pgrr_tolerance")).alias("%GRR Tolerance"),
        "ndc",
        F.col("verdict").alias("Verdict"),
        text.verdict_sentence(F.col("verdict")).alias("Verdict Interpretation"),
    )
