"""Text formatting, escaping and fixed sentences used in reports and exports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_point(value: Column, digits: int) -> Column:
    """Plain decimal text; null becomes N/A and infinity becomes inf."""
    text = F.format_string(f"%.{digits}f", value)
    return (
        F.when(value.isNull(), "N/A")
        .when(value == F.lit(float("inf")), "inf")
        .otherwise(text)
    )


def percent(value: Column, digits: int = 2) -> Column:
    text = F.concat(fixed_point(value, digits), F.lit("%"))
    return F.when(value.isNull(), "N/A").otherwise(text)


def spreadsheet_safe(value: Column) -> Column:
    """Prefix an apostrophe where a spreadsheet could run the text as a formula."""
    risky = value.rlike(r"^[=+\-@\t\r]") | value.rlike(r"^\s+[=+\-@]")
    return F.when(risky, F.concat(F.lit("'"), value)).otherwise(value)


def blank_to_null(value: Column) -> Column:
    return F.when(F.trim(value) != "", value)


def reaction_plan(effect: Column) -> Column:
    return F.concat(F.lit("Contain and investigate; failure effect: "), effect, F.lit("."))


# Verdict sentences of a gage study report.
VERDICT_SENTENCES = [
    ("Accept", "Accept — ndc >= 5 and %GRR < 10%. Measurement system is adequate for the intended use."),
    ("Marginal", "Marginal — ndc 2-4 or %GRR 10-30%. Acceptable for some uses; consider an improvement plan."),
    ("Reject", "Reject — ndc < 2 or %GRR > 30%. Measurement system is inadequate and must be improved."),
]
VERDICT_UNKNOWN = "Unrecognized verdict — review the study inputs."


def verdict_sentence(verdict: Column) -> Column:
    out = None
    for name, sentence in VERDICT_SENTENCES:
        out = F.when(verdict == name, sentence) if out is None else out.when(verdict == name, sentence)
    return out.otherwise(VERDICT_UNKNOWN)


# Sentences of the reports, part of their output.
NOTE_STABLE = "In statistical control"
NOTE_SIGNALS = " WE signal(s) — Cpk indicative only"
WARNING_BEFORE = "Process is not in statistical control — "
WARNING_AFTER = (
    " signal(s) detected on the control chart. Capability indices (Cp/Cpk/Pp/Ppk) are not a "
    "valid capability claim until the process is stabilized; treat these values as indicative only."
)
PROMPT_BEFORE, PROMPT_POINTS, PROMPT_CAUSE = "Characteristic '", "' went out of statistical control (", "). Source cause '"
PROMPT_UNLINKED = "an unlinked cause (no Control Plan source found)"
PROMPT_RATED, PROMPT_SUGGESTED = "' is currently rated Occurrence ", "; the observed out-of-control rate maps to a candidate Occurrence "
PROMPT_AFTER = (
    " (AIAG-4 / SAE J1739 occurrence rate table). Review the occurrence rating / open a CAPA — this is a "
    "candidate, not an applied change."
)


def stability_note(signals: Column) -> Column:
    """Short stability text of a capability report."""
    return F.when(signals == 0, NOTE_STABLE).otherwise(
        F.concat(signals.cast("string"), F.lit(NOTE_SIGNALS))
    )


def stability_warning(signals: Column, rule_set: str) -> Column:
    """Long warning attached to capability of a sensor; null when stable."""
    return F.when(
        signals > 0,
        F.concat(
            F.lit(WARNING_BEFORE),
            signals.cast("string"),
            F.lit(f" {rule_set}{WARNING_AFTER}"),
        ),
    )


def capa_prompt(
    characteristic: Column, points: Column, rules: Column, cause: Column, current: Column, suggested: Column
) -> Column:
    return F.concat(
        F.lit(PROMPT_BEFORE),
        characteristic,
        F.lit(PROMPT_POINTS),
        points.cast("string"),
        F.lit(" point(s), "),
        F.concat_ws(", ", rules),
        F.lit(PROMPT_CAUSE),
        F.coalesce(cause, F.lit(PROMPT_UNLINKED)),
        F.lit(PROMPT_RATED),
        F.coalesce(current.cast("string"), F.lit("unknown")),
        F.lit(PROMPT_SUGGESTED),
        suggested.cast("string"),
        F.lit(PROMPT_AFTER),
    )
