"""Arithmetic that stays null-safe under ANSI mode."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ratio(top: Column, bottom: Column) -> Column:
    """top / bottom, null when the divisor is zero (ANSI division would fail the job)."""
    return top / F.when(bottom != 0, bottom)
