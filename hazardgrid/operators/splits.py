"""Splits by date that keep later rows out of training."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def split_by_date(rows: DataFrame, cutoff: date, field: str = "occurred_on") -> tuple[DataFrame, DataFrame]:
    """(train, test): rows strictly before the cutoff, and the others. A row without a date is in
    neither."""
    return rows.where(F.col(field) < F.lit(cutoff)), rows.where(F.col(field) >= F.lit(cutoff))
