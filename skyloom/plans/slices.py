"""Named slices of the observations and presets built from them."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skyloom.operators import sampling
from skyloom.sources.tables import fan_out

# Slice centres in hours, the single year, and two points with tolerance.
MIDDAY_HOUR, MIDNIGHT_HOUR, HALF_WIDTH = 10.5, 22.5, 0.5
SINGLE_YEAR = 2017


def hour_slice(centre: float, half_width: float = HALF_WIDTH) -> Column:
    return F.col("hour_of_day").between(centre - half_width, centre + half_width)


def months_slice(keys: list[str]) -> Column:
    return F.col("partition_key").isin(keys)


def point_slice(lon: float, lat: float, tol_deg: float) -> Column:
    return F.col("longitude").between(lon - tol_deg, lon + tol_deg) & F.col("latitude").between(
        lat - tol_deg, lat + tol_deg
    )


def month_keys(start: date, end: date) -> list[str]:
    """Month keys from start (included) to end (excluded)."""
    first, last = start.year * 12 + start.month - 1, end.year * 12 + end.month - 1
    return [f"{m // 12:04d}-{m % 12 + 1:02d}" for m in range(first, last)]


def outlier_slices() -> dict[str, Column]:
    return {label: months_slice(month_keys(a, b)) for label, a, b in sampling.OUTLIER_PERIODS}


def standard_slices() -> dict[str, Column]:
    """Outlier periods plus the hour and year slices."""
    return {
        **outlier_slices(),
        "hour_midday": hour_slice(MIDDAY_HOUR),
        "hour_midnight": hour_slice(MIDNIGHT_HOUR),
        "single_year_2017": F.col("year") == SINGLE_YEAR,
    }


def slice_counts(df: DataFrame, slices: dict[str, Column]) -> DataFrame:
    """Rows per slice from one pass."""
    return fan_out(df, slices).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
