"""Scalar helpers on columns: missing values, rounding, clamping, byte encoding."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(v: Column, nodata: float | None) -> Column:
    """v, or null where it is NaN or within 1e-6 of the sentinel (a NaN or absent sentinel leaves only NaN missing)."""
    missing = F.isnan(v)
    if nodata is not None and nodata == nodata:
        missing = missing | (F.abs(v - F.lit(float(nodata))) <= 1e-6)
    return F.when(~missing, v)


def half_up(v: Column) -> Column:
    """Nearest integer, halves upwards also below zero."""
    return F.floor(v + 0.5)


def fixed(v: Column, digits: int = 6) -> Column:
    """v to so many decimals, by the same arithmetic in any engine."""
    return F.floor(v * 10.0**digits + 0.5) / 10.0**digits


def clamp(v: Column, low, high) -> Column:
    """v between two bounds; a null v stays null."""
    return F.when(v.isNotNull(), F.least(F.greatest(v, F.lit(low)), F.lit(high)))


def to_byte(v: Column) -> Column:
    """0 to 255 for values from 0 to 1; missing is 0."""
    return F.coalesce(half_up(clamp(v.cast("double"), 0.0, 1.0) * 255), F.lit(0)).cast("int")


def stretch(v: Column, low, high) -> Column:
    """(v - low) / (high - low) within 0 and 1; a range of zero counts as one."""
    low, high = (x if isinstance(x, Column) else F.lit(float(x)) for x in (low, high))
    width = F.when(high - low == 0, F.lit(1.0)).otherwise(high - low)
    return F.when(v.isNotNull(), (F.greatest(low, F.least(high, v)) - low) / width)
