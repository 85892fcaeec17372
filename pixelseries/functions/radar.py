"""Radar amplitude."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HIGHEST_CODE = 32767


def finite_positive(amp: Column) -> Column:
    """Spark orders NaN above all numbers, so it is excluded by name."""
    return F.coalesce((amp > 0) & ~F.isnan(amp) & (amp < F.lit(float("inf"))), F.lit(False))


def db_code(amp: Column, mask: Column | None = None) -> Column:
    """Amplitude as a code of 200 steps a decibel above -50 dB, from 0 to 32767; 0 for what is not finite, not above 0 or
    outside the mask."""
    ok = finite_positive(amp) if mask is None else finite_positive(amp) & (mask > 0)
    code = F.floor(F.least(F.lit(float(HIGHEST_CODE)), F.greatest(F.lit(0.0), (F.log10(amp) * 20 + 50) * 200)))
    return F.when(ok, code.cast("int")).otherwise(0)


def orbit_name(orbit: Column) -> Column:
    return F.coalesce(orbit, F.lit("unknown"))
