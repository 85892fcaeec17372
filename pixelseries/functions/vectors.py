"""Arrays as vectors: standardisation, encodings of the day of year, fusion, linear maps."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON = 1e-9


def standardized(values: Column, mean: Sequence[float], std: Sequence[float]) -> Column:
    """(v - mean) / (std + 1e-9), band by band."""
    stats = F.array(*(F.struct(F.lit(float(m)).alias("m"), F.lit(float(s)).alias("s")) for m, s in zip(mean, std, strict=True)))
    return F.zip_with(values, stats, lambda v, b: (v - b["m"]) / (b["s"] + EPSILON))


def doy_encoding(doy: Column, width: int) -> Column:
    """Alternating sine and cosine of the raw day at the frequencies 10000 ** (-2i / width)."""
    terms = [g(doy * math.exp(-math.log(10000.0) * 2 * i / width)) for i in range(width // 2) for g in (F.sin, F.cos)]
    return F.array(*terms)


def doy_frequencies(doy: Column, n: int) -> Column:
    """Sines, then cosines, of the day as a part of the year at n frequencies from 1 to 365, evenly spaced in logarithm."""
    angle = doy / 365.0 * (2 * math.pi)
    steps = [math.exp(math.log(365.0) * k / max(1, n - 1)) for k in range(n)]
    return F.array(*(F.sin(angle * f) for f in steps), *(F.cos(angle * f) for f in steps))


def fused(a: Column, b: Column, how: str) -> Column:
    """Two vectors as one: 'concat' or 'sum'."""
    if how == "concat":
        return F.concat(a, b)
    if how == "sum":
        return F.zip_with(a, b, lambda x, y: x + y)
    raise ValueError(f"unknown fusion method {how!r}")


def linear(x: Column, weights: Sequence[Sequence[float]], bias: Sequence[float]) -> Column:
    """W x + b; the weights are small and travel with the plan."""
    rows = []
    for row, b in zip(weights, bias, strict=True):
        w = F.array(*(F.lit(float(v)) for v in row))
        rows.append(F.aggregate(F.zip_with(x, w, lambda a, c: a * c), F.lit(float(b)), lambda acc, v: acc + v))
    return F.array(*rows)


def relu(x: Column) -> Column:
    return F.transform(x, lambda v: F.greatest(F.lit(0.0), v))


def any_nonzero(x: Column) -> Column:
    return F.exists(x, lambda v: v != 0)


def allclose(a: Column, b: Column, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    return F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= F.lit(atol) + F.abs(y) * rtol), lambda ok: ok)
