"""UTM zones and the transverse Mercator projection as column arithmetic (WGS84, Krueger's series to the fifth order)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

A, FLAT = 6378137.0, 1 / 298.257223563
N = FLAT / (2 - FLAT)
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0
RADIUS = A / (1 + N) * (1 + N**2 / 4 + N**4 / 64 + N**6 / 256)
ECC = 2 * N**0.5 / (1 + N)
#: Series coefficients in the third flattening, lowest order first (Karney 2011).
ALPHA = (
    N / 2 - 2 * N**2 / 3 + 5 * N**3 / 16 + 41 * N**4 / 180 - 127 * N**5 / 288,
    13 * N**2 / 48 - 3 * N**3 / 5 + 557 * N**4 / 1440 + 281 * N**5 / 630,
    61 * N**3 / 240 - 103 * N**4 / 140 + 15061 * N**5 / 26880,
    49561 * N**4 / 161280 - 179 * N**5 / 168,
    34729 * N**5 / 80640,
)
BETA = (
    N / 2 - 2 * N**2 / 3 + 37 * N**3 / 96 - N**4 / 360 - 81 * N**5 / 512,
    N**2 / 48 + N**3 / 15 - 437 * N**4 / 1440 + 46 * N**5 / 105,
    17 * N**3 / 480 - 37 * N**4 / 840 - 209 * N**5 / 4480,
    4397 * N**4 / 161280 - 11 * N**5 / 504,
    4583 * N**5 / 161280,
)
#: From conformal to geographic latitude.
DELTA = (
    2 * N - 2 * N**2 / 3 - 2 * N**3 + 116 * N**4 / 45 + 26 * N**5 / 45,
    7 * N**2 / 3 - 8 * N**3 / 5 - 227 * N**4 / 45 + 2704 * N**5 / 315,
    56 * N**3 / 15 - 136 * N**4 / 35 - 1262 * N**5 / 105,
    4279 * N**4 / 630 - 332 * N**5 / 35,
    4174 * N**5 / 315,
)


def simple_zone(lon: Column) -> Column:
    """Zone by longitude alone, 1 to 60."""
    return F.least(F.lit(60), F.greatest(F.lit(1), (F.floor((lon + 180) / 6) + 1).cast("int")))


def utm_zone(lon: Column, lat: Column) -> Column:
    """Zone with the exceptions of southern Norway and Svalbard."""
    svalbard = (lat >= 72) & (lat < 84)
    return (
        F.when((lat >= 56) & (lat < 64) & (lon >= 3) & (lon < 12), 32)
        .when(svalbard & (lon >= 0) & (lon < 9), 31)
        .when(svalbard & (lon >= 9) & (lon < 21), 33)
        .when(svalbard & (lon >= 21) & (lon < 33), 35)
        .when(svalbard & (lon >= 33) & (lon < 42), 37)
        .otherwise(simple_zone(lon))
    )


def epsg(zone: Column, lat: Column) -> Column:
    """326xx from the equator northward, 327xx south of it."""
    return zone + F.when(lat >= 0, 32600).otherwise(32700)


def to_utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres; northing with the southern false origin below the equator."""
    lam = F.radians(lon - (zone * 6 - 183))
    s = F.sin(F.radians(lat))
    t = F.sinh(F.atanh(s) - F.lit(ECC) * F.atanh(F.lit(ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.asinh(F.sin(lam) / F.sqrt(t * t + F.cos(lam) * F.cos(lam)))
    x, y = eta, xi
    for j, a in enumerate(ALPHA, 1):
        x = x + F.lit(a) * F.cos(xi * 2 * j) * F.sinh(eta * 2 * j)
        y = y + F.lit(a) * F.sin(xi * 2 * j) * F.cosh(eta * 2 * j)
    return F.lit(FALSE_EAST) + x * (K0 * RADIUS), y * (K0 * RADIUS) + F.when(lat < 0, FALSE_NORTH).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude of UTM metres."""
    xi = (north - F.when(south, FALSE_NORTH).otherwise(0.0)) / (K0 * RADIUS)
    eta = (east - FALSE_EAST) / (K0 * RADIUS)
    x, y = eta, xi
    for j, b in enumerate(BETA, 1):
        x = x - F.lit(b) * F.cos(xi * 2 * j) * F.sinh(eta * 2 * j)
        y = y - F.lit(b) * F.sin(xi * 2 * j) * F.cosh(eta * 2 * j)
    chi = F.asin(F.sin(y) / F.cosh(x))  # conformal latitude
    lat = chi
    for j, c in enumerate(DELTA, 1):
        lat = lat + F.lit(c) * F.sin(chi * 2 * j)
    return F.degrees(F.atan2(F.sinh(x), F.cos(y))) + (zone * 6 - 183), F.degrees(lat)
