"""Coordinate systems as native column arithmetic: reprojection and metre conversion."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# WGS84 ellipsoid, UTM scale and false origins, spherical web-map radius,
# geographic codes measured in degrees, and the metres-per-degree series.
SEMI_MAJOR = 6378137.0
FLATTENING = 1.0 / 298.257223563
UTM_SCALE = 0.9996
FALSE_EASTING = 500000.0
FALSE_NORTHING_SOUTH = 10000000.0
GEOGRAPHIC_CODES = ("EPSG:4326", "EPSG:4258", "EPSG:4269", "EPSG:4267", "EPSG:4283", "OGC:CRS84")
METRES_PER_DEGREE_SERIES = (111132.92, -559.82, 1.175, -0.0023)


def is_geographic(crs: str) -> bool:
    if not crs:
        raise ValueError("coordinate system is unknown")
    return crs.upper() in GEOGRAPHIC_CODES


def meters_per_degree(latitude) -> Column:
    """Length in metres of one degree of latitude on the ellipsoid."""
    lat = F.radians(latitude)
    base, *waves = METRES_PER_DEGREE_SERIES
    terms = [F.lit(w) * F.cos(lat * (2.0 * (i + 1))) for i, w in enumerate(waves)]
    return reduce(lambda acc, t: acc + t, terms, F.lit(base))


def meters_per_degree_value(latitude: float) -> float:
    lat = math.radians(latitude)
    base, *waves = METRES_PER_DEGREE_SERIES
    return base + sum(w * math.cos(lat * 2 * (i + 1)) for i, w in enumerate(waves))


def to_crs_units(meters, crs: str, latitude) -> Column:
    value = meters if isinstance(meters, Column) else F.lit(float(meters))
    return value / meters_per_degree(latitude) if is_geographic(crs) else value


def to_meters(units, crs: str, latitude) -> Column:
    value = units if isinstance(units, Column) else F.lit(float(units))
    return value * meters_per_degree(latitude) if is_geographic(crs) else value


def _krueger():
    """Series constants of the transverse Mercator projection to third order in n."""
    n = FLATTENING / (2.0 - FLATTENING)
    radius = SEMI_MAJOR / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forward = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16,
               13 * n**2 / 48 - 3 * n**3 / 5,
               61 * n**3 / 240)
    inverse = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96,
               n**2 / 48 + n**3 / 15,
               17 * n**3 / 480)
    geodetic = (2 * n - 2 * n**2 / 3 - 2 * n**3,
                7 * n**2 / 3 - 8 * n**3 / 5,
                56 * n**3 / 15)
    return n, radius, forward, inverse, geodetic


def _utm_zone(crs: str):
    """(central meridian in radians, false northing) of an EPSG:326zz / 327zz code, else None."""
    code = crs.upper().removeprefix("EPSG:")
    if len(code) == 5 and code.isdigit() and code[:3] in ("326", "327") and 1 <= int(code[3:]) <= 60:
        meridian = math.radians(int(code[3:]) * 6 - 183)
        return meridian, (0.0 if code[:3] == "326" else FALSE_NORTHING_SOUTH)
    return None


def _total(columns):
    return reduce(lambda a, b: a + b, columns)


def _utm_forward(lon: Column, lat: Column, zone) -> tuple[Column, Column]:
    meridian, false_northing = zone
    n, radius, alpha, _, _ = _krueger()
    phi, lam = F.radians(lat), F.radians(lon) - F.lit(meridian)
    root = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(phi)) - F.atanh(F.sin(phi) * root) * root)
    xi = F.atan2(t, F.cos(lam))
    eta = F.atanh(F.sin(lam) / F.sqrt(t * t + 1.0))
    east = eta + _total([F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * a
                         for j, a in enumerate(alpha, 1)])
    north = xi + _total([F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * a
                         for j, a in enumerate(alpha, 1)])
    scale = UTM_SCALE * radius
    return east * scale + FALSE_EASTING, north * scale + false_northing


def _utm_inverse(x: Column, y: Column, zone) -> tuple[Column, Column]:
    meridian, false_northing = zone
    _, radius, _, beta, delta = _krueger()
    scale = UTM_SCALE * radius
    xi, eta = (y - false_northing) / scale, (x - FALSE_EASTING) / scale
    xi2 = xi - _total([F.sin(xi * (2.0 * j)) * F.cosh(eta * (2.0 * j)) * b
                       for j, b in enumerate(beta, 1)])
    eta2 = eta - _total([F.cos(xi * (2.0 * j)) * F.sinh(eta * (2.0 * j)) * b
                         for j, b in enumerate(beta, 1)])
    chi = F.asin(F.sin(xi2) / F.cosh(eta2))
    phi = chi + _total([F.sin(chi * (2.0 * j)) * d for j, d in enumerate(delta, 1)])
    lam = F.atan2(F.sinh(eta2), F.cos(xi2)) + meridian
    return F.degrees(lam), F.degrees(phi)


def _to_degrees(x: Column, y: Column, crs: str) -> tuple[Column, Column]:
    zone = _utm_zone(crs)
    if zone:
        return _utm_inverse(x, y, zone)
    if crs.upper() == "EPSG:3857":
        return (F.degrees(x / SEMI_MAJOR),
                F.degrees(F.atan(F.exp(y / SEMI_MAJOR)) * 2.0 - math.pi / 2))
    if crs.upper() in ("EPSG:4326", "OGC:CRS84"):
        return x, y
    raise ValueError(f"no closed-form transform from {crs!r}")


def _from_degrees(lon: Column, lat: Column, crs: str) -> tuple[Column, Column]:
    zone = _utm_zone(crs)
    if zone:
        return _utm_forward(lon, lat, zone)
    if crs.upper() == "EPSG:3857":
        return (F.radians(lon) * SEMI_MAJOR,
                F.log(F.tan(F.radians(lat) / 2.0 + math.pi / 4)) * SEMI_MAJOR)
    if crs.upper() in ("EPSG:4326", "OGC:CRS84"):
        return lon, lat
    raise ValueError(f"no closed-form transform to {crs!r}")


def transform_xy(x: Column, y: Column, src: str, dst: str) -> tuple[Column, Column]:
    if src == dst:
        return x, y
    if not src or not dst:
        raise ValueError("both coordinate systems must be known to reproject")
    return _from_degrees(*_to_degrees(x, y, src), dst)


def reproject(df: DataFrame, src: str, dst: str, x: str = "x", y: str = "y") -> DataFrame:
    """B1: move points between EPSG:4326, UTM zones and EPSG:3857; no-op on equal codes."""
    if src == dst:
        return df
    nx, ny = transform_xy(F.col(x), F.col(y), src, dst)
    return df.withColumns({x: nx, y: ny})
