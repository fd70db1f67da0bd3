"""Points, polygons, distances and projections without a geometry library."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

#: The study area's ring (longitude, latitude).
STUDY_AREA = (
    (-60.5, 60.5), (-56.0, 60.5), (-51.0, 55.0), (-48.0, 52.0), (-44.0, 48.0), (-44.0, 45.0), (-49.0, 42.5), (-54.5, 44.0),
    (-58.5, 47.0), (-59.5, 50.5), (-56.5, 52.0), (-60.5, 56.0), (-60.5, 60.5),
)
EARTH_M, FLATTENING, MAJOR_M = 6_371_008.8, 1 / 298.257222101, 6_378_137.0


def in_box(lon: Column, lat: Column, west: float, south: float, east: float, north: float) -> Column:
    return lon.between(west, east) & lat.between(south, north)


def covers(lon: Column, lat: Column, ring: tuple = STUDY_AREA) -> Column:
    """Ray casting, with points on the boundary inside; null for null coordinates."""
    odd, edge = [], []
    for (x1, y1), (x2, y2) in zip(ring, ring[1:], strict=False):
        cross = (lon - x1) * (y2 - y1) - (lat - y1) * (x2 - x1)
        edge.append((cross == 0) & lon.between(min(x1, x2), max(x1, x2)) & lat.between(min(y1, y2), max(y1, y2)))
        if y1 != y2:
            at = x1 + (lat - y1) * (x2 - x1) / (y2 - y1)
            odd.append(F.when(((lat < y1) != (lat < y2)) & (lon < at), 1).otherwise(0))
    return (reduce(lambda a, b: a + b, odd) % 2 == 1) | reduce(lambda a, b: a | b, edge)


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(F.least(F.lit(1.0), a)))


# Fixed values of the conic projection: standard parallels, origin.
CONIC = {"first": 49.0, "second": 77.0, "lat": 49.0, "lon": -95.0}


def conic_constants() -> tuple[float, float, float, float]:
    """(n, F, rho0, e) of the Lambert conformal conic with two parallels."""
    e = math.sqrt(FLATTENING * (2 - FLATTENING))
    m = lambda p: math.cos(p) / math.sqrt(1 - (e * math.sin(p)) ** 2)
    t = lambda p: math.tan(math.pi / 4 - p / 2) / ((1 - e * math.sin(p)) / (1 + e * math.sin(p))) ** (e / 2)
    a, b, o = (math.radians(CONIC[k]) for k in ("first", "second", "lat"))
    n = (math.log(m(a)) - math.log(m(b))) / (math.log(t(a)) - math.log(t(b)))
    f = m(a) / (n * t(a) ** n)
    return n, f, MAJOR_M * f * t(o) ** n, e


def conic(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Planar metres of longitude and latitude."""
    n, f, rho0, e = conic_constants()
    p = F.radians(lat)
    t = F.tan(math.pi / 4 - p / 2) / F.pow((1 - e * F.sin(p)) / (1 + e * F.sin(p)), F.lit(e / 2))
    rho = MAJOR_M * f * F.pow(t, F.lit(n))
    theta = n * F.radians(lon - CONIC["lon"])
    return rho * F.sin(theta), rho0 - rho * F.cos(theta)


def equal_area(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Cylindrical equal-area metres (true at 30 degrees), for areas only."""
    e2 = FLATTENING * (2 - FLATTENING)
    e = math.sqrt(e2)
    k = math.cos(math.radians(30)) / math.sqrt(1 - e2 * 0.25)
    s = F.sin(F.radians(lat))
    q = (1 - e2) * (s / (1 - e2 * s * s) - F.log((1 - e * s) / (1 + e * s)) / (2 * e))
    return MAJOR_M * k * F.radians(lon), MAJOR_M * q / (2 * k)


def geodesic(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray) -> np.ndarray:
    """Vincenty's inverse on the ellipsoid; near-antipodal points that don't converge are NaN."""
    b = MAJOR_M * (1 - FLATTENING)
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(v))) for v in (lat1, lat2))
    diff = np.radians(np.asarray(lon2) - np.asarray(lon1))
    lam = diff.copy()
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(60):
            sin_s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            cos_s = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(sin_s, cos_s)
            sin_a = np.where(sin_s == 0, 0, np.cos(u1) * np.cos(u2) * np.sin(lam) / sin_s)
            cos2 = 1 - sin_a**2
            mid = np.where(cos2 == 0, 0, cos_s - 2 * np.sin(u1) * np.sin(u2) / cos2)
            c = FLATTENING / 16 * cos2 * (4 + FLATTENING * (4 - 3 * cos2))
            new = diff + (1 - c) * FLATTENING * sin_a * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            done = np.abs(new - lam) < 1e-12
            lam = new
            if done.all():
                break
        u = cos2 * (MAJOR_M**2 - b**2) / b**2
        big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        shift = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        return np.where(sin_s == 0, 0.0, np.where(done, b * big * (sigma - shift), np.nan))


@F.pandas_udf(DoubleType())
def geodesic_m(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    return pd.Series(geodesic(*(v.to_numpy(float) for v in (lon1, lat1, lon2, lat2))))


def shoelace(ring: list[tuple[float, float]]) -> float:
    return abs(sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True))) / 2


def clip_convex(subject: list[tuple[float, float]], clip: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Sutherland-Hodgman: a polygon inside a convex counter-clockwise one."""
    out = subject
    for (ax, ay), (bx, by) in zip(clip, clip[1:] + clip[:1], strict=True):
        side = lambda p: (bx - ax) * (p[1] - ay) - (by - ay) * (p[0] - ax)  # noqa: B023, E731
        given, out = out, []
        for p, q in zip(given, given[1:] + given[:1], strict=True):
            sp, sq = side(p), side(q)
            if sp >= 0:
                out.append(p)
            if (sp >= 0) != (sq >= 0):
                k = sp / (sp - sq)
                out.append((p[0] + k * (q[0] - p[0]), p[1] + k * (q[1] - p[1])))
    return out


def conic_inverse(x: Column, y: Column) -> tuple[Column, Column]:
    """Longitude and latitude of planar metres; the latitude by six fixed steps, which is exact to a double here."""
    n, f, rho0, e = conic_constants()
    rho, theta = F.hypot(x, rho0 - y), F.atan2(x, rho0 - y)
    t = F.pow(rho / (MAJOR_M * f), F.lit(1 / n))
    p = math.pi / 2 - 2 * F.atan(t)
    for _ in range(6):
        p = math.pi / 2 - 2 * F.atan(t * F.exp(-e * F.atanh(e * F.sin(p))))
    return F.degrees(theta / n) + CONIC["lon"], F.degrees(p)
