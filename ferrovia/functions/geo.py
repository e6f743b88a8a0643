"""Distances and bounds as Column expressions; the ellipsoid's in Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

KM_PER_DEGREE = 111.0


def distance_km(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Equirectangular distance: 111 km for a degree, longitude by the cosine of the mean latitude."""
    north = (lat2 - lat1) * KM_PER_DEGREE
    east = (lng2 - lng1) * KM_PER_DEGREE * F.cos(F.radians((lat1 + lat2) / 2))
    return F.sqrt(north * north + east * east)


def haversine_m(lng1: Column, lat1: Column, lng2: Column, lat2: Column) -> Column:
    """Great-circle metres on a sphere of 6,371,008.8 m; within 0.6 % of the ellipsoid."""
    half = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.asin(F.sqrt(half)) * (2 * 6371008.8)


#: The WGS84 ellipsoid, metres and flattening.
MAJOR_M, FLATTENING = 6378137.0, 1 / 298.257223563
MINOR_M = MAJOR_M * (1 - FLATTENING)


def inverse_m(lng1: np.ndarray, lat1: np.ndarray, lng2: np.ndarray, lat2: np.ndarray, rounds: int = 100) -> np.ndarray:
    """Vincenty's inverse formula, within a millimetre; NaN for a pair of nearly opposite points for which it doesn't settle."""
    u1, u2 = (np.arctan((1 - FLATTENING) * np.tan(np.radians(x))) for x in (lat1, lat2))
    (s1, c1), (s2, c2) = ((np.sin(u), np.cos(u)) for u in (u1, u2))
    apart = np.radians((lng2 - lng1 + 180) % 360 - 180)
    lam, settled = apart.copy(), np.zeros(len(apart), bool)
    with np.errstate(invalid="ignore", divide="ignore"):
        for _ in range(rounds):
            sin_l, cos_l = np.sin(lam), np.cos(lam)
            sin_s = np.hypot(c2 * sin_l, c1 * s2 - s1 * c2 * cos_l)
            cos_s = s1 * s2 + c1 * c2 * cos_l
            sigma = np.arctan2(sin_s, cos_s)
            alpha = np.where(sin_s > 0, c1 * c2 * sin_l / sin_s, 0.0)
            cos2a = 1 - alpha**2
            mid = np.where(cos2a > 1e-15, cos_s - 2 * s1 * s2 / cos2a, 0.0)
            c = FLATTENING / 16 * cos2a * (4 + FLATTENING * (4 - 3 * cos2a))
            new = apart + (1 - c) * FLATTENING * alpha * (sigma + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        k = cos2a * (MAJOR_M**2 - MINOR_M**2) / MINOR_M**2
        a = 1 + k / 16384 * (4096 + k * (-768 + k * (320 - 175 * k)))
        b = k / 1024 * (256 + k * (-128 + k * (74 - 47 * k)))
        turn = b * sin_s * (mid + b / 4 * (cos_s * (2 * mid**2 - 1) - b / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
        return np.where(settled, MINOR_M * a * (sigma - turn), np.nan)


@F.arrow_udf(T.DoubleType())
def geodesic_m(lng1: pa.Array, lat1: pa.Array, lng2: pa.Array, lat2: pa.Array) -> pa.Array:
    """Metres on the ellipsoid; null where a coordinate is null or the formula doesn't settle (see haversine_m)."""
    found = inverse_m(*(x.to_numpy(zero_copy_only=False).astype(float) for x in (lng1, lat1, lng2, lat2)))
    return pa.array(found, mask=np.isnan(found))


def in_bounds(lng: Column, lat: Column, west: float = 70, east: float = 140, south: float = 15, north: float = 55) -> Column:
    return lng.between(west, east) & lat.between(south, north)


def trajectory_km(points: Column) -> Column:
    """Length of an array of (lng, lat) structs."""
    n = F.size(points)
    steps = F.zip_with(F.slice(points, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(points, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: distance_km(a["lng"], a["lat"], b["lng"], b["lat"]))
    return F.aggregate(steps, F.lit(0.0), lambda total, x: total + x)


def segment(points: Column, i: Column, j: Column) -> Column:
    """points[i..j] inclusive (from 0), reversed if i > j."""
    part = F.slice(points, F.least(i, j) + 1, F.abs(i - j) + 1)
    return F.when(i > j, F.reverse(part)).otherwise(part)
