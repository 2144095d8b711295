"""Distances on the WGS84 ellipsoid, in Arrow batches."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The ellipsoid's semi-major axis in km and its flattening, and the mean radius.
MAJOR_KM, FLATTENING, MEAN_KM = 6378.137, 1 / 298.257223563, 6371.0088


def inverse_km(lon1: np.ndarray, lat1: np.ndarray, lon2: np.ndarray, lat2: np.ndarray, rounds: int = 200) -> np.ndarray:
    """Iterated inverse solution; nearly antipodal pairs, where it doesn't settle, take the sphere's distance."""
    minor = MAJOR_KM * (1 - FLATTENING)
    u1, u2 = np.arctan((1 - FLATTENING) * np.tan(np.radians(lat1))), np.arctan((1 - FLATTENING) * np.tan(np.radians(lat2)))
    base = np.radians((lon2 - lon1 + 180) % 360 - 180)
    lam = base.copy()
    settled = np.zeros(len(base), bool)
    with np.errstate(all="ignore"):
        for _ in range(rounds):
            s = np.hypot(np.cos(u2) * np.sin(lam), np.cos(u1) * np.sin(u2) - np.sin(u1) * np.cos(u2) * np.cos(lam))
            c = np.sin(u1) * np.sin(u2) + np.cos(u1) * np.cos(u2) * np.cos(lam)
            sigma = np.arctan2(s, c)
            sin_a = np.where(s == 0, 0.0, np.cos(u1) * np.cos(u2) * np.sin(lam) / np.where(s == 0, 1.0, s))
            cos2_a = 1 - sin_a**2
            mid = np.where(cos2_a == 0, 0.0, c - 2 * np.sin(u1) * np.sin(u2) / np.where(cos2_a == 0, 1.0, cos2_a))
            k = FLATTENING / 16 * cos2_a * (4 + FLATTENING * (4 - 3 * cos2_a))
            new = base + (1 - k) * FLATTENING * sin_a * (sigma + k * s * (mid + k * c * (2 * mid**2 - 1)))
            settled = np.abs(new - lam) < 1e-12
            lam = new
            if settled.all():
                break
        u = cos2_a * (MAJOR_KM**2 - minor**2) / minor**2
        a = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
        b = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
        d = b * s * (mid + b / 4 * (c * (2 * mid**2 - 1) - b / 6 * mid * (4 * s**2 - 3) * (4 * mid**2 - 3)))
        out = minor * a * (sigma - d)
        p1, p2 = np.radians(lat1), np.radians(lat2)
        h = np.sin((p2 - p1) / 2) ** 2 + np.cos(p1) * np.cos(p2) * np.sin(base / 2) ** 2
        sphere = 2 * MEAN_KM * np.arcsin(np.minimum(1, np.sqrt(h)))
    return np.where(settled & (np.abs(lam) <= np.pi), out, sphere)


@F.pandas_udf(T.DoubleType())
def geodesic_km(lon1: pd.Series, lat1: pd.Series, lon2: pd.Series, lat2: pd.Series) -> pd.Series:
    """Kilometres between two positions; null where a coordinate is."""
    args = [np.asarray(s, dtype=float) for s in (lon1, lat1, lon2, lat2)]
    missing = np.isnan(np.stack(args)).any(axis=0)
    got = inverse_km(*[np.where(missing, 0.0, a) for a in args])
    return pd.Series(np.where(missing, np.nan, got)).astype(object).where(~pd.Series(missing), None)
