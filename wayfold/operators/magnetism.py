"""Magnetic declination from spherical-harmonic coefficients that are given when it runs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The models' reference radius, and the ellipsoid, in kilometres.
RADIUS_KM, EQUATOR_KM, FLATTENING = 6371.2, 6378.137, 1 / 298.257223563
COEFFICIENT = "n int, m int, g double, h double, g_year double, h_year double"
#: Models of more degrees are refused: the coefficients of this many go to each worker.
MOST_DEGREES = 133


def read_coefficients(spark: SparkSession, path: str) -> DataFrame:
    """(n, m, g, h, g_year, h_year) of a coefficient file: lines of six numbers, whatever else is in it."""
    number = r"\s+([-+]?[0-9.]+(?:[eE][-+]?[0-9]+)?)"
    line = r"^\s*(\d+)\s+(\d+)" + number * 4 + r"\s*$"
    part = lambda k, kind: F.regexp_extract("value", line, k).cast(kind)
    found = spark.read.text(path).where(F.col("value").rlike(line))
    return found.select(part(1, "int").alias("n"), part(2, "int").alias("m"), *(part(k, "double").alias(c) for k, c in enumerate(("g", "h", "g_year", "h_year"), 3)))


def legendre(sine: np.ndarray, degrees: int) -> tuple[dict, dict]:
    """Schmidt semi-normalised associated Legendre functions of the sine of latitude, and their derivatives by latitude, by (n, m)."""
    cosine = np.sqrt(np.maximum(1 - sine * sine, 0))
    p, d = {(0, 0): np.ones_like(sine)}, {(0, 0): np.zeros_like(sine)}
    for n in range(1, degrees + 1):
        for m in range(n):
            top, low, size = 2 * n - 1, np.sqrt((n - 1) ** 2 - m * m), np.sqrt(n * n - m * m)
            p[n, m] = top * sine * p[n - 1, m] / size
            d[n, m] = top * (cosine * p[n - 1, m] + sine * d[n - 1, m]) / size
            if low:
                p[n, m] = p[n, m] - low * p[n - 2, m] / size
                d[n, m] = d[n, m] - low * d[n - 2, m] / size
        k = np.sqrt((2 * n - 1) / (2 * n)) if n > 1 else 1.0
        p[n, n] = k * cosine * p[n - 1, n - 1]
        d[n, n] = k * (cosine * d[n - 1, n - 1] - sine * p[n - 1, n - 1])
    return p, d


def field(terms: list[tuple], lat: np.ndarray, lon: np.ndarray, years: np.ndarray, alt_km: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """North, east and down of the field ``years`` after the terms' epoch, at geodetic places in degrees."""
    phi, lam = np.radians(lat), np.radians(lon)
    squash = FLATTENING * (2 - FLATTENING)
    curve = EQUATOR_KM / np.sqrt(1 - squash * np.sin(phi) ** 2)
    out, up = (curve + alt_km) * np.cos(phi), (curve * (1 - squash) + alt_km) * np.sin(phi)
    r = np.hypot(out, up)
    centred = np.arcsin(up / r)
    p, d = legendre(np.sin(centred), max(t[0] for t in terms))
    north, east, down = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    for n, m, g, h, g_year, h_year in terms:
        fall = (RADIUS_KM / r) ** (n + 2)
        now_g, now_h = g + years * g_year, h + years * h_year
        along, across = now_g * np.cos(m * lam) + now_h * np.sin(m * lam), now_g * np.sin(m * lam) - now_h * np.cos(m * lam)
        north -= fall * along * d[n, m]
        east += fall * across * m * p[n, m]
        down -= fall * along * (n + 1) * p[n, m]
    cosine = np.cos(centred)
    east = np.where(np.abs(cosine) > 1e-10, east / np.where(np.abs(cosine) > 1e-10, cosine, 1.0), east)
    # From the centre's vertical to the ellipsoid's.
    tilt = centred - phi
    return north * np.cos(tilt) - down * np.sin(tilt), east, north * np.sin(tilt) + down * np.cos(tilt)


def declination(df: DataFrame, coefficients: DataFrame, epoch: float, lat: Column, lon: Column, year: Column, alt_km: Column | None = None, out: str = "declination") -> DataFrame:
    """``out``: degrees from true to magnetic north, east positive, at each row's place and decimal year; null where one of these is.

    ``coefficients(n, m, g, h, g_year, h_year)`` are those of a model of a given ``epoch``; there are as many as its degrees make.
    """
    rows = coefficients.select("n", "m", "g", "h", "g_year", "h_year").where("n >= 1").limit(MOST_DEGREES * (MOST_DEGREES + 3) // 2 + 1).collect()
    terms = sorted(tuple(r) for r in rows)
    if not terms or max(t[0] for t in terms) > MOST_DEGREES or len(terms) > MOST_DEGREES * (MOST_DEGREES + 3) // 2:
        raise ValueError(f"a model has from one to {MOST_DEGREES} degrees")

    @F.pandas_udf("double")
    def turned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for at in batches:
            a, b, t, up = (x.to_numpy(float) for x in at)
            north, east, _ = field(terms, a, b, t - epoch, up)
            yield pd.Series(np.degrees(np.arctan2(east, north)))

    found = turned(lat.cast("double"), lon.cast("double"), year.cast("double"), (F.lit(0.0) if alt_km is None else alt_km).cast("double"))
    return df.withColumn(out, F.nanvl(found, F.lit(None).cast("double")))
