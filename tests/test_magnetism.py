"""Declination against closed forms and differences."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.operators import magnetism as mg


def test_functions_of_low_degrees_and_their_derivatives():
    phi = np.linspace(-1.4, 1.4, 41)
    s, c = np.sin(phi), np.cos(phi)
    p, d = mg.legendre(s, 12)
    # The textbook's Schmidt functions.
    want = {(1, 0): s, (1, 1): c, (2, 0): 1.5 * s * s - 0.5, (2, 1): np.sqrt(3) * s * c, (2, 2): np.sqrt(3) / 2 * c * c, (3, 3): np.sqrt(5 / 8) * c**3, (3, 0): 2.5 * s**3 - 1.5 * s}
    for k, v in want.items():
        assert np.allclose(p[k], v)
    for k in p:
        step = 1e-6
        slope = (mg.legendre(np.sin(phi + step), 12)[0][k] - mg.legendre(np.sin(phi - step), 12)[0][k]) / (2 * step)
        assert np.allclose(d[k], slope, atol=1e-6)
    # Of each degree the squares have a sum of one.
    for n in range(13):
        assert np.allclose(sum(p[n, m] ** 2 for m in range(n + 1)), 1)


def test_a_field_is_the_slope_of_its_potential():
    rng = np.random.default_rng(3)
    terms = [(n, m, *rng.normal(size=2), 0.0, 0.0) for n in range(1, 7) for m in range(n + 1)]

    def potential(r, phi, lam):
        p, _ = mg.legendre(np.array([np.sin(phi)]), 6)
        return mg.RADIUS_KM * sum((mg.RADIUS_KM / r) ** (n + 1) * (g * np.cos(m * lam) + h * np.sin(m * lam)) * p[n, m][0] for n, m, g, h, *_ in terms)

    for lat, lon in ((10.0, 20.0), (-55.0, 170.0), (70.0, -100.0)):
        phi, lam, e2 = np.radians(lat), np.radians(lon), mg.FLATTENING * (2 - mg.FLATTENING)
        rc = mg.EQUATOR_KM / np.sqrt(1 - e2 * np.sin(phi) ** 2)
        x, z = rc * np.cos(phi), rc * (1 - e2) * np.sin(phi)
        r, gc, k = np.hypot(x, z), np.arctan2(z, x), 1e-5
        north = -(potential(r, gc + k, lam) - potential(r, gc - k, lam)) / (2 * k * r)
        east = -(potential(r, gc, lam + k) - potential(r, gc, lam - k)) / (2 * k * r * np.cos(gc))
        down = (potential(r + 0.01, gc, lam) - potential(r - 0.01, gc, lam)) / 0.02
        got = mg.field(terms, np.array([lat]), np.array([lon]), np.zeros(1), np.zeros(1))
        t = gc - phi
        assert np.allclose(np.ravel(got), [north * np.cos(t) - down * np.sin(t), east, north * np.sin(t) + down * np.cos(t)], atol=1e-4)


def test_coefficient_files_and_missing_places(spark, tmp_path):
    (tmp_path / "model.cof").write_text("    2025.0            MODEL    01/01/2025\n  1  0  -29000.0       0.0       10.0        0.0\n  1  1   -1500.0    4600.0        8.0      -25.0\n999999999999999999\n")
    terms = mg.read_coefficients(spark, str(tmp_path / "model.cof"))
    assert sorted(map(tuple, terms.collect())) == [(1, 0, -29000.0, 0.0, 10.0, 0.0), (1, 1, -1500.0, 4600.0, 8.0, -25.0)]
    df = spark.createDataFrame([(1, 0.0, 0.0, 2025.0), (2, None, 0.0, 2025.0), (3, 90.0, 0.0, 2030.0)], "id int, lat double, lon double, year double")
    got = {r["id"]: r["declination"] for r in mg.declination(df, terms, 2025.0, F.col("lat"), F.col("lon"), F.col("year")).collect()}
    # On the equator a dipole points where its axis does.
    assert got[1] == pytest.approx(np.degrees(np.arctan2(-4600, 29000))) and got[2] is None and got[3] is not None
    with pytest.raises(ValueError):
        mg.declination(df, terms.limit(0), 2025.0, F.col("lat"), F.col("lon"), F.col("year"))
