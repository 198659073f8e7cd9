"""Behaviour that the reference's own tests state."""

from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfold.functions import geo
from wayfold.operators import hypotheses as hy
from wayfold.operators import routes as ro
from wayfold.operators import sequences as se
from wayfold.operators import spatial as sp
from wayfold.operators import telemetry as te
from wayfold.operators import terrain as tr
from wayfold.sources import codecs, payloads


def _one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_speed_is_smoothed(spark):
    legs = spark.createDataFrame([(1, 1, 100.0, 20.0), (2, 1, 100.0, 5.0)], "route long, seq int, metres double, seconds double")
    out = {r["route"]: r["out"][-1] for r in ro.smoothed_speeds(legs, first=10.0).collect()}
    assert out[1] == pytest.approx(8.5) and out[2] == pytest.approx(13.0)


def test_gate_holds_and_stops_do_not_move(spark):
    ticks = spark.createDataFrame([(1, 1, t, t not in (5, 6), 10.0, 1.0, 100.0) for t in range(1, 40)], "route int, leg int, t int, moving boolean, speed double, dt double, metres double")
    out = {r["t"]: r for r in ro.progress(ticks).collect()}
    assert out[4]["done"] == 40 and out[6]["done"] == 40 and out[39]["done"] == 100.0 and out[39]["prompt"]


def test_snap_is_one_sided_and_not_too_young(spark):
    s = lambda done, leg_s: ro.snaps(F.lit(done), F.lit(100.0), F.lit(True), F.lit(leg_s))
    r = _one(spark, s(40.0, 4.0).alias("a"), s(60.0, 6.0).alias("b"), s(60.0, 1.0).alias("c"))
    assert (r["a"], r["b"], r["c"]) == (False, True, False)


def test_default_detector(spark):
    rng = np.random.default_rng(1)
    rows = [(1, i, i * 0.02, float(1 + rng.normal(0, 0.002))) for i in range(150)] + [(1, 150 + i, 3 + i * 0.02, float(1 + rng.normal(0, 0.6))) for i in range(150)]
    df = spark.createDataFrame(rows, "device_id int, event_id int, t double, mag double")
    out = {r["event_id"]: r["still"] for r in te.stationary(te.rolling_variance(df)).collect()}
    assert not out[4] and out[149] and not out[299]


def test_turns_and_angles(spark):
    r = _one(spark, geo.turn_label(F.lit(90.0)).alias("a"), geo.turn_label(F.lit(-90.0)).alias("b"), geo.turn_label(F.lit(10.0)).alias("c"), geo.turn_label(F.lit(170.0)).alias("d"), geo.angle_difference(F.lit(180.0), F.lit(0.0)).alias("e"))
    assert (r["a"], r["b"], r["c"], r["d"], r["e"]) == ("right", "left", "straight", "sharp right (U-turn)", -180.0)


def test_compass_quarter_turn(spark):
    r = _one(spark, geo.tilt_heading(0.0, 0.0, 1.0, 20.0, 0.0, -40.0).alias("a"), geo.tilt_heading(0.0, 0.0, 1.0, 0.0, 20.0, -40.0).alias("b"))
    assert abs((r["b"] - r["a"] + 180) % 360 - 180) == pytest.approx(90, abs=10)


def test_gyro_quarter_turn_and_deadband(spark):
    rows = [(1, i, i * 0.02, 30.0) for i in range(151)] + [(2, i, i * 0.02, 1.0) for i in range(151)]
    out = te.integrate_gyro(spark.createDataFrame(rows, "device_id int, event_id int, t double, yaw double"))
    last = {r["device_id"]: r["turned"] for r in out.where("event_id = 150").collect()}
    assert last[1] == pytest.approx(90, abs=5) and last[2] < 2


def test_calibration_is_wrap_safe(spark):
    rows = [(1, i, float(i), 140.0, 30.0) for i in range(60)] + [(2, i, float(i), 10.0, 350.0) for i in range(60)]
    out = te.calibrate(spark.createDataFrame(rows, "device_id int, event_id int, t double, c double, b double"), "c", "b", 0.1, 20)
    got = {r["device_id"]: r["out"] for r in out.collect()}
    assert got[1]["offset"] == pytest.approx(110, abs=3) and got[2]["offset"] == pytest.approx(20, abs=3) and got[1]["ready"]


def test_payload_shapes(spark):
    bodies = ['{"accel_x":1,"accel_y":2,"accel_z":3}', '{"x":0.1,"y":0.2,"z":0.3}', '{"messages":[{"name":"accelerometer","values":{"x":0,"y":0,"z":1}}]}', '{"temperature":21}', "not json",
              '{"payload":[{"name":"Accelerometer","x":1,"y":1,"z":1},{"name":"gravity","x":9,"y":9,"z":9},{"name":"accelerometer","x":2,"y":2,"z":2}]}', None]
    df = spark.createDataFrame(list(enumerate(bodies)), "pid int, body string")
    got = sorted((r["pid"], r["i"], r["x"], r["z"]) for r in payloads.samples(df).where("kind = 'accel'").collect())
    assert got == [(0, 0, 1.0, 3.0), (1, 0, 0.1, 0.3), (2, 0, 0.0, 1.0), (5, 0, 1.0, 1.0), (5, 1, 2.0, 2.0)]
    assert sorted(r["pid"] for r in payloads.rejects(df).collect()) == [3, 4, 6]


def test_bilinear_corners(spark):
    dem = spark.createDataFrame([(0, 0, 0.0), (1, 0, 10.0), (0, 1, 20.0), (1, 1, 30.0)], "gx int, gy int, h double")
    pts = spark.createDataFrame([(0, 5.0, 0.0), (1, 5.0, 5.0), (2, -1.0, 0.0), (3, 10.0, 10.0)], "i int, x double, y double")
    got = {r["i"]: r["h"] for r in tr.sample(pts, dem, 2, 2, 10.0).collect()}
    assert got == {0: 5.0, 1: 15.0, 2: None, 3: 30.0}


def test_time_warp():
    a = np.arange(5.0)
    assert se.dtw_many(a[None], a)[0] == 0
    assert se.dtw_many(a[None], np.array([0, 0, 1, 2, 3, 4, 4.0]))[0] < 1e-9
    assert se.dtw_many(a[None], np.array([0, 5, 0, 5, 0.0]))[0] > 0.3


def test_distance_profile(spark):
    df = spark.createDataFrame([(1, float(d), 0.5 * d) for d in range(0, 301, 10)], "k int, d double, alt double")
    got = [r["rise"] for r in se.distance_profile(df, 30.0, ["k"]).orderBy("i").collect()]
    assert got == pytest.approx([15.0 * i for i in range(11)])


def test_sun(spark):
    noon, night = geo.sun(40.0, 0.0, 1750507200.0), geo.sun(40.0, 0.0, 1750507200.0 + 43200)
    r = _one(spark, noon["elevation"].alias("a"), noon["azimuth"].alias("b"), night["elevation"].alias("c"))
    assert 60 < r["a"] < 75 and abs(r["b"] - 180) < 5 and r["c"] < 0


def test_codecs():
    assert codecs.geometry([9, 4, 4, 18, 0, 16, 16, 0]) == [[(2, 2), (2, 10), (10, 10)]]
    assert codecs.geometry([9, 6, 12, 18, 10, 12, 24, 44, 15]) == [[(3, 6), (8, 12), (20, 34), (3, 6)]]
    h = np.arange(12, dtype="int16").reshape(3, 4)
    data = codecs.encode_raster(12, 1, 2, h, 40.0, -80.0, version=True)
    assert len(data) == 61 and (codecs.decode_raster(data)[1] == h).all() and (codecs.decode_raster(data[1:])[1] == h).all()
    f = [(1, True, "Lake", [(1.5, 2.5), (3.0, 4.0)]), (2, False, None, [])]
    assert codecs.decode_features(codecs.encode_features(f)) == f


def test_rasters_are_read_by_spark(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(codecs.encode_raster(12, 5, 7, np.arange(6, dtype="int16").reshape(2, 3), 0, 0))
    got = {(r["gx"], r["gy"]): r["h"] for r in codecs.read_rasters(spark, str(tmp_path)).collect()}
    assert got[(5, 7)] == 0 and got[(7, 8)] == 5 and len(got) == 6


def test_even_split(spark):
    def ask(weights):
        rows = [(q, yes, w) for q, y in enumerate(weights) for yes, w in ((True, y), (False, 1 - y))]
        return [r["q"] for r in hy.best_split(spark.createDataFrame(rows, "q int, yes boolean, w double")).collect()]

    assert ask([0.05, 0.48, 0.9]) == [1] and ask([0.02, 0.97]) == [] and ask([0.3, 0.52, 0.42]) == [1]


def test_lake_and_side(spark):
    pts = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "pid int, x double, y double")
    lake = spark.createDataFrame([(9, [(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)])], "fid int, ring array<struct<x:double,y:double>>")
    assert [tuple(r) for r in sp.contains(pts, lake, 30.0).collect()] == [(1, 9)]
    feat = spark.createDataFrame([(7, 50.0, 0.0)], "fid int, x double, y double")
    r = sp.nearest_feature(pts.where("pid = 1"), feat, 100.0).first()
    assert r["dist"] == 50 and r["bearing"] == 90


def test_localised_walk_finds_the_start(spark):
    from wayfold.plans import search

    top = search.localised_walk(spark, "/root/testdata/sf0.001").orderBy(F.desc("w")).first()
    assert math.hypot(top["x"] - search.START[0], top["y"] - search.START[1]) < 140
