"""Route search, matching, recovery, reports and map stores against plain Python."""

from __future__ import annotations

import heapq
import json
import math
import random
import struct
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from wayfold.functions import noise
from wayfold.operators import atlas as at
from wayfold.operators import graph as gr
from wayfold.operators import hypotheses as hy
from wayfold.operators import questions as qu
from wayfold.operators import recovery as re
from wayfold.operators import report as rp
from wayfold.operators import routes as ro
from wayfold.operators import spatial as sp
from wayfold.operators import telemetry as te
from wayfold.operators import terrain as tr
from wayfold.operators import walks as wa
from wayfold.plans import lost, search
from wayfold.sources import codecs
from wayfold.sources import worlds as wo

GRID = (wo.SIDE, wo.SIDE, wo.CELL)
TABLES = "/root/testdata/sf0.001"


def bearing(dx, dy):
    return math.degrees(math.atan2(dx, dy)) % 360


def gap(a, b):
    return abs((a - b + 540) % 360 - 180)


@pytest.fixture(scope="module")
def net():
    """A graph of 30 places, as a frame of directed edges."""
    rng = random.Random(1)
    at = [(rng.uniform(0, 300), rng.uniform(0, 300)) for _ in range(30)]
    rows = []
    for a, (x, y) in enumerate(at):
        for b in sorted(range(30), key=lambda b: math.dist(at[a], at[b]))[1:4]:
            for u, v in ((a, b), (b, a)):
                if (u, v) not in {r[:2] for r in rows}:
                    dx, dy = at[v][0] - at[u][0], at[v][1] - at[u][1]
                    rows.append((u, v, *at[u], *at[v], math.hypot(dx, dy), bearing(dx, dy)))
    e = pd.DataFrame(rows, columns=["a", "b", "ax", "ay", "bx", "by", "len", "bearing"])
    e["heights"] = [[0.1 * r.ax + 0.05 * r.ay + (0.1 * (r.bx - r.ax) + 0.05 * (r.by - r.ay)) * k / 4 for k in range(5)] for r in e.itertuples()]
    return e.sort_values(["a", "b"], ignore_index=True)


def walk_on(e, edge, s, metres, heading):
    """Every end of one hypothesis's step, depth first."""
    out, stack = [], [(edge, s, metres)]
    while stack:
        i, s, rest = stack.pop()
        if s + rest <= e.len[i]:
            out.append((i, s + rest))
            continue
        for j in e.index[(e.a == e.b[i]) & (e.b != e.a[i])]:
            if gap(e.bearing[j], heading) <= 150:
                stack.append((j, 0.0, rest - (e.len[i] - s)))
    return sorted((i, round(s, 6)) for i, s in out)


def test_steps_through_several_junctions(net):
    roads, rng = wa.Roads(net), random.Random(2)
    for _ in range(60):
        i = rng.randrange(len(net))
        s, metres, heading = rng.uniform(0, net.len[i]), rng.uniform(1, 90), rng.uniform(0, 360)
        want = walk_on(net, i, s, metres, heading)
        if len(want) <= 4:  # far below the bound on edges
            edge, place, source = roads.advance(np.array([i, i]), np.array([s, s]), np.array([metres, metres]), heading, 150.0)
            for k in (0, 1):
                assert sorted(zip(edge[source == k].tolist(), np.round(place[source == k], 6).tolist())) == want


def test_matching_scores_heading_and_climb(net):
    roads = wa.Roads(net)
    bins = pd.DataFrame({"heading": [40.0, 80.0, 120.0, 90.0], "climb": [1.0, 2.0, -1.0, 0.5]})
    height = lambda i, s: 0.1 * net.ax[i] + 0.05 * net.ay[i] + (0.1 * (net.bx[i] - net.ax[i]) + 0.05 * (net.by[i] - net.ay[i])) * s / net.len[i]
    walkers = []
    for i in range(len(net)):
        s = 7.5
        while s < net.len[i]:
            walkers.append((i, s, 0.0, height(i, s)))
            s += 15
    for h, climb in zip(bins.heading, bins.climb):
        moved = [(j, s, w, e) for i, p, w, e in walkers for j, s in walk_on(net, i, p, 20.0, h)]
        best = {}
        for i, s, w, e in moved:
            now = height(i, s)
            w -= min(gap(net.bearing[i], h) ** 2 / (2 * 25.0**2) + (now - e - climb) ** 2 / (2 * 3.0**2), 5.0)
            key = (i, math.floor(s / 8 + 0.5))
            if key not in best or (w, -s) > (best[key][2], -best[key][1]):
                best[key] = (i, s, w, now)
        walkers = list(best.values())
    edge, s, logw = wa.follow(roads, bins, 15.0, 20.0)
    got = {(i, math.floor(p / 8 + 0.5)): w for i, p, w in zip(edge.tolist(), s.tolist(), logw.tolist())}
    want = {(i, math.floor(p / 8 + 0.5)): w for i, p, w, _ in walkers}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)


def test_walks_are_matched_where_they_end(spark):
    got = {r["walk"]: r for r in lost.driven_walks(spark, TABLES).collect()}
    assert len(got) == 8 and all(r["scale"] in (0.85, 1.0, 1.15) and 0 < r["concentration"] <= 1 and r["areas"] >= 1 for r in got.values())
    from wayfold.plans import world

    found = {r["walk"]: r for r in world.matched_walks(spark, TABLES).collect()}
    ends = {}
    for r in wa.random_walks(world._starts(spark), search._edges(spark).select(world._area(), "a", "b", "len"), 2000.0, "trail").collect():
        if r["i"] > ends.get(r["walk"], (-1, 0))[0]:
            ends[r["walk"]] = (r["i"], r["node"])
    near = [math.hypot(found[w]["x"] - n % 9 * 200, found[w]["y"] - n // 9 * 200) < 120 for w, (_, n) in ends.items() if w in found]
    assert len(near) == 40 and sum(near) >= 30  # hills and turns tell most walks


def test_shortest_paths_equal_a_heap(spark, net):
    e = spark.createDataFrame([(int(r.a), int(r.b), float(r.len)) for r in net.itertuples()], "u long, v long, metres double")
    pairs = [(k, k * 7 % 30, k * 11 % 30) for k in range(25)] + [(90, 3, 3), (91, 0, 500)]
    got = {r["route"]: r for r in gr.shortest_paths(e, spark.createDataFrame(pairs, "route long, start long, goal long")).collect()}

    def dijkstra(a, b):
        best, heap = {a: 0.0}, [(0.0, a)]
        while heap:
            d, n = heapq.heappop(heap)
            for r in net[net.a == n].itertuples():
                if d + r.len < best.get(r.b, 1e18):
                    best[r.b] = d + r.len
                    heapq.heappush(heap, (d + r.len, r.b))
        return best.get(b)

    for route, a, b in pairs:
        want = dijkstra(a, b) if a != b else None
        assert (route in got) == (want is not None)
        if want is not None:
            path = got[route]["path"]
            assert got[route]["metres"] == pytest.approx(want) and path[0] == a and path[-1] == b
            assert sum(net[(net.a == u) & (net.b == v)].len.iloc[0] for u, v in zip(path, path[1:])) == pytest.approx(want)


def test_graphs_are_stored_and_read(spark, tmp_path):
    node = spark.createDataFrame([(1, 40.0, -80.0), (2, 40.5, -80.5)], "id long, lat double, lon double")
    e = spark.createDataFrame([(1, 2, 12.5), (2, 1, 12.5)], "u long, v long, metres double")
    gr.save(node, e, str(tmp_path / "snap"))
    n, back = gr.restore(spark, str(tmp_path / "snap"))
    assert sorted(n.collect()) == sorted(node.collect()) and sorted(back.collect()) == sorted(e.collect())
    text = '<?xml version="1.0"?><graphml><key id="d0" for="node" attr.name="y" attr.type="double"/><key id="d1" for="edge" attr.name="length" attr.type="double"/><graph edgedefault="directed"><node id="1"><data key="d0">40.0</data></node><node id="2"><data key="d0">40.5</data></node><edge source="1" target="2"><data key="d1">12.5</data></edge></graph></graphml>'
    (tmp_path / "g.graphml").write_text(text)
    n, back = gr.read_graphml(spark, str(tmp_path / "g.graphml"))
    assert {r["id"]: r["data"] for r in n.collect()} == {1: {"y": "40.0"}, 2: {"y": "40.5"}} and [(r["u"], r["v"], r["data"]) for r in back.collect()] == [(1, 2, {"length": "12.5"})]
    gr.write_graphml(node, e, str(tmp_path / "out"))
    assert spark.read.format("xml").option("rowTag", "edge").load(str(tmp_path / "out/edges")).count() == 2


def test_nearest_road_anywhere_and_rotation(spark):
    roads = wo.roads(spark)
    segs = roads.collect()
    rng = random.Random(3)
    pts = [(k, rng.uniform(-5000, 9000), rng.uniform(-5000, 9000)) for k in range(40)] + [(50, 900.0, 850.0)]

    def dist(x, y, r):
        t = max(0, min(1, ((x - r.ax) * (r.bx - r.ax) + (y - r.ay) * (r.by - r.ay)) / ((r.bx - r.ax) ** 2 + (r.by - r.ay) ** 2)))
        return math.hypot(x - r.ax - t * (r.bx - r.ax), y - r.ay - t * (r.by - r.ay))

    got = {r["pid"]: r["dist"] for r in sp.nearest_road_anywhere(spark.createDataFrame(pts, "pid int, x double, y double"), roads, ["pid"]).collect()}
    assert len(got) == 41 and all(got[p] == pytest.approx(min(dist(x, y, r) for r in segs)) for p, x, y in pts)
    assert sp.nearest_road_anywhere(spark.createDataFrame(pts, "pid int, x double, y double"), roads.limit(0), ["pid"]).count() == 0
    walk = [(p, i, x, y, 75.0 if i < 3 else 345.0) for p, x, y in [(1, 300.0, 405.0), (2, 610.0, 790.0)] for i in range(6)]

    def fit(rot):
        best = 0.0
        for p in (1, 2):
            x, y, total = 0.0, 0.0, 0.0
            for pid, i, x0, y0, h in walk:
                if pid != p:
                    continue
                if i == 0:
                    x, y = x0, y0
                near = min((dist(x, y, r), r.sid, 0.0 if r.ax == r.bx else 90.0) for r in segs)
                d = gap(h + rot, near[2])
                d = 180 - d if d > 90 else d
                if near[0] <= 25 and d <= 40:
                    total += (1 - d / 40) * (1 - near[0] / 25)
                x, y = x + math.sin(math.radians(h + rot)) * 15, y + math.cos(math.radians(h + rot)) * 15
            best = max(best, total / 6)
        return best

    best = (0.0, -1.0)
    for rot in [-45.0 + 5 * k for k in range(19)]:
        peak = fit(rot)
        if peak > best[1] + 0.001 or (abs(peak - best[1]) <= 0.001 and abs(rot) < abs(best[0])):
            best = (rot, peak)
    found = sp.best_rotation(spark.createDataFrame(walk, "pid int, i int, x0 double, y0 double, heading double"), roads, ["pid"], 15.0, 25.0).first()
    assert found["rotation"] == best[0] and found["peak"] == pytest.approx(best[1])


def test_places_on_roads(spark):
    got = sp.on_roads(wo.roads(spark), 1440, 0.0, 5).collect()
    assert sorted(r["cid"] for r in got) == list(range(1440))
    assert all(min(r["x"] % 200, 200 - r["x"] % 200) < 1e-6 or min(r["y"] % 200, 200 - r["y"] % 200) < 1e-6 for r in got)


def test_a_curve_is_scored_by_roads_and_heights(spark):
    df = spark.createDataFrame([(0.5, 2.0, 10), (None, 2.0, 10), (0.5, 2.0, 3), (0.0, 0.0, 10)], "fit double, cost double, n int")
    got = [r[0] for r in df.select(hy.curve_score(F.col("fit"), F.col("cost"), F.col("n"), 10)).collect()]
    like = math.exp(-4 / 50)
    assert got == [pytest.approx(0.5**4 * like), pytest.approx(like), 0.0, 0.0]


def test_recovery_engine(spark):
    cloud = spark.range(400).select(F.col("id").alias("cid"), (F.col("id") % 20 * 100.0).alias("x"), (F.floor(F.col("id") / 20) * 100.0).alias("y"), F.lit(1 / 400).alias("w"))
    flat, told = hy.recovery_step(cloud, cloud.select("cid", F.lit(1.0).alias("likelihood")), 0.1)
    assert told == "flatline" and flat is cloud
    here = cloud.select("cid", F.exp(-((F.col("x") - 700) ** 2 + (F.col("y") - 900) ** 2) / 5000).alias("likelihood"))
    after, told = hy.recovery_step(cloud, here, 9.0)
    rows = after.collect()
    assert told == "located" and len(rows) == 400 and sum(r["w"] for r in rows) == pytest.approx(1.0)
    assert np.mean([r["x"] for r in rows]) == pytest.approx(700, abs=30) and np.mean([r["y"] for r in rows]) == pytest.approx(900, abs=30)
    two = cloud.select("cid", F.when(F.col("x").isin(100.0, 1800.0) & (F.col("y") == 500), 1.0).otherwise(0.0).alias("likelihood"))
    assert hy.recovery_step(cloud, two, 9.0)[1] == "ambiguous"
    dry = hy.resampled(cloud, 400, 8.0, 1, F.col("x") > 1000)
    assert dry.where("x > 1000").agg(F.sum("w")).first()[0] == 0 and dry.agg(F.sum("w")).first()[0] == pytest.approx(1.0)
    left = hy.interrogated(cloud, F.col("x") < 300, hard=True, jitter=0.001)
    assert left.count() == 400 and left.where("x >= 300").count() == 0
    assert hy.as_cloud(cloud.withColumn("l", F.log(F.col("w"))), log_weight="l").agg(F.sum("w")).first()[0] == pytest.approx(1.0)


def test_interviews(spark):
    cloud = spark.createDataFrame([(k, 100.0 * k, 0.0, 0.0) for k in range(4)], "cid long, x double, y double, logw double")
    talk = re.Interview(cloud)
    holds = cloud.select("cid", (F.col("x") > 150).alias("yes"))
    talk.skip("b")
    talk.answer("a", True, holds)
    assert {r["cid"]: r["logw"] for r in talk.cloud.collect()} == {0: pytest.approx(math.log(0.2)), 1: pytest.approx(math.log(0.2)), 2: 0.0, 3: 0.0}
    bank = spark.createDataFrame([("a",), ("b",), ("c",)], "q string")
    assert [r["q"] for r in talk.open(bank).collect()] == ["c"]
    talk.answer("c", False, holds, named=True)
    assert {r["cid"]: r["logw"] for r in talk.cloud.collect()}[3] == pytest.approx(math.log(0.02))
    talk.reset()
    assert talk.cloud.agg(F.min("logw")).first()[0] == 0.0 and talk.open(bank).count() == 3


def test_questions_with_a_heading_and_ridges(spark):
    cloud = spark.createDataFrame([(0, 0.0, 0.0, 0.5), (1, 1000.0, 0.0, 0.5)], "cid long, x double, y double, w double")
    spot = lambda fid, kind, x, y: (fid, kind, "n", [(x, y)])
    features = spark.createDataFrame([spot(1, "stream", 10.0, 0.0), spot(2, "stream", 990.0, 0.0), spot(3, "dead_end", 30.0, 0.0)], "fid long, kind string, name string, line array<struct<x:double,y:double>>")
    asked = qu.bank(cloud, features, nature=False, heading=0.0, steep=spark.createDataFrame([(0, 20.0), (1, 3.0)], "cid long, slope double"))
    yes = {(r["q"], r["cid"]) for r in asked.where("yes").collect()}
    assert yes == {("water", 0), ("water", 1), ("stream_right", 0), ("stream_left", 1), ("dead_end", 0), ("steep", 0)}
    h = qu.horizons(lost._cloud(spark, TABLES), wo.dem(spark), *GRID, reach=600.0)
    one = h.where("cid = 1").collect()
    x, y = next((r["x"], r["y"]) for r in wo.points(spark, TABLES).where("pid = 1").collect())
    ground = lambda x, y: _bilinear(x, y)
    for r in one:
        angle, n = 0.0, 10
        for k in range(1, n + 1):
            px, py = x + math.sin(math.radians(r["q"])) * 60 * k, y + math.cos(math.radians(r["q"])) * 60 * k
            if ground(px, py) is None:
                break
            angle = max(angle, math.degrees(math.atan2(ground(px, py) - ground(x, y) - 1.7, 60 * k))) if k > 1 else math.degrees(math.atan2(ground(px, py) - ground(x, y) - 1.7, 60))
        assert r["yes"] == (angle >= 2.5)


def _bilinear(x, y):
    h = lambda i, j: i * wo.CELL * wo.TILT + sum(a * math.exp(-((i * wo.CELL - cx) ** 2 + (j * wo.CELL - cy) ** 2) / (2 * r * r)) for cx, cy, a, r in wo.HILLS)
    fx, fy = x / wo.CELL, y / wo.CELL
    if not (0 <= fx <= wo.SIDE - 1 and 0 <= fy <= wo.SIDE - 1):
        return None
    i, j = int(fx), int(fy)
    k, m = min(i + 1, wo.SIDE - 1), min(j + 1, wo.SIDE - 1)
    tx, ty = fx - i, fy - j
    low, high = h(i, j) + (h(k, j) - h(i, j)) * tx, h(i, m) + (h(k, m) - h(i, m)) * tx
    return low + (high - low) * ty


def test_rasters_in_degrees_and_zooms(spark):
    dem = wo.dem(spark)
    world = 256.0 * 2**10
    px0, py0 = 1000.0, 2000.0
    lon, lat = (px0 + 12.25) / world * 360 - 180, math.degrees(math.atan(math.sinh(math.pi * (1 - 2 * (py0 + 7.5) / world))))
    df = spark.createDataFrame([(lat, lon), (0.0, 0.0)], "lat double, lon double")
    got = [r["h"] for r in tr.mercator_sample(df, dem, wo.SIDE, wo.SIDE, 10, px0, py0).collect()]
    assert got[0] == pytest.approx(_bilinear(12.25 * wo.CELL, 7.5 * wo.CELL)) and got[1] is None
    assert tr.mosaic_zoom(40.0, -80.0, 40.01, -79.99) == 13 and 8 <= tr.mosaic_zoom(40.0, -82.0, 42.0, -79.0) < 13 and tr.mosaic_zoom(-80.0, -179.0, 80.0, 179.0) == 8
    tops = tr.sunlit(spark.createDataFrame([(1, 600.0, 1200.0), (2, 850.0, 1200.0)], "pid long, x double, y double"), dem, *GRID, 40.0, -80.0, 1_718_920_800.0)
    assert tops.count() == 2
    assert not tr.sunlit(spark.createDataFrame([(1, 600.0, 1200.0)], "pid long, x double, y double"), dem, *GRID, 40.0, -80.0, 1_718_946_000.0).first()["lit"]  # night


def _png(rgb, kind):
    high, wide, _ = rgb.shape
    lines, before = [], np.zeros((wide, 3), int)
    for row in rgb.astype(int):
        left = np.vstack([np.zeros((1, 3), int), row[:-1]])
        corner = np.vstack([np.zeros((1, 3), int), before[:-1]])
        p = left + before - corner
        paeth = np.where((abs(p - left) <= abs(p - before)) & (abs(p - left) <= abs(p - corner)), left, np.where(abs(p - before) <= abs(p - corner), before, corner))
        guess = [0, left, before, (left + before) // 2, paeth][kind]
        lines.append(bytes([kind]) + ((row - guess) % 256).astype(np.uint8).tobytes())
        before = row
    part = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", wide, high, 8, 2, 0, 0, 0)) + part(b"IDAT", zlib.compress(b"".join(lines))) + part(b"IEND", b"")


def test_elevation_tiles(spark, tmp_path):
    rgb = np.random.default_rng(4).integers(0, 256, (6, 5, 3)).astype(np.uint8)
    for kind in range(5):
        assert (codecs.decode_png(_png(rgb, kind)) == rgb).all()
    rgb[:, :, 0] = 128
    (tmp_path / "12/34").mkdir(parents=True)
    (tmp_path / "12/34/56.png").write_bytes(_png(rgb, 4))
    got = {(r["cx"], r["cy"]): r["h"] for r in codecs.read_elevation_tiles(spark, str(tmp_path)).where("tile_x = 34 AND tile_y = 56").collect()}
    assert got == {(x, y): int(np.clip(np.round(128 * 256 + int(rgb[y, x, 1]) + int(rgb[y, x, 2]) / 256 - 32768), -32768, 32767)) for y in range(6) for x in range(5)}


def test_vector_tiles_and_boxes_and_catalogue(spark, tmp_path):
    def number(v):
        out = b""
        while v > 127:
            out += bytes([v & 127 | 128])
            v >>= 7
        return out + bytes([v])

    part = lambda n, b: number(n << 3 | 2) + number(len(b)) + b
    zig = lambda v: number((v << 1) ^ (v >> 31) & 0xFFFFFFFF)
    shape = number(1 << 3 | 1) + zig(5) + zig(7) + number(2 << 3 | 2) + zig(1) + zig(0) + zig(0) + zig(2)
    feature = part(2, number(0) + number(0)) + number(3 << 3) + number(2) + part(4, shape)
    layer = part(1, b"waterway") + part(2, feature) + part(3, b"class") + part(4, part(1, b"stream"))
    assert codecs.decode_tile(part(3, layer)) == [("waterway", 2, {"class": "stream"}, [[(5, 7), (6, 7), (6, 9)]])]
    assert at.plan_boxes([(0.0, 0.0, 0.1, 0.1), (0.0, 0.12, 0.1, 0.22), (5.0, 5.0, 7.0, 5.1)]) == [(0.0, 0.0, 0.1, pytest.approx(0.22)), (pytest.approx(5.825), pytest.approx(4.875), pytest.approx(6.175), pytest.approx(5.225))]
    for name, text in (("one", '{"slug": "one", "name": "One", "lat": 1.5, "lon": 2.5, "radius_m": 100.0, "created": "now"}'), ("bad", "{oops")):
        (tmp_path / name).mkdir()
        (tmp_path / name / "meta.json").write_text(text)
    assert [(r["slug"], r["lat"]) for r in at.catalogue(spark, str(tmp_path)).collect()] == [("one", 1.5)]


def test_patches_merge_about_one_origin(spark, tmp_path):
    kind = "patch string, fid long, kind string, name string, line array<struct<x:double,y:double>>"
    dx = 0.001 * 111_320 * math.cos(math.radians(40.0))
    rows = [("p1", 1, "peak", "Top", [(100.0, 50.0)]), ("p2", 9, "peak", "Top", [(100.0 - dx, 50.0)]), ("p2", 3, "wood", None, [(0.0, 0.0), (10.0, 0.0)])]
    origins = spark.createDataFrame([("p1", 40.0, -80.0), ("p2", 40.0, -79.999)], "patch string, lat double, lon double")
    features = spark.createDataFrame(rows, kind)
    got = {r["kind"]: r for r in at.merge_features(features, origins, 40.0, -80.0).collect()}
    assert len(got) == 2 and got["peak"]["patch"] == "p1" and got["wood"]["line"][0]["x"] == pytest.approx(dx, abs=1e-6)
    at.write_patches(features, str(tmp_path / "store"))
    at.write_patches(features.where("patch = 'p2' AND fid = 3"), str(tmp_path / "store"))
    assert {r["patch"]: r["rows"] for r in at.patch_index(spark, str(tmp_path / "store")).collect()} == {"p1": 1, "p2": 1}
    features.drop("patch").write.parquet(str(tmp_path / "old"))
    assert at.migrated(spark, str(tmp_path / "old"), "p0").select("patch").distinct().first()[0] == "p0"


def test_logs_and_flags(spark, tmp_path):
    rows = [("me", "sensor", k / 10, k) for k in range(20)] + [("me", "motion", k / 100, k) for k in range(20)] + [("me", "event", 0.5, 1), ("you", "event", 0.5, 2)]
    df = spark.createDataFrame(rows, "owner string, kind string, t double, v int")
    te.write_log(df, "me", str(tmp_path / "log"))
    got = spark.read.json(str(tmp_path / "log"))
    assert sorted(r["t"] for r in got.where("kind = 'sensor'").collect()) == [0.0, 0.4, 0.8, 1.2, 1.6] and got.where("kind = 'event'").count() == 1
    assert [r["t"] for r in got.where("kind = 'motion'").orderBy("t").collect()] == [0.0, 0.04, 0.08, 0.12, 0.16]
    one = spark.range(1).select(ro.travel_speed(F.lit(9.0), F.lit(None).cast("double"), F.lit(True), F.lit(0)).alias("a"), ro.travel_speed(F.lit(9.0), F.lit(99.0), F.lit(True), F.lit(0)).alias("b"), ro.travel_speed(F.lit(9.0), F.lit(None).cast("double"), F.lit(False), F.lit(0)).alias("c")).first()
    assert tuple(one) == (0.0, 45.0, 9.0)


def test_noise_does_not_depend_on_partitions(spark):
    a = {r["id"]: r["g"] for r in spark.range(4000, numPartitions=1).select("id", noise.gauss(3, "id").alias("g")).collect()}
    b = {r["id"]: r["g"] for r in spark.range(4000, numPartitions=7).repartition(5).select("id", noise.gauss(3, "id").alias("g")).collect()}
    v = np.array(list(a.values()))
    assert a == b and abs(v.mean()) < 0.06 and abs(v.std() - 1) < 0.05
    sway = spark.range(3000).select(noise.accelerations(F.col("id") % 2 == 0, 5, "id").alias("a"), "id").select("a.*", "id").toPandas()
    moving, idle = sway[sway.id % 2 == 0], sway[sway.id % 2 == 1]
    assert abs(moving.x.std() - 0.30) < 0.03 and abs(idle.z.std() - 0.002) < 0.0003 and abs(idle.z.mean() - 1) < 0.001


def test_generated_walks_are_fresh_and_turn(spark):
    walks: dict = {}
    for r in lost.generated_walks(spark, TABLES).collect():
        walks.setdefault(r["walk"], []).append((r["i"], r["node"]))
    sets = [frozenset(frozenset(x) for x in zip(p, p[1:])) for p in ([n for _, n in sorted(w)] for w in walks.values())]
    assert walks and len(set(sets)) == len(sets)
    hills: dict = {}
    for r in lost.terrain_walks(spark, TABLES).collect():
        hills.setdefault((r["walk"], r["attempt"]), []).append(r)
    assert hills and len({w for w, _ in hills}) == len(hills)
    assert all(0 <= r["x"] <= 1770 and 0 <= r["y"] <= 1770 for rows in hills.values() for r in rows)


def test_a_walk_as_json(spark, tmp_path):
    route = spark.createDataFrame([(1, 0, 40.0, -80.0), (1, 1, 40.1, -80.0)], "walk long, i int, lat double, lon double")
    hyps = spark.createDataFrame([(1, k, 40.0 + k / 10, -80.0, 0.25) for k in range(4)], "walk long, cid long, lat double, lon double, w double")
    questions = spark.createDataFrame([(1, 0, "Water?", False), (1, 1, "Main St?", True)], "walk long, q int, text string, named boolean")
    answers = spark.createDataFrame([(1, k, q, (k + q) % 2 == 0) for k in range(4) for q in range(2)], "walk long, cid long, q int, yes boolean")
    bins = spark.createDataFrame([(1, 0, 90.0, 5.0, 5.5), (1, 1, 80.0, 6.0, 6.5)], "walk long, i int, heading double, elev double, noisy double")
    body = json.loads(rp.single_walk(route, hyps, answers, questions, bins, most=2).first()["body"])
    assert body["route"] == [[40.0, -80.0], [40.1, -80.0]] and [h[0] for h in body["hypotheses"]] == [40.0, 40.2]
    assert body["questionAnswers"] == [[True, False], [True, False]] and body["questions"][1] == {"text": "Main St?", "named": True}
    assert body["headings"] == [90.0, 80.0] and body["noisyElev"] == [5.5, 6.5] and body["walkSteps"] == 2
    rp.write_results(spark.createDataFrame([(1, "x")], "walk long, coords string"), str(tmp_path / "r"))
    assert spark.read.json(str(tmp_path / "r")).columns == ["walk"]
    log = spark.createDataFrame([(1, 0, "Water?", True, 0.256)], "walk long, i int, question string, answer boolean, share double")
    assert rp.transcript(log).first()["line"] == "1. Water? - yes (26% of the weight at the lead)"


def test_breadcrumbs_fall_every_five_metres(spark):
    rows = [(1, k, float(k), 0.04 * k if k < 3 else 1.0 * k, 90.0) for k in range(12)] + [(1, 12, 30.0, 60.0, 90.0), (1, 13, 31.0, 66.0, 0.0)]
    got = [(r["i"], round(r["x"], 6), round(r["y"], 6)) for r in ro.breadcrumbs(spark.createDataFrame(rows, "device_id int, event_id int, t double, d double, heading double")).orderBy("i").collect()]
    assert got == [(0, 0.0, 0.0), (1, 5.0, 0.0), (2, 10.0, 0.0), (3, 11.0, 6.0)]


def test_curves_are_scored_alike_with_the_raster_joined_or_held(spark, monkeypatch):
    cand = wo.points(spark, TABLES).select(F.col("pid").alias("cid"), "x", "y")
    seen = [0.4 * k for k in range(22)]
    args = (cand, search.HEADINGS, 15.0, wo.dem(spark), *GRID, seen)
    held = {r["cid"]: r for r in hy.curve_costs(*args).collect()}
    monkeypatch.setattr(hy, "BROADCAST_CELLS", 0)
    joined = {r["cid"]: r for r in hy.curve_costs(*args).collect()}
    assert held.keys() == joined.keys() and all(held[k]["length"] == joined[k]["length"] and held[k]["cost"] == pytest.approx(joined[k]["cost"]) for k in held)
