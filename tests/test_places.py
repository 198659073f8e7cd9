"""Many rows at one place: what places share is worked out once."""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from wayfold.operators import questions as qu
from wayfold.operators import spatial as sp
from wayfold.operators import walks as wa

MANY = 40_000


def _heap(spark, name: str, x: float, y: float):
    return spark.range(MANY).select(F.col("id").alias(name), F.lit(x).alias("x"), F.lit(y).alias("y"))


def test_a_clock_of_all_routes_gives_what_each_own_ticks_give(spark):
    clock = [(float(t), t % 14 != 0, t % 14 == 0, {58: "arrive", 30: "deny"}.get(t % 60)) for t in range(0, 242, 2)]
    routes = spark.createDataFrame([(r, [float(17 * (r * k % 23) + 3) for k in range(1, 2 + r % 5)]) for r in range(60)], "route long, lengths array<double>")
    ticks = spark.createDataFrame(clock, "t double, moving boolean, still boolean, answer string")
    want = sorted(map(tuple, wa.session(routes.crossJoin(ticks)).collect()))
    got = sorted(map(tuple, wa.session_by_clock(routes, clock).collect()))
    assert got == want and {r[2] for r in got} == {"prompt", "arrived", "snapped", "destination"}


def test_heaps_of_points_and_features_meet_once(spark):
    points, features = _heap(spark, "pid", 10.0, 10.0), _heap(spark, "fid", 13.0, 14.0)
    began = time.monotonic()
    nearest = sp.nearest_feature(points, features, 150.0)
    assert nearest.agg(F.count("*"), F.min("fid"), F.max("fid"), F.max("dist")).first()[:] == (MANY, 0, 0, 5.0)
    ranked = sp.ranked_features(points, features, 130.0, 3)
    assert [tuple(r) for r in ranked.groupBy("rank", "fid").count().orderBy("rank").collect()] == [(1, 0, MANY), (2, 1, MANY), (3, 2, MANY)]
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    lakes = features.select("fid", F.array(corner(60.5, 0.0), corner(0.0, 60.5), corner(-60.5, 0.0), corner(0.0, -60.5)).alias("ring"))
    assert sp.inside_any(points, lakes, 100.0).count() == MANY
    # 1,600 million pairs each would take minutes.
    assert time.monotonic() - began < 60


def test_questions_list_no_pairs(spark):
    cloud = _heap(spark, "cid", 10.0, 10.0).withColumn("w", F.lit(1.0))
    line = F.array(*[F.struct((F.col("x") + k).alias("x"), F.col("y").alias("y")) for k in (0.0, 2.0)])
    things = _heap(spark, "fid", 13.0, 14.0).select("fid", F.when(F.col("fid") % 2 == 0, "wood").otherwise("poi").alias("kind"), F.lit("Mill").alias("name"), line.alias("line"))
    began = time.monotonic()
    asked = qu.bank(cloud, things, nature=True).groupBy("q").agg(F.sum(F.col("yes").cast("int")).alias("yes"))
    assert {r["q"]: r["yes"] for r in asked.collect()} == {"water": 0, "wood": MANY, "meadow": 0, "wetland": 0, "park": 0}
    said = qu.named(cloud, things.where("kind = 'poi'"), "poi", F.lit(10.0), F.lit(10.0)).groupBy("q").agg(F.sum(F.col("yes").cast("int")).alias("yes"))
    assert [tuple(r) for r in said.collect()] == [("Mill", MANY)]
    assert time.monotonic() - began < 60


def test_pairs_of_heaps_are_whole(spark):
    points, features = _heap(spark, "pid", 10.0, 10.0).limit(50), _heap(spark, "fid", 13.0, 14.0).limit(40)
    line = F.array(*[F.struct((F.col("x") + k).alias("x"), F.col("y").alias("y")) for k in (0.0, 2.0)])
    found = sp.feature_distance(points, features.select("fid", line.alias("line")), 40.0)
    assert found.distinct().count() == 2000 and {r[0] for r in found.select("dist").distinct().collect()} == {5.0}


def test_copies_of_boxes_and_points_meet_once(spark):
    from wayfold.operators import atlas as at

    began = time.monotonic()
    points = spark.range(MANY).select(F.col("id").alias("pid"), F.lit(1.5).alias("lat"), F.lit(2.5).alias("lon"))
    patches = spark.range(7, MANY).select(F.col("id").alias("patch"), F.lit(1.0).alias("s"), F.lit(2.0).alias("n"), F.lit(2.0).alias("w"), F.lit(3.0).alias("e"))
    found = at.first_patch(points, patches)
    assert found.agg(F.count("*"), F.min("patch"), F.max("patch")).first()[:] == (MANY, 7, 7)
    assert time.monotonic() - began < 30


def test_trails_along_one_line_are_one(spark):
    from wayfold.operators import graph as gr

    line = F.array(*[F.struct((F.col("id") % 1 + 500.0 + 9 * k).alias("x"), F.lit(500.0).alias("y")) for k in range(3)])
    trails = spark.range(1000).select(F.col("id").alias("fid"), line.alias("line"))
    roads = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 0.0)], "sid long, ax double, ay double, bx double, by double")
    found = gr.trail_graph(trails, roads)
    assert found.count() == 4
    # Grouped before its sides are made.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "min(fid#" in plan


def test_terrain_walks_keep_only_what_comes_off(spark):
    import numpy as np

    from wayfold.operators import recovery as re

    starts = spark.range(40).select(F.col("id").alias("walk"), (F.col("id") * 50.0).alias("x"), F.lit(30.0).alias("y"), F.col("id").alias("seed")).coalesce(1)
    flat = lambda x, y: np.zeros_like(x)
    found = re.terrain_walks(starts, flat, 15.0, 8, 0.5, 1500.0, 1500.0)
    # One partition of starts is dealt to all cores, and no walk is stored on the way.
    assert found.rdd.getNumPartitions() > 1 and "ExistingRDD" not in found._jdf.queryExecution().executedPlan().toString()
    rows = found.collect()
    per = {}
    for r in rows:
        per.setdefault(r["walk"], []).append(r)
    assert all(len(w) == 8 and len({r["attempt"] for r in w}) == 1 and all(0 <= r["x"] <= 1500 and 0 <= r["y"] <= 1500 for r in w) for w in per.values())
    assert 0 in per and max(per) <= 30


def test_pairs_of_a_crowded_place_take_little_room(spark, tmp_path):
    # 400 points of one place and 4,999 features of one line, joined as large tables are, and some elsewhere.
    line = F.array(*[F.struct(F.lit(x).alias("x"), F.lit(y).alias("y")) for x, y in ((0.0, 10.0), (30.0, 10.0))])
    points = spark.range(410).select((F.col("id") * 7 + 3).alias("pid"), F.when(F.col("id") < 400, 5.0).otherwise(F.col("id") * 10.0).alias("x"), F.lit(0.0).alias("y"))
    features = spark.range(4999).select((F.col("id") * 11).alias("fid"), line.alias("line"))
    far = spark.createDataFrame([(90_001, [(4050.0, 3.0)])], "fid long, line array<struct<x:double,y:double>>")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        sp.feature_distance(points, features.unionByName(far), 40.0).write.parquet(f"{tmp_path}/pairs")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    got = spark.read.parquet(f"{tmp_path}/pairs")
    assert got.columns == ["pid", "fid", "dist"]
    assert got.where("fid < 90000").agg(F.count("*"), F.countDistinct("pid", "fid"), F.min("dist"), F.max("dist"), F.max("pid")).first()[:] == (1_999_600, 1_999_600, 10.0, 10.0, 399 * 7 + 3)
    assert sorted((r["pid"], r["fid"]) for r in got.where("fid > 90000").collect()) == [(k * 7 + 3, 90_001) for k in range(402, 409)]
    # Lists that come again are told in less than half a byte a pair.
    assert sum(f.stat().st_size for f in (tmp_path / "pairs").glob("*.parquet")) < 1_000_000
