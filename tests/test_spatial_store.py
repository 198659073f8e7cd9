"""Places along a curve: keys, covers of boxes, and what a look-up reads."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from wayfold.operators import spatial_store as ss


def test_keys_interleave(spark):
    rng = random.Random(1)
    rows = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(200)] + [(-90.0, -180.0), (90.0, 180.0), (0.0, 0.0)]
    for r in spark.createDataFrame(rows, "lat double, lon double").withColumn("key", ss.morton(F.col("lat"), F.col("lon"))).collect():
        y, x = (min(max(int((v - low) / span * 2**ss.BITS), 0), 2**ss.BITS - 1) for v, low, span in ((r["lat"], -90, 180), (r["lon"], -180, 360)))
        assert r["key"] == ss._key(y, x)


def test_ranges_cover_boxes():
    rng = random.Random(2)
    for _ in range(60):
        s, w = rng.uniform(-80, 80), rng.uniform(-170, 170)
        n, e = s + 10 ** rng.uniform(-4, 1), w + 10 ** rng.uniform(-4, 1)
        got = ss.ranges(s, w, n, e)
        assert 1 <= len(got) <= ss.MOST_RANGES and all(a <= z for a, z in got) and all(z < b for (_, z), (b, _) in zip(got, got[1:]))
        cell = lambda v, low, span: min(int((v - low) / span * 2**ss.BITS), 2**ss.BITS - 1)
        for _ in range(30):
            k = ss._key(cell(rng.uniform(s, n), -90, 180), cell(rng.uniform(w, e), -180, 360))
            assert any(a <= k <= z for a, z in got)
        # The cover is not much larger than the box.
        assert not 1 / 8 < (n - s) / (e - w) < 8 or sum(z - a + 1 for a, z in got) <= 40 * max(1, (n - s) / 180 * 2**ss.BITS + 2) * max(1, (e - w) / 360 * 2**ss.BITS + 2)


def test_a_look_up_reads_what_meets_the_box(spark, tmp_path):
    rng = random.Random(3)
    rows = [(i, rng.uniform(-85, 85), rng.uniform(-179, 179), f"p{i % 7}") for i in range(4000)] + [(9000, 10.0, 20.0, "p1"), (9001, None, 5.0, "p2")]
    path = str(tmp_path / "places")
    ss.write_places(spark.createDataFrame(rows, "id long, lat double, lon double, patch string"), path)
    assert spark.read.parquet(path).count() == len(rows)
    for s, w, n, e in ((10.0, 20.0, 30.0, 50.0), (-40.0, -120.0, -39.0, -100.0), (-90.0, -180.0, 90.0, 180.0), (10.0, 20.0, 10.0, 20.0)):
        found = ss.in_box(spark, path, s, w, n, e)
        assert {r["id"] for r in found.collect()} == {i for i, lat, lon, _ in rows if lat is not None and s <= lat <= n and w <= lon <= e}
    small = ss.in_box(spark, path, 10.0, 20.0, 12.0, 22.0)
    plan = small._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "zone" in plan and "GreaterThanOrEqual(key" in plan
    small.collect()

    def files(node) -> int:
        return node.metrics().apply("numFiles").value() if node.metrics().contains("numFiles") else sum(files(node.children().apply(k)) for k in range(node.children().size()))

    whole = spark.read.parquet(path).where("lat > -100")
    whole.collect()
    assert 1 <= files(small._jdf.queryExecution().executedPlan()) <= 3 < 20 < files(whole._jdf.queryExecution().executedPlan())
