"""Where a last digit decides, results are those of the SQL."""

from __future__ import annotations

import duckdb
import math
import random

from pyspark.sql import functions as F

from wayfold.functions.geo import rounded
from wayfold.operators import graph as gr
from wayfold.operators import routes as ro
from wayfold.operators import sequences as se
from wayfold.plans import lost


def test_rounding_is_duckdbs(spark):
    rng = random.Random(5)
    values = [15.049999999999999, 0.47725, -2.5, -0.00005, 1.005, 0.0, 1e300, -1e-9] + [rng.randrange(-10**7, 10**7) / 10**4 for _ in range(4000)]
    for places in (1, 3, 4, 6):
        got = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double").select("i", rounded("v", places).alias("r")).orderBy("i").select("r").collect()]
        want = [r[0] for r in duckdb.execute(f"SELECT round(v, {places}) FROM (SELECT unnest(?::DOUBLE[]) AS v)", [values]).fetchall()]
        assert got == want
    assert spark.range(1).select(rounded(F.lit(None).cast("double"), 3), rounded(F.lit(float("nan")), 3)).first()[0] is None


def test_crumbs_at_just_the_distance(spark):
    # Pairs of steps that a hypotenuse and a root of squares put on different sides of a limit.
    rng = random.Random(3)
    while True:
        h, d = float(rng.randrange(360)), rng.randrange(1, 99) * 0.05
        x, y = math.sin(math.radians(h)) * d, math.cos(math.radians(h)) * d
        if math.hypot(x, y) != math.sqrt(x * x + y * y):
            break
    apart = max(math.hypot(x, y), math.sqrt(x * x + y * y))
    rows = spark.createDataFrame([(1, 0.0, 1, d, h)], "device_id long, t double, event_id long, d double, heading double")
    assert ro.breadcrumbs(rows, apart=apart).count() == (2 if math.sqrt(x * x + y * y) >= apart else 1)


def test_lengths_of_a_chain_are_added_in_order(spark):
    rng = random.Random(11)
    chains = {c: [rng.randrange(100, 10**7) / 10**4 for _ in range(7)] for c in range(300)}
    e = spark.createDataFrame([(c * 100 + k, c * 100 + k + 1, m) for c, ms in chains.items() for k, m in enumerate(ms)], "u long, v long, metres double")
    keep = spark.createDataFrame([(c * 100,) for c in chains], "node long")
    edges, nodes = gr.contracted(e, keep)
    want = {}
    for c, ms in chains.items():
        total = 0.0
        for m in ms:
            total += m
        want[c * 100] = total
    assert {r["u"]: r["metres"] for r in edges.where("u % 100 = 0").collect()} == want
    assert nodes.count() == 2100


def test_a_deviation_of_just_half_a_hundredth(spark, tmp_path):
    # Of these 64 values the deviation is 27.375; a running mean, which the SQL takes, makes it a last digit less.
    ks = "86 57 63 2 4 27 28 30 19 93 54 66 47 48 79 42 54 70 18 92 58 85 73 53 76 58 27 23 43 48 14 79 5 81 6 37 27 51 61 45 24 37 56 2 8 76 75 72 79 84 13 31 23 66 18 90 45 91 19 81 17 87 86 35"
    c = duckdb.connect()
    c.execute(f"""CREATE TABLE events AS SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_seconds(i) AS ts, 7 AS user_id, 'view' AS event_type, 1.5 + i % 9 AS value, '{{"k": ' || v || '}}' AS props
        FROM (SELECT unnest(string_split('{ks}', ' ')) AS v, generate_subscripts(string_split('{ks}', ' '), 1) AS i)""")
    c.execute(f"COPY (SELECT * REPLACE (value::DOUBLE AS value, user_id::BIGINT AS user_id) FROM events) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    got = lost.compact_results(spark, str(tmp_path)).first()
    want = c.execute(lost.SQL["compact_results"]).fetchdf().iloc[0]
    assert got["headingStdDev"] == want["headingStdDev"] == 27.37
    assert got["elevGainM"] == want["elevGainM"]
    none = spark.createDataFrame([([],), ([3],), ([None, 2, 4],)], "v array<int>").select(se.deviation(F.col("v")).alias("d"))
    assert [r["d"] for r in none.collect()] == [None, 0.0, 1.0]
