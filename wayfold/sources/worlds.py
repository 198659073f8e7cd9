"""Telemetry, legs, maps and hypotheses derived in closed form from the driver's tables.

Each world is a DataFrame, and as ``SQL[name]`` the same rows for DuckDB.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The demonstration terrain is a tilt and three Gaussian hills (x, y, height, radius) on 60 by 60 cells of 30 m.
TILT, CELL, SIDE = 0.005, 30.0, 60
HILLS = ((600.0, 1200.0, 140.0, 120.0), (1300.0, 500.0, 110.0, 140.0), (950.0, 800.0, 80.0, 90.0))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame, key: str, rows: int) -> DataFrame:
    """``df`` with about ``rows`` rows in a partition, for rows that many others are made of: small files are one partition, and its task would make them all."""
    return df.repartition(max(1, -(-df.count() // rows)), key)


def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(device_id, event_id, t, mag, k, heading, kind): one reading for each event."""
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        F.col("user_id").alias("device_id"), "event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("value").alias("mag"),
        k.alias("k"), F.pmod(k * 37 + F.col("user_id") * 11, F.lit(360)).cast("double").alias("heading"), F.col("event_type").alias("kind"),
    )


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(route, seq, metres, seconds, limit_ms): each order is a route, its lines the legs."""
    from pyspark.sql import Window

    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return read(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("route"), F.row_number().over(order).alias("seq"), (F.col("l_extendedprice") / 100).alias("metres"),
        (F.col("l_quantity") * 10).alias("seconds"), (8 + F.col("l_discount") * 100).alias("limit_ms"),
    )


def ground(x, y):
    """Elevation of the demonstration terrain at any place."""
    out = x * TILT
    for cx, cy, height, radius in HILLS:
        out = out + height * F.exp(-((x - cx) * (x - cx) + (y - cy) * (y - cy)) / (2 * radius * radius))
    return out


def dem(spark: SparkSession) -> DataFrame:
    """(gx, gy, h): the terrain's grid."""
    grid = spark.range(SIDE * SIDE).select((F.col("id") % SIDE).cast("int").alias("gx"), F.floor(F.col("id") / SIDE).cast("int").alias("gy"))
    return grid.select("gx", "gy", ground(F.col("gx") * CELL, F.col("gy") * CELL).alias("h"))


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pid, x, y, w): customers as weighted places on the terrain."""
    key = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(key.alias("pid"), (key * 37 % 1770).cast("double").alias("x"), (key * 91 % 1770).cast("double").alias("y"), F.abs("c_acctbal").alias("w"))


def roads(spark: SparkSession) -> DataFrame:
    """(sid, ax, ay, bx, by): a nine by nine street grid of 200 m, a segment for each block side."""
    n = spark.range(9 * 8).select((F.col("id") % 8).alias("i"), F.floor(F.col("id") / 8).alias("j"))
    east = n.select((F.col("j") * 8 + F.col("i")).alias("sid"), (F.col("i") * 200.0).alias("ax"), (F.col("j") * 200.0).alias("ay"), ((F.col("i") + 1) * 200.0).alias("bx"), (F.col("j") * 200.0).alias("by"))
    north = n.select((72 + F.col("j") * 8 + F.col("i")).alias("sid"), (F.col("j") * 200.0).alias("ax"), (F.col("i") * 200.0).alias("ay"), (F.col("j") * 200.0).alias("bx"), ((F.col("i") + 1) * 200.0).alias("by"))
    return east.unionByName(north)


def towns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(town, sid, ax, ay, bx, by): the street grid once for each supplier, all in one frame."""
    town = dealt(read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("town")), "town", 1000)
    return town.crossJoin(F.broadcast(roads(spark))).withColumn("sid", F.col("town") * 144 + F.col("sid"))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(fid, kind, x, y, name): parts as named features."""
    key = F.col("p_partkey")
    kinds = F.array(*[F.lit(k) for k in ("water", "wood", "peak", "poi")])
    return read(spark, sf_dir, "part").select(key.alias("fid"), F.get(kinds, (key % 4).cast("int")).alias("kind"), (key * 53 % 1770).cast("double").alias("x"), (key * 29 % 1770).cast("double").alias("y"), F.col("p_name").alias("name"))


def _ground_sql(x: str, y: str) -> str:
    return f"({x})*{TILT}::DOUBLE" + "".join(f"+{h}::DOUBLE*exp(-((({x})-{cx})*(({x})-{cx})+(({y})-{cy})*(({y})-{cy}))/{2 * r * r}::DOUBLE)" for cx, cy, h, r in HILLS)


SQL = {
    "tele": """tele AS (SELECT user_id AS device_id, event_id, epoch_us(ts)/1e6::DOUBLE AS t, value AS mag, CAST(json_extract_string(props,'$.k') AS INT) AS k,
        CAST((CAST(json_extract_string(props,'$.k') AS INT)*37+user_id*11)%360 AS DOUBLE) AS heading, event_type AS kind FROM events)""",
    "legs": """legs AS (SELECT l_orderkey AS route, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber,l_partkey,l_suppkey,l_extendedprice,l_quantity,l_shipdate) AS INT) AS seq,
        l_extendedprice/100 AS metres, l_quantity*10 AS seconds, 8+l_discount*100 AS limit_ms FROM lineitem)""",
    "dem": f"""dem AS (SELECT gx, gy, {_ground_sql(f'gx*{CELL}::DOUBLE', f'gy*{CELL}::DOUBLE')} AS h FROM (SELECT CAST(r%{SIDE} AS INT) gx, CAST(r//{SIDE} AS INT) gy FROM range({SIDE * SIDE}) q(r)))""",
    "points": "points AS (SELECT c_custkey AS pid, CAST(c_custkey*37%1770 AS DOUBLE) AS x, CAST(c_custkey*91%1770 AS DOUBLE) AS y, abs(c_acctbal) AS w FROM customer)",
    "roads": """roads AS (SELECT j*8+i AS sid, i*200.0::DOUBLE AS ax, j*200.0::DOUBLE AS ay, (i+1)*200.0::DOUBLE AS ex, j*200.0::DOUBLE AS ey FROM range(8) a(i), range(9) b(j)
        UNION ALL SELECT 72+j*8+i, j*200.0::DOUBLE, i*200.0::DOUBLE, j*200.0::DOUBLE, (i+1)*200.0::DOUBLE FROM range(8) a(i), range(9) b(j))""",
    "places": "places AS (SELECT p_partkey AS fid, ['water','wood','peak','poi'][CAST(p_partkey%4 AS INT)+1] AS kind, CAST(p_partkey*53%1770 AS DOUBLE) AS x, CAST(p_partkey*29%1770 AS DOUBLE) AS y, p_name AS name FROM part)",
}


def with_sql(*names: str) -> str:
    """A WITH clause of the worlds named."""
    return "WITH " + ",\n".join(SQL[n] for n in names)


PI = math.pi
