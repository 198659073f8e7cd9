"""Queries over recovery operators, with their DuckDB SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import recovery as re
from ..operators import terrain as tr
from ..sources import worlds as wo
from ..sources.worlds import CELL, SIDE, with_sql
from .motion import r6
from .search import _CLOUD, _OSM, _cloud, _elements, gr
from .terrain import _TRACK, _sample_sql, _track

Q: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


@query("particle_mask", with_sql("points") + "," + _CLOUD + " SELECT cid, round(CASE WHEN x<600 THEN 0 ELSE w/sum(CASE WHEN x<600 THEN 0 ELSE w END) OVER () END,9) AS w FROM cloud")
def particle_mask(spark: SparkSession, d: str) -> DataFrame:
    return re.mask(_cloud(spark, d), F.col("x") < 600).select("cid", F.round("w", 9).alias("w"))


@query("particle_scatter")
def particle_scatter(spark: SparkSession, d: str) -> DataFrame:
    """A place within 400 m of each customer's, out of the middle."""
    about = wo.points(spark, d).select(F.col("pid").alias("cid"), F.col("x").alias("cx"), F.col("y").alias("cy"))
    return re.scattered(about, F.col("cx"), F.col("cy"), 400.0, 11, lambda x, y: (F.abs(x - 900) < 300) & (F.abs(y - 900) < 300))


@query("stride_sample", with_sql("points") + "," + _CLOUD + ", n AS (SELECT *, row_number() OVER (ORDER BY cid) AS r, count(*) OVER () AS c FROM cloud) SELECT cid FROM n WHERE c<=100 OR (r-1)%CAST(ceil(c/100.0) AS BIGINT)=0")
def stride_sample(spark: SparkSession, d: str) -> DataFrame:
    return re.stride(_cloud(spark, d), 100).select("cid")


@query("named_places", with_sql("points") + "," + _CLOUD + " SELECT cid, sqrt((x-900)**2+(y-900)**2)<=70 AS confirmed, sqrt((x-900)**2+(y-900)**2)>300 AS kept FROM cloud")
def named_places(spark: SparkSession, d: str) -> DataFrame:
    c = _cloud(spark, d)
    yes, no = re.confirm_named(c, 900.0, 900.0).select("cid", F.lit(True).alias("a")), re.reject_lock(c, 900.0, 900.0).select("cid", F.lit(True).alias("b"))
    return c.join(yes, "cid", "left").join(no, "cid", "left").select("cid", F.coalesce("a", F.lit(False)).alias("confirmed"), F.coalesce("b", F.lit(False)).alias("kept"))


@query("road_lead", with_sql("points") + """, h AS (SELECT x, y, CASE WHEN y>500 THEN -w/1000 ELSE -w/1000+ln(0.2) END AS logw FROM points), t AS (SELECT x AS x0, y AS y0, logw AS top FROM h ORDER BY logw DESC, x, y LIMIT 1)
 SELECT x0, y0, round(sum(CASE WHEN sqrt((x-x0)**2+(y-y0)**2)<=250 THEN exp(logw-top) ELSE 0 END)/sum(exp(logw-top)),6) AS concentration FROM h, t GROUP BY 1,2""")
def road_lead(spark: SparkSession, d: str) -> DataFrame:
    h = wo.points(spark, d).select("x", "y", (-F.col("w") / 1000).alias("logw"))
    return r6(re.softmax_lead(re.softened(h, F.col("y") > 500, 0.2), 250.0))


@query("nearest_node", with_sql("points") + """, n AS (SELECT x+y*9 AS node, x*200.0 AS nx, y*200.0 AS ny FROM range(9) a(x), range(9) b(y)), r AS (SELECT pid, node, sqrt((x-nx)**2+(y-ny)**2) AS dist FROM points, n)
 SELECT pid, node, round(dist,6) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, node) AS k FROM r WHERE dist<=200) WHERE k=1""")
def nearest_node(spark: SparkSession, d: str) -> DataFrame:
    n = spark.range(81).select(F.col("id").alias("node"), (F.col("id") % 9 * 200.0).alias("x"), (F.floor(F.col("id") / 9) * 200.0).alias("y"))
    return r6(re.nearest_node(wo.points(spark, d), n, 200.0))


@query("retrace_guidance", with_sql("tele") + "," + _TRACK + """, s AS (SELECT *, coalesce(sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2),0) AS st FROM track WINDOW w AS (PARTITION BY device_id ORDER BY i)), c AS (SELECT device_id, i, x, y, sum(st) OVER (PARTITION BY device_id ORDER BY i) AS cum FROM s),
 n AS (SELECT device_id, arg_min(i, sqrt((x-31.5)**2+(y-17.25)**2)) AS ni, arg_min(cum, sqrt((x-31.5)**2+(y-17.25)**2)) AS nm FROM c GROUP BY 1)
 SELECT c.device_id, CAST(ni AS INT) AS i, round(nm,4) AS left_m, CAST(max(c.i) AS INT) AS target FROM c JOIN n ON c.device_id=n.device_id AND cum<=greatest(nm-22.2,0) GROUP BY c.device_id, ni, nm""")  # fmt: skip
def retrace_guidance(spark: SparkSession, d: str) -> DataFrame:
    t = _track(spark, d).select("device_id", "i", "x", "y")
    out = re.retrace(t, t.select("device_id").distinct().withColumns({"hx": F.lit(31.5), "hy": F.lit(17.25)}), 22.2)
    return out.select("device_id", "i", F.round("left_m", 4).alias("left_m"), "target")


@query("expected_climb", with_sql("dem", "legs") + f""", p AS (SELECT route, seq, CAST((route*7+seq*131)%1900 AS DOUBLE) AS x, CAST((route*11+seq*57)%1700 AS DOUBLE) AS y FROM legs)
 SELECT route, seq, round(coalesce(h,0)-lag(coalesce(h,0)) OVER (PARTITION BY route ORDER BY seq),5) AS climb FROM {_sample_sql('p')}""")
def expected_climb(spark: SparkSession, d: str) -> DataFrame:
    p = wo.legs(spark, d).select("route", "seq", ((F.col("route") * 7 + F.col("seq") * 131) % 1900).cast("double").alias("x"), ((F.col("route") * 11 + F.col("seq") * 57) % 1700).cast("double").alias("y"))
    out = re.expected_climb(tr.sample(p, wo.dem(spark), SIDE, SIDE, CELL))
    return out.select("route", "seq", (F.round("climb", 5) + 0.0).alias("climb"))


@query("path_boxes", with_sql("legs") + " SELECT route, round(min((seq*7+route)%50)-0.005::DOUBLE,6) AS s, round(min((seq*5+route)%40)-0.005::DOUBLE,6) AS w, round(max((seq*7+route)%50)+0.005::DOUBLE,6) AS n, round(max((seq*5+route)%40)+0.005::DOUBLE,6) AS e FROM legs GROUP BY 1")
def path_boxes(spark: SparkSession, d: str) -> DataFrame:
    return r6(re.padded_box(wo.legs(spark, d).select("route", ((F.col("seq") * 7 + F.col("route")) % 50).alias("lat"), ((F.col("seq") * 5 + F.col("route")) % 40).alias("lon"))))


@query("landmarks", "WITH " + _OSM + ", b AS (SELECT DISTINCT u, v FROM (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)) SELECT u, count(*) AS degree, CASE WHEN count(*)>=3 THEN 'intersection' WHEN count(*)=1 THEN 'dead_end' END AS kind FROM b GROUP BY 1")
def landmarks(spark: SparkSession, d: str) -> DataFrame:
    el = _elements(spark, d)
    return re.landmarks(gr.edges(el, gr.nodes(el)))


@query("interrogation")
def interrogation(spark: SparkSession, d: str) -> DataFrame:
    """Questions about which side of lines one is on, answered for a known place; the log of what was asked."""
    truth = (1000.0, 700.0)
    lines = {f"east of {x}": (x, None) for x in range(200, 1800, 200)} | {f"north of {y}": (None, y) for y in range(200, 1800, 200)}
    cond = {q: F.col("x") > x if x is not None else F.col("y") > y for q, (x, y) in lines.items()}
    said = lambda q: truth[0] > lines[q][0] if lines[q][0] is not None else truth[1] > lines[q][1]
    _, log = re.ask(_cloud(spark, d), cond, said, hard=True)
    return spark.createDataFrame([(i, *x) for i, x in enumerate(log)], "i int, question string, answer boolean, share double")


@query("meanders")
def meanders(spark: SparkSession, d: str) -> DataFrame:
    s = wo.points(spark, d).select(F.col("pid").alias("walk"), "x", "y", F.col("pid").alias("seed"))
    return r6(re.meander(s, ground, 15.0, 40))


def ground(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Heights of the demonstration terrain, for walks that feel their way."""
    return x * wo.TILT + sum(h * np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / (2 * r * r)) for cx, cy, h, r in wo.HILLS)


