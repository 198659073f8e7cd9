"""Queries over rasters, sequences and space, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..operators import sequences as se
from ..operators import spatial as sp
from ..operators import terrain as tr
from ..sources import worlds as wo
from ..sources.worlds import CELL, SIDE, with_sql
from .motion import r6

Q: dict = {}
SQL: dict[str, str] = {}
GRID = (SIDE, SIDE, CELL)


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _sample_sql(src: str, x: str = "x", y: str = "y", out: str = "h", cols: str = "*") -> str:
    """A subquery with the bilinear height of a relation's points."""
    n = SIDE - 1
    return f"""(SELECT s.*, CASE WHEN inside THEN (a.h+(b.h-a.h)*tx)+((c.h+(e.h-c.h)*tx)-(a.h+(b.h-a.h)*tx))*ty END AS {out} FROM
     (SELECT {cols}, {x}/{CELL}>=0 AND {y}/{CELL}>=0 AND {x}/{CELL}<={n} AND {y}/{CELL}<={n} AS inside, CAST(floor({x}/{CELL}) AS INT) AS x0, CAST(floor({y}/{CELL}) AS INT) AS y0, {x}/{CELL}-floor({x}/{CELL}) AS tx, {y}/{CELL}-floor({y}/{CELL}) AS ty FROM {src}) s
     LEFT JOIN dem a ON a.gx=x0 AND a.gy=y0 LEFT JOIN dem b ON b.gx=least(x0+1,{n}) AND b.gy=y0 LEFT JOIN dem c ON c.gx=x0 AND c.gy=least(y0+1,{n}) LEFT JOIN dem e ON e.gx=least(x0+1,{n}) AND e.gy=least(y0+1,{n}))"""


def _points(spark, d):
    return wo.points(spark, d).withColumns({"x": F.col("x") * 1.03 - 10.5, "y": F.col("y") * 1.01})


_P = "p AS (SELECT pid, x*1.03::DOUBLE-10.5::DOUBLE AS x, y*1.01::DOUBLE AS y FROM points)"


@query("raster_samples", with_sql("dem", "points") + "," + _P + f" SELECT pid, round(h,6) AS h FROM {_sample_sql('p')}")
def raster_samples(spark: SparkSession, d: str) -> DataFrame:
    return r6(tr.sample(_points(spark, d), wo.dem(spark), *GRID).select("pid", "h"))


@query("slope_aspect", with_sql("dem", "points") + "," + _P + f""", q AS (SELECT *, x+30 AS xe, x-30 AS xw, y+30 AS yn, y-30 AS ys FROM p),
 s AS (SELECT pid, e, w, n, h AS s FROM {_sample_sql(_sample_sql(_sample_sql(_sample_sql('q', 'xe', 'y', 'e', 'pid,x,y,xw,yn,ys,xe'), 'xw', 'y', 'w', 'pid,x,y,yn,ys,e'), 'x', 'yn', 'n', 'pid,x,ys,e,w'), 'x', 'ys', 'h', 'pid,x,ys,e,w,n')}),
 g AS (SELECT pid, (e-w)/60 AS gx, (n-s)/60 AS gy FROM s)
 SELECT pid, round(degrees(atan(sqrt(gx*gx+gy*gy))),6) AS slope, round(CASE WHEN gx IS NULL OR gy IS NULL THEN NULL WHEN gx=0 AND gy=0 THEN 0 WHEN degrees(atan2(-gx,-gy))<0 THEN degrees(atan2(-gx,-gy))+360 ELSE degrees(atan2(-gx,-gy)) END,6) AS downhill FROM g""")  # fmt: skip
def slope_aspect(spark: SparkSession, d: str) -> DataFrame:
    return r6(tr.slope_aspect(_points(spark, d), wo.dem(spark), *GRID, 30.0).select("pid", "slope", "downhill"))


_LINE = f"""l AS (SELECT pid, i, x+sin(radians(pid*13%360))*60*i AS px, y+cos(radians(pid*13%360))*60*i AS py FROM p, range(11) r(i)),
 h AS (SELECT *, max(CASE WHEN h IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY pid ORDER BY i) AS off, h-first_value(h) OVER (PARTITION BY pid ORDER BY i) AS rise FROM {_sample_sql('l', 'px', 'py')})"""


def _line(spark, d):
    walk = tr.straight_line(_points(spark, d), F.col("pid") * 13 % 360, 600.0, 60.0)
    return tr.relative_profile(tr.sample(walk, wo.dem(spark), *GRID, "px", "py"), ["pid"])


@query("straight_profile", with_sql("dem", "points") + "," + _P + "," + _LINE + " SELECT pid, CAST(i AS INT) AS i, round(rise,6) AS rise FROM h WHERE off=0")
def straight_profile(spark: SparkSession, d: str) -> DataFrame:
    return r6(_line(spark, d).select("pid", "i", "rise"))


@query("horizon", with_sql("dem", "points") + "," + _P + "," + _LINE + " SELECT pid, round(a,6) AS angle, a>=2.5 AS blocked, 10>a AS lit FROM (SELECT pid, coalesce(max(CASE WHEN i>0 THEN degrees(atan2(rise-1.7,i*60.0::DOUBLE)) END),0.0) AS a FROM h WHERE off=0 GROUP BY 1)")
def horizon(spark: SparkSession, d: str) -> DataFrame:
    return r6(tr.horizon(_line(spark, d), ["pid"], 60.0).withColumn("lit", F.lit(10.0) > F.col("angle")))


@query("tile_mosaic", """WITH t AS (SELECT s_suppkey%8 AS tile_x, s_suppkey//8 AS tile_y, cx, cy, ((s_suppkey+cx)%3+128)*256+cy+s_suppkey%200+(cx%7)/256.0::DOUBLE-32768 AS h FROM supplier, range(16) a(cx), range(16) b(cy))
 SELECT CAST(tile_x*16+cx AS INT) AS gx, CAST(tile_y*16+cy AS INT) AS gy, round(h,6) AS h, CAST(round(h) AS SMALLINT) AS whole FROM t""")
def tile_mosaic(spark: SparkSession, d: str) -> DataFrame:
    """A tile of heights for every supplier, put together."""
    k, side = F.col("s_suppkey"), F.sequence(F.lit(0), F.lit(15))
    tiles = wo.dealt(wo.read(spark, d, "supplier").select("s_suppkey"), "s_suppkey", 1000)
    pixels = tiles.select("s_suppkey", F.explode(side).alias("cx")).select("s_suppkey", "cx", F.explode(side).alias("cy"))
    t = pixels.select(
        (k % 8).alias("tile_x"), F.floor(k / 8).alias("tile_y"), "cx", "cy", tr.terrarium((k + F.col("cx")) % 3 + 128, F.col("cy") + k % 200, (F.col("cx") % 7).cast("double")).alias("h")
    )
    out = tr.mosaic(t, 16)
    return r6(out.select(F.col("gx").cast("int").alias("gx"), F.col("gy").cast("int").alias("gy"), "h", tr.as_int16(F.col("h")).alias("whole")))


def _walk(spark, d):
    w = Window.partitionBy("device_id").orderBy("t", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    tele = wo.telemetry(spark, d)
    return tele.withColumns({"d": F.sum(1.0 + F.col("k") % 20).over(w), "alt": F.col("mag") / 100, "i": F.row_number().over(Window.partitionBy("device_id").orderBy("t", "event_id"))})


_WALK = "walk AS (SELECT *, sum(1.0::DOUBLE+k%20) OVER w AS d, mag/100 AS alt, row_number() OVER (PARTITION BY device_id ORDER BY t,event_id) AS i FROM tele WINDOW w AS (PARTITION BY device_id ORDER BY t,event_id ROWS UNBOUNDED PRECEDING))"
_BINS = """, e AS (SELECT *, min(d) OVER (PARTITION BY device_id) AS d0, max(d) OVER (PARTITION BY device_id) AS dn FROM walk),
 b AS (SELECT DISTINCT device_id, d0, unnest(range(CAST(floor((dn-d0)/30) AS BIGINT)+1)) AS i FROM e WHERE dn-d0>=30),
 r AS (SELECT b.device_id, b.i, b.d0+b.i*30 AS target, (SELECT max(x.d) FROM walk x WHERE x.device_id=b.device_id AND (x.d<b.d0+b.i*30 OR x.d=b.d0) AND x.d<>b.dmax) AS da FROM (SELECT b.*, (SELECT max(d) FROM walk q WHERE q.device_id=b.device_id) AS dmax FROM b) b),
 z AS (SELECT r.*, a.alt AS ha, a.heading AS ga, n.d AS db, n.alt AS hb, n.heading AS gb FROM r JOIN walk a ON a.device_id=r.device_id AND a.d=r.da JOIN walk n ON n.device_id=a.device_id AND n.i=a.i+1),
 y AS (SELECT *, (target-da)/(db-da) AS u FROM z)"""


@query("path_bins", with_sql("tele") + "," + _WALK + _BINS + " SELECT device_id, CAST(i AS INT) AS i, round(ha+(hb-ha)*u-first_value(ha+(hb-ha)*u) OVER (PARTITION BY device_id ORDER BY i),9) AS rise, CASE WHEN u<0.5 THEN ga ELSE gb END AS heading FROM y")
def path_bins(spark: SparkSession, d: str) -> DataFrame:
    return se.distance_profile(_walk(spark, d), 30.0, ["device_id"], "heading").withColumn("rise", F.round("rise", 9) + 0.0)


@query("step_bins", with_sql("tele") + "," + _WALK + """, s AS (SELECT *, coalesce(lag(d) OVER (PARTITION BY device_id ORDER BY d),0) AS pd FROM walk)
 SELECT device_id, CAST(unnest(range(greatest(CAST(floor(pd/15) AS BIGINT)+1,1), CAST(floor(d/15) AS BIGINT)+1)) AS INT) AS i, heading, k>50 AS moving FROM s""")
def step_bins(spark: SparkSession, d: str) -> DataFrame:
    return se.step_resample(_walk(spark, d).withColumn("moving", F.col("k") > 50), 15.0, ["device_id"], "d", ["heading", "moving"])


@query("heading_statistics", with_sql("tele") + "," + _WALK + """, q AS (SELECT *, abs((heading-lag(heading) OVER w+180)-360*floor((heading-lag(heading) OVER w+180)/360)-180) AS dh FROM walk WINDOW w AS (PARTITION BY device_id ORDER BY i))
 SELECT device_id, count(*) AS n, round(degrees(sqrt(abs(-2*ln(least(greatest(sqrt(avg(sin(radians(heading)))**2+avg(cos(radians(heading)))**2),1e-9),1.0))))),6) AS deviation, round(coalesce(sum(dh),0),6) AS change,
 CAST(sum(CASE WHEN dh>30 THEN 1 ELSE 0 END) AS BIGINT) AS turns, round(sum(sin(radians(heading))),6) AS end_x, round(sum(cos(radians(heading))),6) AS end_y FROM q GROUP BY 1""")  # fmt: skip
def heading_statistics(spark: SparkSession, d: str) -> DataFrame:
    return r6(se.heading_statistics(_walk(spark, d), ["device_id"]))


def _track(spark, d):
    w = Window.partitionBy("device_id").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    df = _walk(spark, d)
    return df.withColumns({"x": F.sum(F.sin(F.radians("heading")) * 15).over(w), "y": F.sum(F.cos(F.radians("heading")) * 15).over(w)})


_TRACK = _WALK + ", track AS (SELECT *, sum(sin(radians(heading))*15) OVER w AS x, sum(cos(radians(heading))*15) OVER w AS y FROM walk WINDOW w AS (PARTITION BY device_id ORDER BY i ROWS UNBOUNDED PRECEDING))"


@query("retraced_share", with_sql("tele") + "," + _TRACK + """ SELECT a.device_id, CASE WHEN count(*)<6 THEN 0.0 ELSE round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM track b WHERE b.device_id=a.device_id AND b.i<=a.i-4 AND sqrt((a.x-b.x)**2+(a.y-b.y)**2)<=25.5))/count(*)::DOUBLE,6) END AS share FROM track a GROUP BY 1""")
def retraced_share(spark: SparkSession, d: str) -> DataFrame:
    return r6(se.retraced(_track(spark, d), ["device_id"], 25.5))


@query("track_length", with_sql("tele") + "," + _TRACK + ", s AS (SELECT *, sqrt((x-lag(x) OVER w)**2+(y-lag(y) OVER w)**2) AS st FROM track WINDOW w AS (PARTITION BY device_id ORDER BY i)) SELECT device_id, round(coalesce(sum(st),0),6) AS length FROM s GROUP BY 1")
def track_length(spark: SparkSession, d: str) -> DataFrame:
    return r6(se.polyline_length(_track(spark, d), ["device_id"]))


@query("track_resampled", with_sql("tele") + "," + _TRACK + """, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM track WINDOW w AS (PARTITION BY device_id ORDER BY i)), u AS (SELECT *, sqrt((x2-x)**2+(y2-y)**2) AS len FROM s WHERE x2 IS NOT NULL),
 v AS (SELECT *, sum(len) OVER (PARTITION BY device_id ORDER BY i) AS e FROM u), k AS (SELECT *, unnest(range(CAST(ceil((e-len)/22) AS BIGINT), CAST(ceil(e/22) AS BIGINT))) AS k2 FROM v)
 SELECT device_id, CAST(k2 AS INT) AS k, round(x+(x2-x)*(k2*22-(e-len))/len,4) AS x, round(y+(y2-y)*(k2*22-(e-len))/len,4) AS y FROM k""")  # fmt: skip
def track_resampled(spark: SparkSession, d: str) -> DataFrame:
    out = se.along(_track(spark, d), 22.0, ["device_id"])
    return out.select("device_id", "k", *[(geo.rounded(c, 4) + 0.0).alias(c) for c in "xy"])


@query("profile_variance", "SELECT vec_id, round(list_aggregate(list_transform(embedding, lambda v: v::DOUBLE*100),'var_pop'),4) AS variance, list_aggregate(list_transform(embedding, lambda v: v::DOUBLE*100),'var_pop')<1.0 AS flat FROM embeddings")
def profile_variance(spark: SparkSession, d: str) -> DataFrame:
    e = wo.read(spark, d, "embeddings").withColumn("v", se.variance(F.transform("embedding", lambda v: v.cast("double") * 100)))
    return e.select("vec_id", F.round("v", 4).alias("variance"), (F.col("v") < 1.0).alias("flat"))


@query("warp_cost", """WITH RECURSIVE b AS (SELECT list_transform(embedding, lambda v: v::DOUBLE*100) AS o FROM embeddings WHERE vec_id=0), a AS (SELECT vec_id, list_transform(embedding, lambda v: v::DOUBLE*100) AS p FROM embeddings),
 c AS (SELECT vec_id, p, o, 0 AS i, list_concat([0.0::DOUBLE], list_transform(range(64), lambda j: 1e300::DOUBLE)) AS prev FROM a, b
  UNION ALL SELECT vec_id, p, o, i+1, list_reduce(list_transform(range(1,65), lambda j: [CASE WHEN abs(j-(i+1))<=13 THEN abs(p[i+1]-o[j]) ELSE 1e300::DOUBLE END, least(prev[j+1], prev[j])]), lambda acc, t: list_append(acc, CASE WHEN t[1]>=1e299 THEN 1e300::DOUBLE ELSE t[1]+least(t[2], acc[-1]) END), [1e300::DOUBLE]) FROM c WHERE i<64)
 SELECT vec_id, round(prev[65]/128,6) AS cost, round(exp(-pow(prev[65]/128,2)/50),6) AS weight FROM c WHERE i=64""")  # fmt: skip
def warp_cost(spark: SparkSession, d: str) -> DataFrame:
    e = wo.read(spark, d, "embeddings").select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 100).alias("p"))
    observed = e.where("vec_id = 0").select("p").first()
    out = se.dtw(e, "p", list(observed["p"]) if observed else [])
    return r6(out.select("vec_id", "cost", se.likelihood(F.col("cost")).alias("weight")))


_ROADS = """ n AS (SELECT pid, sid, sqrt((x-cx)**2+(y-cy)**2) AS dist, br FROM (SELECT *, ax+u*(ex-ax) AS cx, ay+u*(ey-ay) AS cy FROM (SELECT *, least(1,greatest(0,((x-ax)*(ex-ax)+(y-ay)*(ey-ay))/((ex-ax)**2+(ey-ay)**2))) AS u, CASE WHEN ax=ex THEN 0.0 ELSE 90.0 END AS br FROM {src}, roads)))"""


@query("nearest_road", with_sql("points", "roads") + "," + _ROADS.format(src="points") + """ SELECT pid, round(dist,6) AS dist, sid, br::DOUBLE AS road_bearing FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, sid) AS rn FROM n) WHERE rn=1""")
def nearest_road(spark: SparkSession, d: str) -> DataFrame:
    return r6(sp.nearest_road_anywhere(wo.points(spark, d).select("pid", "x", "y"), wo.roads(spark), ["pid"]).select("pid", "dist", "sid", "road_bearing"))


def _bins(spark, d):
    p = wo.points(spark, d).select("pid", "x", "y").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("heading", F.when(F.col("i") < 3, 90.0).otherwise(0.0))
    w = Window.partitionBy("pid").orderBy("i").rowsBetween(Window.unboundedPreceding, -1)
    r = F.radians("heading")
    return p.withColumns({"x": F.col("x") + F.coalesce(F.sum(F.sin(r) * 15).over(w), F.lit(0.0)), "y": F.col("y") + F.coalesce(F.sum(F.cos(r) * 15).over(w), F.lit(0.0))})


@query("path_adherence", with_sql("points", "roads") + """, w0 AS (SELECT pid, x AS x0, y AS y0, i, CASE WHEN i<3 THEN 90.0 ELSE 0.0 END AS heading FROM points, range(6) r(i)),
 w AS (SELECT pid*10+i AS pid, heading, x0+coalesce(sum(sin(radians(heading))*15) OVER q,0) AS x, y0+coalesce(sum(cos(radians(heading))*15) OVER q,0) AS y FROM w0 WINDOW q AS (PARTITION BY pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),"""
       + _ROADS.format(src="w") + """, m AS (SELECT pid, dist, br, row_number() OVER (PARTITION BY pid ORDER BY dist, sid) AS rn FROM n WHERE dist<=60), s AS (SELECT w.pid//10 AS pid, CASE WHEN abs(heading-br)=0 AND dist<=25 THEN 1-dist/25 ELSE 0 END AS sc FROM w LEFT JOIN m ON m.pid=w.pid AND rn=1)
 SELECT pid, round(avg(sc),6) AS adherence FROM s GROUP BY 1""")  # fmt: skip
def path_adherence(spark: SparkSession, d: str) -> DataFrame:
    return r6(sp.adherence(_bins(spark, d), wo.roads(spark), ["pid"], 25.0))


_FEATURE = " f AS (SELECT p.pid, fid, sqrt((p.x-g.x)**2+(p.y-g.y)**2) AS dist, g.x-p.x AS dx, g.y-p.y AS dy FROM points p, places g WHERE kind='{k}')"


@query("nearest_feature", with_sql("points", "places") + "," + _FEATURE.format(k="peak") + """, r AS (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, fid) AS rn FROM f WHERE dist<=150), b AS (SELECT *, CASE WHEN degrees(atan2(dx,dy))<0 THEN degrees(atan2(dx,dy))+360 ELSE degrees(atan2(dx,dy)) END AS bearing FROM r WHERE rn=1)
 SELECT pid, fid, round(dist,6) AS dist, round(bearing,6) AS bearing, (bearing-45+180)-360*floor((bearing-45+180)/360)-180>10 AS on_right FROM b""")  # fmt: skip
def nearest_feature(spark: SparkSession, d: str) -> DataFrame:
    found = sp.nearest_feature(wo.points(spark, d), wo.places(spark, d).where("kind = 'peak'"), 150.0)
    return r6(found.withColumn("on_right", sp.on_side(F.col("bearing"), F.lit(45.0), "right")))


@query("ranked_features", with_sql("points", "places") + "," + _FEATURE.format(k="poi") + " SELECT pid, CAST(rn AS INT) AS rank, fid, round(dist,6) AS dist, dist<=45 AS near FROM (SELECT *, row_number() OVER (PARTITION BY pid ORDER BY dist, fid) AS rn FROM f WHERE dist<=130) WHERE rn<=3")
def ranked_features(spark: SparkSession, d: str) -> DataFrame:
    found = sp.ranked_features(wo.points(spark, d), wo.places(spark, d).where("kind = 'poi'"), 130.0, 3)
    return r6(found.withColumn("near", F.col("dist") <= 45))


@query("inside_polygons", with_sql("points", "places") + """ SELECT pid, fid FROM points p JOIN places g ON kind='water' AND p.y>g.y-60.5 AND p.y<g.y+60.5 AND abs(p.x-g.x)<60.5-abs(p.y-g.y)""")
def inside_polygons(spark: SparkSession, d: str) -> DataFrame:
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    lakes = wo.places(spark, d).where("kind = 'water'").select("fid", F.array(corner(60.5, 0.0), corner(0.0, 60.5), corner(-60.5, 0.0), corner(0.0, -60.5)).alias("ring"))
    return sp.contains(wo.points(spark, d), lakes, 100.0)


@query("local_frame", "SELECT c_custkey AS id, round((lo+1-lo)*0+10.0+500/111320.0,6) AS lat, round(20.0+300/(111320.0*cos(radians(10.0))),6) AS lon FROM (SELECT c_custkey, 0.0 AS lo FROM customer)")
def local_frame(spark: SparkSession, d: str) -> DataFrame:
    lat, lon = geo.to_degrees(300, 500, 10, 20)
    return wo.read(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.round(lat, 6).alias("lat"), F.round(lon, 6).alias("lon"))
