"""Queries over route search, recovery by questions, walks and their reports, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geo, labels, noise
from ..operators import graph as gr
from ..operators import hypotheses as hy
from ..operators import questions as qu
from ..operators import recovery as re
from ..operators import report as rp
from ..operators import routes as ro
from ..operators import sequences as se
from ..operators import spatial as sp
from ..operators import terrain as tr
from ..operators import walks as wa
from ..sources import worlds as wo
from ..sources.worlds import CELL, SIDE, with_sql
from .motion import r6
from .search import _CLOUD, _EDGES, _OSM, HEADINGS, LONG, SIGMA, START, _cloud, _edges, _elements
from .terrain import _ROADS, _TRACK, _bins, _track

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


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """(fid, kind, name, line): places as lines of three points."""
    at = lambda k: F.struct((F.col("x") + 9.0 * k).alias("x"), (F.col("y") + 6.0 * k).alias("y"))
    return wo.places(spark, d).select("fid", "kind", "name", F.array(at(0), at(1), at(2)).alias("line"))


_LINES = "sides AS (SELECT fid, kind, name, x+9.0*k AS ax, y+6.0*k AS ay, x+9.0*(k+1) AS ex, y+6.0*(k+1) AS ey FROM places, range(2) r(k))"
_TO_SIDE = "sqrt(pow({x}-(ax+least(1,greatest(0,(({x}-ax)*9+({y}-ay)*6)/117.0))*9),2)+pow({y}-(ay+least(1,greatest(0,(({x}-ax)*9+({y}-ay)*6)/117.0))*6),2))"


@query("shortest_routes", """WITH p AS (SELECT c_custkey AS route, c_custkey%81 AS a, c_custkey*7%81 AS b FROM customer) SELECT route, (abs(a%9-b%9)+abs(a//9-b//9))*200.0::DOUBLE AS metres, CAST(abs(a%9-b%9)+abs(a//9-b//9)+1 AS INT) AS nodes FROM p WHERE a<>b""")
def shortest_routes(spark: SparkSession, d: str) -> DataFrame:
    """A route over the street grid for every customer, all searched together."""
    c = F.col("c_custkey")
    pairs = wo.read(spark, d, "customer").select(c.alias("route"), (c % 81).alias("start"), (c * 7 % 81).alias("goal"))
    e = _edges(spark).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("len").alias("metres"))
    return gr.shortest_paths(e, pairs).select("route", "metres", F.size("path").alias("nodes"))


@query("trail_graph", with_sql("places", "roads") + "," + _LINES + """, m AS (SELECT fid, ax, ay, ex, ey, (ax+ex)/2 AS x, (ay+ey)/2 AS y FROM sides),
 far AS (SELECT m.* FROM m WHERE NOT EXISTS (SELECT 1 FROM roads r WHERE sqrt(pow(m.x-greatest(least(m.x,r.ex),r.ax),2)+pow(m.y-greatest(least(m.y,r.ey),r.ay),2))<=25)),
 e AS (SELECT CAST(round(ax/3) AS BIGINT) AS u1, CAST(round(ay/3) AS BIGINT) AS u2, CAST(round(ex/3) AS BIGINT) AS v1, CAST(round(ey/3) AS BIGINT) AS v2 FROM far), b AS (SELECT * FROM e UNION SELECT v1, v2, u1, u2 FROM e)
 SELECT u1*3.0::DOUBLE AS ux, u2*3.0::DOUBLE AS uy, v1*3.0::DOUBLE AS vx, v2*3.0::DOUBLE AS vy FROM b WHERE u1<>v1 OR u2<>v2""")  # fmt: skip
def trail_graph(spark: SparkSession, d: str) -> DataFrame:
    return gr.trail_graph(_lines(spark, d).select("fid", "line"), wo.roads(spark)).select("ux", "uy", "vx", "vy")


@query("extract_classes", "WITH " + _OSM + """, box AS (SELECT id FROM n WHERE lat BETWEEN 40.0099 AND 40.0301 AND lon BETWEEN -79.9995 AND -79.9899), refs AS (SELECT c_custkey AS way, unnest([c_custkey,c_custkey+1,c_custkey+2,c_custkey+52]) AS r FROM customer),
 w AS (SELECT DISTINCT way FROM refs JOIN box ON r=id) SELECT 'way' AS type, way AS id FROM w UNION ALL SELECT 'node', id FROM n WHERE id IN (SELECT r FROM refs JOIN w USING (way))""")  # fmt: skip
def extract_classes(spark: SparkSession, d: str) -> DataFrame:
    return gr.in_classes(_elements(spark, d), "drive", 40.0099, -79.9995, 40.0301, -79.9899).select("type", "id")


@query("line_distances", with_sql("points", "places") + "," + _LINES + f", f AS (SELECT pid, fid, min({_TO_SIDE.format(x='p.x', y='p.y')}) AS dist FROM points p, sides GROUP BY 1,2) SELECT pid, fid, round(dist,6) AS dist FROM f WHERE dist<=40")
def line_distances(spark: SparkSession, d: str) -> DataFrame:
    return r6(sp.feature_distance(wo.points(spark, d), _lines(spark, d), 40.0))


@query("rotation_search")
def rotation_search(spark: SparkSession, d: str) -> DataFrame:
    """The turn at which a walk from any customer's place keeps to the streets best."""
    # Customers of one place are one candidate: only the best of all is told.
    at = wo.points(spark, d).groupBy(F.col("x").alias("x0"), F.col("y").alias("y0")).agg(F.min("pid").alias("pid"))
    p = at.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(5)))).withColumn("heading", F.when(F.col("i") < 3, 80.0).otherwise(350.0))
    return r6(sp.best_rotation(p, wo.roads(spark), ["pid"], 15.0, 25.0))


@query("road_ghosts")
def road_ghosts(spark: SparkSession, d: str) -> DataFrame:
    """Places on the streets of every supplier's town, ten for each block side."""
    roads = wo.towns(spark, d)
    return sp.on_roads(roads, 10 * roads.count(), 8.0, 11)


_ADHERENCE = """ w0 AS (SELECT pid, x AS x0, y AS y0, i, CASE WHEN i<3 THEN 90.0 ELSE 0.0 END AS heading FROM points, range(6) r(i)),
 w AS (SELECT pid*10+i AS pid, heading, x0+coalesce(sum(sin(radians(heading))*15) OVER q,0) AS x, y0+coalesce(sum(cos(radians(heading))*15) OVER q,0) AS y FROM w0 WINDOW q AS (PARTITION BY pid ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),""" + _ROADS.format(src="w") + """,
 m AS (SELECT pid, dist, br, row_number() OVER (PARTITION BY pid ORDER BY dist, sid) AS rn FROM n WHERE dist<=60), s AS (SELECT w.pid//10 AS pid, CASE WHEN abs(heading-br)=0 AND dist<=25 THEN 1-dist/25 ELSE 0 END AS sc FROM w LEFT JOIN m ON m.pid=w.pid AND rn=1), ad AS (SELECT pid, avg(sc) AS fit FROM s GROUP BY 1)"""  # fmt: skip


@query("road_weights", with_sql("points", "roads") + "," + _ADHERENCE + " SELECT p.pid AS cid, round(w*pow(fit,6)/sum(w*pow(fit,6)) OVER (),9) AS w FROM points p JOIN ad ON ad.pid=p.pid")
def road_weights(spark: SparkSession, d: str) -> DataFrame:
    fit = sp.adherence(_bins(spark, d), wo.roads(spark), ["pid"], 25.0).withColumnRenamed("pid", "cid")
    return hy.weigh_by_roads(_cloud(spark, d).select("cid", "x", "y", "w"), fit, 6.0).select("cid", F.round("w", 9).alias("w"))


@query("curve_scores")
def curve_scores(spark: SparkSession, d: str) -> DataFrame:
    """Every customer's place as the start of a walk over one hill to another: heights and streets together."""
    own = wo.points(spark, d).select(F.col("pid").alias("cid"), "x", "y")
    # Each place is walked from and scored once, for all customers who are there.
    start = own.groupBy("x", "y").agg(F.min("cid").alias("cid")).select("cid", "x", "y")
    walk = hy.path_offsets(spark, HEADINGS, 15.0).where(F.col("i") < len(HEADINGS))
    heading = F.element_at(F.array(*[F.lit(h) for h in HEADINGS]), F.col("i") + 1)
    bins = start.crossJoin(F.broadcast(walk)).select("cid", "i", (F.col("x") + F.col("dx")).alias("x"), (F.col("y") + F.col("dy")).alias("y"), heading.alias("heading"))
    fit = sp.adherence(bins, wo.roads(spark), ["cid"], 30.0)
    scored = hy.curve_costs(start, HEADINGS, 15.0, wo.dem(spark), *GRID, OBSERVED).join(fit, "cid")
    scored = scored.select("x", "y", hy.curve_score(F.col("adherence"), F.col("cost"), F.col("length"), len(OBSERVED)).alias("score"))
    return r6(own.join(scored, ["x", "y"]).select("cid", "score"))


#: What a walker to be found has climbed, a value for each bin.
OBSERVED = [0.4 * k for k in range(len(HEADINGS))]


@query("driving_advance", with_sql("roads") + "," + _EDGES + """, v AS (SELECT w.*, (10+w.a%5)*0.9*6 AS st FROM walkers w), moved AS (SELECT a, b, s+st AS s FROM v WHERE s+st<=200 UNION ALL SELECT e.a, e.b, w.s+st-200 FROM v w JOIN edges e ON e.a=w.b AND e.b<>w.a WHERE w.s+st>200 AND abs((e.bearing-90+180)-360*floor((e.bearing-90+180)/360)-180)<=150)
 SELECT a, b, round(s,6)::DOUBLE AS s, count(*) AS n FROM moved GROUP BY 1,2,3""")  # fmt: skip
def driving_advance(spark: SparkSession, d: str) -> DataFrame:
    """Each hypothesis at its own road's speed."""
    e = _edges(spark, d).withColumn("speed", 10.0 + F.col("a") % 5)
    tasks = hy.tasks_for(e)
    moved = hy.advance(hy.seed(e, 50.0, ("len", "speed")), e, hy.driven(6.0, 0.9), 90.0, ("len",), tasks)
    return hy.counted(moved.withColumn("s", F.round("s", 6)), tasks)


@query("long_advance", with_sql("roads") + "," + _EDGES + """, m1 AS (SELECT e.a, e.b, w.s+450-200 AS s FROM walkers w JOIN edges e ON e.a=w.b AND e.b<>w.a WHERE abs((e.bearing-90+180)-360*floor((e.bearing-90+180)/360)-180)<=150),
 m2 AS (SELECT e.a, e.b, m.s-200 AS s FROM m1 m JOIN edges e ON e.a=m.b AND e.b<>m.a WHERE abs((e.bearing-90+180)-360*floor((e.bearing-90+180)/360)-180)<=150), m3 AS (SELECT e.a, e.b, m.s-200 AS s FROM m2 m JOIN edges e ON e.a=m.b AND e.b<>m.a WHERE m.s>200 AND abs((e.bearing-90+180)-360*floor((e.bearing-90+180)/360)-180)<=150)
 SELECT a, b, s::DOUBLE AS s, count(*) AS n FROM (SELECT * FROM m2 WHERE s<=200 UNION ALL SELECT * FROM m3) GROUP BY 1,2,3""")  # fmt: skip
def long_advance(spark: SparkSession, d: str) -> DataFrame:
    """A step of several junctions."""
    e = _edges(spark, d)
    tasks = hy.tasks_for(e)
    return hy.counted(hy.advance(hy.seed(e, 50.0, ("len",)), e, 450.0, 90.0, ("len",), tasks), tasks)


@query("possible_places", with_sql("points", "places", "roads") + "," + _ROADS.format(src="points") + """, near AS (SELECT DISTINCT pid FROM n WHERE dist<=40), wet AS (SELECT DISTINCT pid FROM points p JOIN places g ON kind='water' AND p.y>g.y-60.5 AND p.y<g.y+60.5 AND abs(p.x-g.x)<60.5-abs(p.y-g.y))
 SELECT pid AS cid FROM points WHERE pid NOT IN (SELECT pid FROM wet) AND pid IN (SELECT pid FROM near) AND x<1500""")  # fmt: skip
def possible_places(spark: SparkSession, d: str) -> DataFrame:
    """Hypotheses on roads, out of the water, in the area searched."""
    cloud = _cloud(spark, d)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    lakes = wo.places(spark, d).where("kind = 'water'").select("fid", F.array(corner(60.5, 0.0), corner(0.0, 60.5), corner(-60.5, 0.0), corner(0.0, -60.5)).alias("ring"))
    wet = sp.inside_any(wo.points(spark, d), lakes, 100.0).select(F.col("pid").alias("cid"))
    # One road search for each place, however many hypotheses stand there.
    at = sp.nearest_road(wo.points(spark, d).select("x", "y").distinct(), wo.roads(spark), ["x", "y"]).where("dist <= 40")
    near = wo.points(spark, d).join(at, ["x", "y"], "left_semi").select(F.col("pid").alias("cid"))
    return hy.possible(cloud, "road", wet, cloud.where("x < 1500"), near).select("cid")


def _features(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("kind") == "peak", "stream").when(F.col("kind") == "poi", "meadow").otherwise(F.col("kind"))
    return _lines(spark, d).withColumn("kind", kind)


@query("question_matrix", with_sql("points", "places") + "," + _LINES + f""", k AS (SELECT fid, CASE kind WHEN 'peak' THEN 'stream' WHEN 'poi' THEN 'meadow' ELSE kind END AS kind, ax, ay FROM sides), f AS (SELECT pid, kind, min({_TO_SIDE.format(x='p.x', y='p.y')}) AS dist FROM points p, k GROUP BY 1,2),
 q AS (SELECT * FROM (VALUES ('water',['water','stream'],25),('wood',['wood'],20),('meadow',['meadow'],25),('wetland',['wetland'],25),('park',['park'],30)) v(q,kinds,reach))
 SELECT q, CAST(count(*) AS BIGINT) AS asked, CAST(sum(yes::INT) AS BIGINT) AS yes FROM (SELECT q, pid, EXISTS (SELECT 1 FROM f WHERE f.pid=p.pid AND list_contains(kinds,f.kind) AND dist<=reach) AS yes FROM points p, q) GROUP BY 1""")  # fmt: skip
def question_matrix(spark: SparkSession, d: str) -> DataFrame:
    """Of every question off roads how many hypotheses say yes."""
    asked = qu.bank(_cloud(spark, d), _features(spark, d), nature=True)
    return asked.groupBy("q").agg(F.count("*").alias("asked"), F.sum(F.col("yes").cast("int")).alias("yes"))


@query("named_questions", with_sql("points", "places") + "," + _LINES + f""", l AS (SELECT name, min({_TO_SIDE.format(x='900', y='900')}) AS dist FROM sides WHERE kind='poi' AND name IS NOT NULL AND name<>'' GROUP BY 1), c AS (SELECT name FROM l WHERE dist<130 ORDER BY dist, name LIMIT 3)
 SELECT name AS q, CAST(sum(yes::INT) AS BIGINT) AS yes FROM (SELECT c.name, p.pid, EXISTS (SELECT 1 FROM sides s WHERE s.kind='poi' AND s.name=c.name AND {_TO_SIDE.format(x='p.x', y='p.y')}<=45) AS yes FROM points p, c) GROUP BY 1""")  # fmt: skip
def named_questions(spark: SparkSession, d: str) -> DataFrame:
    """The named places nearest to a lead, and how many hypotheses see each."""
    found = qu.named(_cloud(spark, d), _lines(spark, d).where("kind = 'poi'"), "poi", F.lit(900.0), F.lit(900.0))
    return found.groupBy("q").agg(F.sum(F.col("yes").cast("int")).alias("yes"))


@query("horizon_question")
def horizon_question(spark: SparkSession, d: str) -> DataFrame:
    return qu.horizon_question(_cloud(spark, d), wo.dem(spark), *GRID)


@query("recovery_run")
def recovery_run(spark: SparkSession, d: str) -> DataFrame:
    """One cycle of the engine over a cloud of customers' places: weighed by a walk's heights, resampled, told."""
    cloud = _cloud(spark, d).select("cid", "x", "y", "w")
    truth = hy.path_profiles(spark.range(1).select(F.col("id").alias("cid"), F.lit(START[0]).alias("x"), F.lit(START[1]).alias("y")), LONG, 15.0, wo.dem(spark), *GRID)
    seen = list(truth.first()["profile"])
    p = hy.path_profiles(cloud.select("cid", "x", "y"), LONG, 15.0, wo.dem(spark), *GRID).where(F.size("profile") >= max(2, len(seen) // 2))
    fit = se.dtw(p, "profile", seen).select("cid", se.likelihood(F.col("cost"), SIGMA).alias("likelihood"))
    after, told = hy.recovery_step(cloud, fit, 100.0)
    return after.agg(F.count("*").alias("n"), F.round(F.sum("w"), 6).alias("w")).withColumn("state", F.lit(told))


def _area():
    return F.lit(0).cast("long").alias("area")


def _nodes(spark: SparkSession) -> DataFrame:
    return spark.range(81).select(_area(), F.col("id").alias("node"), (F.col("id") % 9 * 200.0).alias("x"), (F.floor(F.col("id") / 9) * 200.0).alias("y"))


@query("generated_walks")
def generated_walks(spark: SparkSession, d: str) -> DataFrame:
    """Walks that no other repeats, with turns enough, from the busy corners of the street grid."""
    starts = spark.range(40).select(_area(), F.col("id").alias("walk"), (F.col("id") * 17 % 81).alias("node"), (F.col("id") + 1000).alias("seed"))
    return wa.generate(starts, _edges(spark).select(_area(), "a", "b", "len"), _nodes(spark), 2000.0, "trail", 2)


@query("terrain_walks")
def terrain_walks(spark: SparkSession, d: str) -> DataFrame:
    from .recovery import ground

    s = wo.points(spark, d).select(F.col("pid").alias("walk"), "x", "y", F.col("pid").alias("seed"))
    return r6(re.terrain_walks(s, ground, 15.0, 20, 0.5, 1770.0, 1770.0))


@query("driven_walks")
def driven_walks(spark: SparkSession, d: str) -> DataFrame:
    """Drives over the street grid, matched at the speed scale that fits best."""
    e = _edges(spark).withColumns({"area": F.lit(0).cast("long"), "speed": F.lit(10.0)})
    starts = spark.range(8).select(_area(), F.col("id").alias("walk"), (F.col("id") * 17 % 81).alias("node"), (F.col("id") + 500).alias("seed"))
    path = wa.random_walks(starts, e, 2400.0, "trail")
    w = Window.partitionBy("walk").orderBy("i")
    side = path.withColumn("to", F.lead("node").over(w)).where("to IS NOT NULL").join(e.select(F.col("a").alias("node"), F.col("b").alias("to"), "bearing"), ["node", "to"])
    bins = side.select("area", "walk", (F.col("i") * 10).alias("i0"), F.col("bearing").alias("heading"), F.explode(F.sequence(F.lit(0), F.lit(9))).alias("j"))
    bins = bins.select("area", "walk", (F.col("i0") + F.col("j")).alias("i"), "heading", F.lit(0.0).alias("climb"), F.lit(20 / 11.5).alias("seconds"))
    return r6(wa.match_walks(bins, e, 25.0, None, (0.85, 1.0, 1.15), search_spacing=50.0))


@query("mock_acceleration")
def mock_acceleration(spark: SparkSession, d: str) -> DataFrame:
    tele = wo.telemetry(spark, d).withColumn("a", noise.accelerations(F.col("k") % 3 > 0, 7, "event_id"))
    return r6(tele.select("event_id", "a.x", "a.y", "a.z"))


@query("route_flags", with_sql("tele") + """ SELECT event_id, coalesce(k%4<>0 AND abs(k%13)<10 AND abs((heading-90+180)-360*floor((heading-90+180)/360)-180)>60,false) AS off_route, k%2=0 AND abs(k%91-45)>=30 AND k%200<=120 AND abs(k%60)>=0.5*abs(k%91-45) AS turned, k%5>=2 AND k%3<>0 AS advances FROM tele""")
def route_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    return wo.telemetry(spark, d).select(
        "event_id", ro.off_route(F.col("heading"), F.lit(90.0), k % 4 == 0, (k % 13).cast("double")).alias("off_route"),
        ro.turn_confirmed(k % 91 - 45, k % 60, k % 200, k % 2 == 0).alias("turned"), ro.auto_advances(k % 5, k % 3 == 0).alias("advances"),
    )


@query("milestone_texts", """SELECT c_custkey AS id, CASE c_custkey%6 WHEN 5 THEN 'Approaching your destination' ELSE 'Approaching '||['stop sign','traffic light','crossing','roundabout','the intersection'][CAST(c_custkey%6 AS INT)+1]||CASE c_custkey%3 WHEN 0 THEN ' on Main St' ELSE '' END END AS text,
 CASE WHEN c_nationkey>0 THEN CAST(CAST(round(c_nationkey*2.237) AS BIGINT) AS VARCHAR)||' mph' ELSE '—' END AS speed_limit, CASE WHEN c_custkey%2000>=1000 THEN printf('~%.1f km away',(c_custkey%2000)/1000.0::DOUBLE) ELSE '~'||(c_custkey%2000)||' m away' END AS away FROM customer""")  # fmt: skip
def milestone_texts(spark: SparkSession, d: str) -> DataFrame:
    c = F.col("c_custkey")
    kinds = F.array(*[F.lit(x) for x in ("stop_sign", "traffic_light", "crossing", "roundabout", "intersection", "destination")])
    road = F.when(c % 3 == 0, "Main St").when(c % 3 == 1, "unnamed road")
    return wo.read(spark, d, "customer").select(
        c.alias("id"), labels.milestone_text(F.get(kinds, (c % 6).cast("int")), road).alias("text"), labels.limit_text(F.col("c_nationkey").cast("double")).alias("speed_limit"), labels.away_text((c % 2000).cast("double")).alias("away"),
    )


@query("decimal_years", "SELECT event_id, round(year(ts)+(epoch_us(ts)-epoch_us(make_timestamp(year(ts),1,1,0,0,0.0)))/(epoch_us(make_timestamp(year(ts)+1,1,1,0,0,0.0))-epoch_us(make_timestamp(year(ts),1,1,0,0,0.0)))::DOUBLE,6) AS year FROM events")
def decimal_years(spark: SparkSession, d: str) -> DataFrame:
    return r6(wo.read(spark, d, "events").select("event_id", geo.decimal_year(F.col("ts").cast("timestamp")).alias("year")))


@query("walk_ends", with_sql("tele") + " SELECT device_id, round(sum(sin(radians(heading))*15),5) AS dx, round(sum(cos(radians(heading))*15),5) AS dy FROM tele GROUP BY 1")
def walk_ends(spark: SparkSession, d: str) -> DataFrame:
    out = hy.walk_end(wo.telemetry(spark, d), ["device_id"], 15.0)
    return out.select("device_id", *[(F.round(c, 5) + 0.0).alias(c) for c in ("dx", "dy")])


@query("expanded_boxes", with_sql("legs") + """, b AS (SELECT route, min((seq*7+route)%50)-0.005::DOUBLE AS s, min((seq*5+route)%40)-0.005::DOUBLE AS w, max((seq*7+route)%50)+0.005::DOUBLE AS n, max((seq*5+route)%40)+0.005::DOUBLE AS e FROM legs GROUP BY 1), i AS (SELECT *, (s+n)/2 BETWEEN 10 AND 30 AND (w+e)/2 BETWEEN 10 AND 30 AS inside FROM b)
 SELECT route, round(CASE WHEN inside THEN least(s,10) ELSE s END,6) AS s, round(CASE WHEN inside THEN least(w,10) ELSE w END,6) AS w, round(CASE WHEN inside THEN greatest(n,30) ELSE n END,6) AS n, round(CASE WHEN inside THEN greatest(e,30) ELSE e END,6) AS e FROM i""")  # fmt: skip
def expanded_boxes(spark: SparkSession, d: str) -> DataFrame:
    box = re.padded_box(wo.legs(spark, d).select("route", ((F.col("seq") * 7 + F.col("route")) % 50).alias("lat"), ((F.col("seq") * 5 + F.col("route")) % 40).alias("lon")))
    return r6(re.expanded(box, 10.0, 10.0, 30.0, 30.0))


@query("calibrated_speeds", with_sql("legs") + """, l AS (SELECT route, list(metres/greatest(seconds,3) ORDER BY seq) AS xs FROM legs GROUP BY 1)
 SELECT route, round(list_reduce(xs[2:], lambda a, v: least(greatest(a*0.7::DOUBLE+v*0.3::DOUBLE,1.0::DOUBLE),45.0::DOUBLE), least(greatest(xs[1],1.0::DOUBLE),45.0::DOUBLE))+3.14159e-8,6) AS speed FROM l""")  # fmt: skip
def calibrated_speeds(spark: SparkSession, d: str) -> DataFrame:
    out = ro.smoothed_speeds(wo.legs(spark, d), calibrated=True)
    return out.select("route", F.round(F.element_at("out", -1) + 3.14159e-8, 6).alias("speed"))


@query("track_headings", with_sql("tele") + "," + _TRACK + """, s AS (SELECT *, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM track WINDOW w AS (PARTITION BY device_id ORDER BY i)), u AS (SELECT *, sqrt((x2-x)**2+(y2-y)**2) AS len FROM s WHERE x2 IS NOT NULL),
 v AS (SELECT *, sum(len) OVER (PARTITION BY device_id ORDER BY i) AS e FROM u), k AS (SELECT *, unnest(range(CAST(ceil((e-len)/22.013) AS BIGINT), CAST(ceil(e/22.013) AS BIGINT))) AS k2 FROM v)
 SELECT device_id, CAST(k2 AS INT) AS k, round(CASE WHEN degrees(atan2(x2-x,y2-y))<-1e-9 THEN degrees(atan2(x2-x,y2-y))+360 ELSE abs(degrees(atan2(x2-x,y2-y))) END,3) AS heading FROM k""")  # fmt: skip
def track_headings(spark: SparkSession, d: str) -> DataFrame:
    out = se.along(_track(spark, d), 22.013, ["device_id"], heading=True)
    return out.select("device_id", "k", (F.round("heading", 3) + 0.0).alias("heading"))


@query("compact_results", with_sql("tele") + """, w AS (SELECT device_id AS walk, row_number() OVER (PARTITION BY device_id ORDER BY t,event_id) AS i, mag/100 AS elev, k FROM tele), x AS (SELECT *, elev-lag(elev) OVER (PARTITION BY walk ORDER BY i) AS dd FROM w)
 SELECT walk, count(*)>20 AS located, round(max(k)*1.0,1)::DOUBLE AS "locatedErrorM", round(avg(k)/100,4) AS "locatedConc", 40.5::DOUBLE AS "locatedLat", -80.25::DOUBLE AS "locatedLon", 40.75::DOUBLE AS "trueEndLat", -80.125::DOUBLE AS "trueEndLon", CAST(count(*)%7 AS BIGINT) AS "qAnsweredCount", CAST(count(*)%5 AS BIGINT) AS "significantTurns",
 round(stddev_pop(k),2) AS "headingStdDev", round(sum(k)*1.0,1)::DOUBLE AS "totalHeadingChangeDeg", round(coalesce(sum(CASE WHEN dd>0 THEN dd ELSE 0 END),0),1) AS "elevGainM", round(max(elev)-min(elev),1) AS "elevRangeM", count(*) AS "walkSteps", count(*)*15 AS "walkDistanceM", round(min(k)*1.0,1)::DOUBLE AS "preQuestionErrorM", 0.5::DOUBLE AS "preQuestionConc", CAST(count(*)%3 AS BIGINT) AS "minQuestionsUsed" FROM x GROUP BY 1""")  # fmt: skip
def compact_results(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("device_id").orderBy("t", "event_id")
    tele = wo.telemetry(spark, d).select(F.col("device_id").alias("walk"), F.row_number().over(w).alias("i"), (F.col("mag") / 100).alias("elev"), "k")
    n, k = F.count("*"), F.col("k")
    in_order = F.transform(F.array_sort(F.collect_list(F.struct("i", "k"))), lambda s: s["k"])
    walks = tele.groupBy("walk").agg(
        (n > 20).alias("located"), F.max(k).cast("double").alias("error"), (F.avg(k) / 100).alias("conc"), F.lit(40.5).alias("lat"), F.lit(-80.25).alias("lon"), F.lit(40.75).alias("end_lat"), F.lit(-80.125).alias("end_lon"), (n % 7).alias("asked"), (n % 5).alias("turns"),
        se.deviation(in_order).alias("heading_sd"), F.sum(k).cast("double").alias("turned"), n.alias("steps"), (n * 15).cast("double").alias("metres"), F.min(k).cast("double").alias("pre_error"), F.lit(0.5).alias("pre_conc"), (n % 3).alias("least_asked"),
    )
    return rp.compact_rows(walks, tele.select("walk", "i", "elev"))


@query("lit_places")
def lit_places(spark: SparkSession, d: str) -> DataFrame:
    """Where the sun reaches the ground at an hour of the evening."""
    p = wo.points(spark, d).select("pid", "x", "y")
    return tr.sunlit(p, wo.dem(spark), *GRID, 40.0, -80.0, 1_718_920_800.0)
