"""Queries over hypotheses, graphs, payloads and benchmark results, with their DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import graph as gr
from ..operators import hypotheses as hy
from ..operators import report as rp
from ..operators import sequences as se
from ..operators import terrain as tr
from ..sources import payloads as pl
from ..sources.tables import settled
from ..sources import worlds as wo
from ..sources.worlds import CELL, SIDE, with_sql
from .motion import r6
from .terrain import _sample_sql

Q: dict = {}
SQL: dict[str, str] = {}
GRID = (SIDE, SIDE, CELL)
HEADINGS = [90.0] * 12 + [0.0] * 10
#: The walk to be localised: east over one hill, then to the top of another.
START, LONG, SIGMA = (300.0, 1180.0), [90.0] * 25 + [144.0] * 31, 1.0


def query(name: str, sql: str | None = None):
    def put(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


_WALKS = "h AS (SELECT i, CASE WHEN i<12 THEN 90.0 ELSE 0.0 END AS heading FROM range(22) r(i)), off AS (SELECT i, coalesce(sum(sin(radians(heading))*15) OVER w,0) AS dx, coalesce(sum(cos(radians(heading))*15) OVER w,0) AS dy FROM h WINDOW w AS (ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"
_GRID = "cand AS (SELECT pid AS cid, x, y FROM points)"


def _profiles(spark: SparkSession, d: str) -> DataFrame:
    cand = wo.points(spark, d).select(F.col("pid").alias("cid"), "x", "y")
    return hy.path_profiles(cand, HEADINGS, 15.0, wo.dem(spark), *GRID)


@query("path_profiles", with_sql("dem", "points") + "," + _WALKS + "," + _GRID + f""", p AS (SELECT cid, i, x+dx AS px, y+dy AS py FROM cand, off), s AS (SELECT *, max(CASE WHEN h IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY cid ORDER BY i) AS cut FROM {_sample_sql('p', 'px', 'py')})
 SELECT cid, count(*) FILTER (WHERE cut=0) AS n, round(coalesce(sum(h-h0) FILTER (WHERE cut=0),0),4) AS total FROM (SELECT *, first_value(h) OVER (PARTITION BY cid ORDER BY i) AS h0 FROM s) GROUP BY 1""")  # fmt: skip
def path_profiles(spark: SparkSession, d: str) -> DataFrame:
    p = _profiles(spark, d)
    return p.select("cid", F.size("profile").cast("long").alias("n"), (F.round(F.aggregate("profile", F.lit(0.0), lambda a, x: a + x), 4) + 0.0).alias("total"))


@query("localised_walk")
def localised_walk(spark: SparkSession, d: str) -> DataFrame:
    """Off-trail: profiles from a grid of candidates, time-warp likelihood, normalised, clustered."""
    truth = hy.path_profiles(spark.range(1).select(F.col("id").alias("cid"), F.lit(START[0]).alias("x"), F.lit(START[1]).alias("y")), LONG, 15.0, wo.dem(spark), *GRID).first()["profile"]
    cand = hy.candidate_grid(spark, 0.0, 0.0, 1700.0, 1700.0)
    # A row of a few numbers for each candidate: used twice, computed once.
    p = settled(hy.curve_costs(cand, LONG, 15.0, wo.dem(spark), *GRID, list(truth)).where(F.col("length") >= max(2, len(truth) // 2)))
    p = p.withColumns({"score": se.likelihood(F.col("cost"), SIGMA), "constraint": F.lit(1.0), "run": F.lit(0).cast("long")})
    return r6(hy.clusters(hy.normalise(p), 120.0))


_CLOUD = "cloud AS (SELECT pid AS cid, x, y, w/sum(w) OVER () AS w FROM points)"


def _cloud(spark, d):
    p = wo.points(spark, d).select(F.col("pid").alias("cid"), "x", "y", F.col("w").alias("score"), F.lit(1.0).alias("constraint"))
    return hy.normalise(p)


@query("cloud_weights", with_sql("points") + """, c AS (SELECT pid AS cid, w*CASE WHEN x>800 THEN 1 ELSE 0.25 END*CASE WHEN y<1500 THEN 1 ELSE 0 END AS r FROM points) SELECT cid, round(r/sum(r) OVER (),9) AS w FROM c""")
def cloud_weights(spark: SparkSession, d: str) -> DataFrame:
    p = hy.constrain(hy.constrain(_cloud(spark, d), F.col("x") > 800, hard=False), F.col("y") < 1500, hard=True)
    return hy.normalise(p).select("cid", F.round("w", 9).alias("w"))


@query("cloud_summary", with_sql("points") + "," + _CLOUD + """, m AS (SELECT sum(x*w)/sum(w) AS mx, sum(y*w)/sum(w) AS my, max(w) AS top FROM cloud)
 SELECT round(mx,4) AS mx, round(my,4) AS my, round(sqrt(sum(w*((x-mx)**2+(y-my)**2))/sum(w)),4) AS spread, round(sum(w)*sum(w)/sum(w*w),4) AS ess, round(sum(CASE WHEN sqrt((x-mx)**2+(y-my)**2)<=400 THEN w ELSE 0 END)/sum(w),6) AS inside, CAST(sum(CASE WHEN w>0.05*top THEN 1 ELSE 0 END) AS BIGINT) AS live FROM cloud, m GROUP BY mx, my""")  # fmt: skip
def cloud_summary(spark: SparkSession, d: str) -> DataFrame:
    s = hy.summary(_cloud(spark, d), 400.0)
    return s.select(*[F.round(c, 4).alias(c) for c in ("mx", "my", "spread", "ess")], F.round("inside", 6).alias("inside"), "live")


@query("coverage_count", with_sql("points") + ", k AS (SELECT pid%40 AS cid, sum(w) AS w FROM points GROUP BY 1), r AS (SELECT *, sum(w) OVER (ORDER BY w DESC, cid ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER () AS t FROM k) SELECT CAST(sum(CASE WHEN run<0.85*t THEN 1 ELSE 0 END)+1 AS BIGINT) AS n FROM r")
def coverage_count(spark: SparkSession, d: str) -> DataFrame:
    return hy.coverage_count(wo.points(spark, d).groupBy((F.col("pid") % 40).alias("cid")).agg(F.sum("w").alias("w")))


@query("systematic_resample", with_sql("points") + "," + _CLOUD + """, c AS (SELECT cid, sum(w) OVER (ORDER BY cid ROWS UNBOUNDED PRECEDING) AS c, w FROM cloud), k AS (SELECT i AS k, (i+0.37::DOUBLE)/500 AS u FROM range(500) r(i)) SELECT CAST(k AS INT) AS k, cid FROM k JOIN c ON u>=c-w AND u<c""")
def systematic_resample(spark: SparkSession, d: str) -> DataFrame:
    return hy.resample(_cloud(spark, d), 500, 0.37)


@query("cloud_clusters")
def cloud_clusters(spark: SparkSession, d: str) -> DataFrame:
    return r6(hy.clusters(_cloud(spark, d).withColumn("run", F.col("cid") % 8), 200.0))


def _edges(spark: SparkSession, d: str | None = None) -> DataFrame:
    """The street grid's directed edges; with tables, a town of them for each supplier."""
    from ..functions.geo import planar_bearing

    r = wo.towns(spark, d) if d else wo.roads(spark).withColumn("town", F.lit(0).cast("long"))
    node = lambda x, y: F.col("town") * 81 + (F.col(x) / 200 + F.col(y) / 200 * 9).cast("long")
    out = r.select(node("ax", "ay").alias("a"), node("bx", "by").alias("b"), "ax", "ay", "bx", "by")
    back = out.select(F.col("b").alias("a"), F.col("a").alias("b"), F.col("bx").alias("ax"), F.col("by").alias("ay"), F.col("ax").alias("bx"), F.col("ay").alias("by"))
    return out.unionByName(back).withColumns({"len": F.hypot(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay")), "bearing": planar_bearing(F.col("bx") - F.col("ax"), F.col("by") - F.col("ay"))})


_EDGES = """e1 AS (SELECT s_suppkey*81+CAST(ax/200+ay/200*9 AS BIGINT) AS a, s_suppkey*81+CAST(ex/200+ey/200*9 AS BIGINT) AS b, ax, ay, ex, ey FROM roads, supplier), edges AS (SELECT *, 200.0 AS len, CASE WHEN ax=ex THEN 0.0 ELSE 90.0 END AS bearing FROM e1 UNION ALL SELECT b, a, ex, ey, ax, ay, 200.0, CASE WHEN ax=ex THEN 180.0 ELSE 270.0 END FROM e1),
 walkers AS (SELECT a, b, 25.0+k*50 AS s FROM edges, range(4) r(k))"""


@query("road_seeds", with_sql("roads") + "," + _EDGES + " SELECT a, b, s::DOUBLE AS s FROM walkers")
def road_seeds(spark: SparkSession, d: str) -> DataFrame:
    return hy.seed(_edges(spark, d), 50.0)


@query("seed_spacing", with_sql("roads") + " SELECT round(greatest(12, 28800.0*(SELECT count(*) FROM supplier)/300),6)::DOUBLE AS spacing")
def seed_spacing(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).agg(F.round(hy.spacing_for(_edges(spark, d), 300), 6).alias("spacing"))


_MOVED = """, moved AS (SELECT a, b, s+60 AS s FROM walkers WHERE s+60<=200 UNION ALL SELECT e.a, e.b, w.s+60-200 FROM walkers w JOIN edges e ON e.a=w.b AND e.b<>w.a WHERE w.s+60>200 AND abs((e.bearing-90+180)-360*floor((e.bearing-90+180)/360)-180)<=150)"""


@query("road_advance", with_sql("roads") + "," + _EDGES + _MOVED + " SELECT a, b, s::DOUBLE AS s, count(*) AS n FROM moved GROUP BY 1,2,3")
def road_advance(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    tasks = hy.tasks_for(e)
    return hy.counted(hy.advance(hy.seed(e, 50.0, ("len",)), e, 60.0, 90.0, ("len",), tasks), tasks)


@query("road_scores", with_sql("roads", "dem") + "," + _EDGES + _MOVED + f""", p AS (SELECT m.a, m.b, m.s, e.bearing, e.ax+(e.ex-e.ax)*m.s/200 AS px, e.ay+(e.ey-e.ay)*m.s/200 AS py FROM moved m JOIN edges e ON e.a=m.a AND e.b=m.b),
 g AS (SELECT *, abs((bearing-90+180)-360*floor((bearing-90+180)/360)-180) AS dh FROM {_sample_sql('p', 'px', 'py')}),
 sc AS (SELECT a, b, s, -least(dh*dh/1250+coalesce((h-1.5)**2/18,0),5) AS logw FROM g),
 bst AS (SELECT *, row_number() OVER (PARTITION BY a,b,round(s/8) ORDER BY logw DESC, s) AS rn FROM sc)
 SELECT a, b, s::DOUBLE AS s, round(logw,6) AS logw FROM (SELECT * FROM bst WHERE rn=1 ORDER BY logw DESC, a, b, s LIMIT 100)""")  # fmt: skip
def road_scores(spark: SparkSession, d: str) -> DataFrame:
    e = _edges(spark, d)
    tasks, keep = hy.tasks_for(e), ("ax", "ay", "bx", "by", "len", "bearing")
    w = hy.advance(hy.seed(e, 50.0, keep).withColumns({"logw": F.lit(0.0), "e_prev": F.lit(0.0)}), e, 60.0, 90.0, keep, tasks)
    at = w.withColumns({"px": F.col("ax") + (F.col("bx") - F.col("ax")) * F.col("s") / F.col("len"), "py": F.col("ay") + (F.col("by") - F.col("ay")) * F.col("s") / F.col("len")})
    at = tr.sample(at, wo.dem(spark), *GRID, "px", "py").select("a", "b", "s", "logw", "e_prev", "h", "bearing")
    return r6(hy.merge_and_prune(hy.score(at, e, 90.0, 1.5, 25.0, 3.0), 100, tasks).select("a", "b", "s", "logw"))


_ASK = "q AS (SELECT q, (cid*(q+3))%(q+2)=0 AS yes, w FROM cloud, range(6) r(q))"


@query("best_split", with_sql("points") + "," + _CLOUD + "," + _ASK + " SELECT q, round(share,6) AS share FROM (SELECT q, sum(CASE WHEN yes THEN w ELSE 0 END)/sum(w) AS share FROM q GROUP BY 1) WHERE share BETWEEN 0.18 AND 0.82 ORDER BY round(abs(share-0.5),9), q LIMIT 1")
def best_split(spark: SparkSession, d: str) -> DataFrame:
    a = _cloud(spark, d).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("yes", F.col("cid") * (F.col("q") + 3) % (F.col("q") + 2) == 0)
    return r6(hy.best_split(a))


@query("even_question", with_sql("points") + "," + _CLOUD + "," + _ASK + " SELECT q, CAST(least(sum(yes::INT), sum((NOT yes)::INT)) AS BIGINT) AS score FROM q GROUP BY 1 HAVING score>=1 ORDER BY score DESC, q LIMIT 1")
def even_question(spark: SparkSession, d: str) -> DataFrame:
    a = _cloud(spark, d).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(5).cast("long")))).withColumn("yes", F.col("cid") * (F.col("q") + 3) % (F.col("q") + 2) == 0)
    return hy.even_question(a)


@query("question_bank", "SELECT min(p_partkey) AS q, p_type AS text FROM part GROUP BY 2")
def question_bank(spark: SparkSession, d: str) -> DataFrame:
    return hy.without_repeats(wo.read(spark, d, "part").select(F.col("p_partkey").alias("q"), F.col("p_type").alias("text")))


def _elements(spark: SparkSession, d: str) -> DataFrame:
    c = wo.read(spark, d, "customer").select((F.col("c_custkey")).alias("id"))
    grid = [("type", F.lit("node")), ("id", F.col("id")), ("lat", 40 + F.col("id") % 50 * 0.001), ("lon", -80 + F.floor(F.col("id") / 50) * 0.001), ("nodes", F.lit(None).cast("array<long>")), ("tags", F.create_map(F.lit("highway"), F.when(F.col("id") % 7 == 0, "stop").otherwise("x")))]
    node = c.select(*[v.alias(k) for k, v in grid])
    way = c.select(F.lit("way").alias("type"), "id", F.lit(None).cast("double").alias("lat"), F.lit(None).cast("double").alias("lon"), F.array(F.col("id"), F.col("id") + 1, F.col("id") + 2, F.col("id") + 52).alias("nodes"),
                                        F.create_map(F.lit("highway"), F.lit("primary"), F.lit("maxspeed"), F.when(F.col("id") % 20 == 0, "30 mph").otherwise("50"), F.lit("oneway"), F.when(F.col("id") % 30 == 0, "yes").otherwise("no")).alias("tags"))
    return node.unionByName(way)


_OSM = """n AS (SELECT c_custkey AS id, 40+c_custkey%50*0.001::DOUBLE AS lat, -80+(c_custkey//50)*0.001::DOUBLE AS lon FROM customer),
 st AS (SELECT c_custkey AS way, unnest([[c_custkey,c_custkey+1],[c_custkey+1,c_custkey+2],[c_custkey+2,c_custkey+52]]) AS p FROM customer),
 e0 AS (SELECT way, p[1] AS u, p[2] AS v, CASE WHEN way%20=0 THEN 30*0.44704::DOUBLE ELSE 50/3.6::DOUBLE END AS speed, 2*6371000*asin(least(1,sqrt(sin(radians(b.lat-a.lat)/2)**2+cos(radians(a.lat))*cos(radians(b.lat))*sin(radians(b.lon-a.lon)/2)**2))) AS metres FROM st JOIN n a ON a.id=p[1] JOIN n b ON b.id=p[2]),
 e AS (SELECT u, v, way, metres, speed FROM e0 UNION ALL SELECT v, u, way, metres, speed FROM e0 WHERE way%30<>0)"""


@query("map_edges", "WITH " + _OSM + " SELECT u, v, way, round(metres,3) AS metres, round(speed,6) AS speed FROM e")
def map_edges(spark: SparkSession, d: str) -> DataFrame:
    el = _elements(spark, d)
    return gr.edges(el, gr.nodes(el)).select("u", "v", "way", F.round("metres", 3).alias("metres"), F.round("speed", 6).alias("speed"))


@query("map_nodes", "WITH " + _OSM + " SELECT id, CASE WHEN id%7=0 THEN 'stop_sign' ELSE 'intersection' END AS kind, deg AS degree FROM n LEFT JOIN (SELECT u, count(DISTINCT v) AS deg FROM e GROUP BY 1) ON u=id")
def map_nodes(spark: SparkSession, d: str) -> DataFrame:
    el = _elements(spark, d)
    n = gr.nodes(el)
    return n.join(gr.degrees(gr.edges(el, n)), F.col("u") == F.col("id"), "left").select("id", "kind", "degree")


@query("parallel_edges", "WITH " + _OSM + ", o AS (SELECT u, v, min(metres) AS m FROM e GROUP BY 1,2) SELECT coalesce(o.u,b.u) AS u, coalesce(o.v,b.v) AS v, round(coalesce(o.m,b.m),3) AS metres FROM o FULL JOIN (SELECT v AS u, u AS v, m FROM o) b ON o.u=b.u AND o.v=b.v")
def parallel_edges(spark: SparkSession, d: str) -> DataFrame:
    el = _elements(spark, d)
    return gr.shortest_parallel(gr.edges(el, gr.nodes(el))).select("u", "v", F.round("metres", 3).alias("metres"))


@query("graph_fresh", "SELECT true AS fresh")
def graph_fresh(spark: SparkSession, d: str) -> DataFrame:
    return gr.covers(gr.nodes(_elements(spark, d)), 40.05, 40.0, -79.9, -80.0)


@query("street_distances", with_sql("roads") + ", g AS (SELECT x, y FROM range(9) a(x), range(9) b(y)) SELECT s_suppkey AS town, s_suppkey*81+CAST(x+y*9 AS BIGINT) AS node, (x+y)*200.0::DOUBLE AS metres FROM g, supplier")
def street_distances(spark: SparkSession, d: str) -> DataFrame:
    """How far every corner of each town is from its first."""
    e = _edges(spark, d).select(F.col("a").alias("u"), F.col("b").alias("v"), F.col("len").alias("metres"))
    towns = wo.read(spark, d, "supplier").select(F.col("s_suppkey").alias("route"), (F.col("s_suppkey") * 81).alias("start"))
    return gr.distances_from(e, towns).select(F.col("route").alias("town"), "node", "metres")


@query("route_milestones", with_sql("legs") + """, l AS (SELECT route, seq, 40+(seq*7+route)%11*0.001::DOUBLE AS lat, -80+(seq*5+route)%13*0.001::DOUBLE AS lon, metres FROM legs), a AS (SELECT *, lag(lat) OVER w AS a1, lag(lon) OVER w AS o1, lag(seq) OVER w IS NULL AS head, lead(seq) OVER w IS NULL AS tail, sum(metres) OVER w AS total FROM l WINDOW w AS (PARTITION BY route ORDER BY seq)),
 b AS (SELECT *, degrees(atan2(sin(radians(lon-o1))*cos(radians(lat)), cos(radians(a1))*sin(radians(lat))-sin(radians(a1))*cos(radians(lat))*cos(radians(lon-o1)))) AS b0, 2*6371000*asin(least(1,sqrt(sin(radians(lat-a1)/2)**2+cos(radians(a1))*cos(radians(lat))*sin(radians(lon-o1)/2)**2))) AS air FROM a),
 c AS (SELECT *, CASE WHEN b0<0 THEN b0+360 ELSE b0 END AS bearing, coalesce(air>=40 AND metres<=1.08*air,false) AS straight FROM b), d AS (SELECT *, lead(bearing) OVER (PARTITION BY route ORDER BY seq)-bearing AS df FROM c),
 e AS (SELECT *, CASE WHEN df IS NULL THEN 0 ELSE df+180-360*floor((df+180)/360)-180 END AS turn FROM d), f AS (SELECT *, CASE WHEN turn>0 THEN 'right' ELSE 'left' END AS side, abs(turn) AS size FROM e)
 SELECT route, seq, round(total,6) AS total, round(bearing,6) AS bearing, straight, round(turn,6) AS turn, CASE WHEN head THEN 'start' WHEN tail THEN 'arrive' WHEN size<30 THEN 'straight' WHEN size>=150 THEN 'sharp '||side||' (U-turn)' WHEN size>=100 THEN 'sharp '||side WHEN size>=55 THEN side ELSE 'slight '||side END AS label FROM f""")  # fmt: skip
def route_milestones(spark: SparkSession, d: str) -> DataFrame:
    legs = wo.legs(spark, d).select("route", "seq", (40 + (F.col("seq") * 7 + F.col("route")) % 11 * 0.001).alias("lat"), (-80 + (F.col("seq") * 5 + F.col("route")) % 13 * 0.001).alias("lon"), "metres")
    return r6(gr.milestones(legs).select("route", "seq", "total", "bearing", "straight", "turn", "label"))


@query("collapsed_legs", with_sql("legs") + """, l AS (SELECT *, coalesce(sum(CASE WHEN seq%3=0 THEN 1 ELSE 0 END) OVER (PARTITION BY route ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),0) AS leg FROM legs) SELECT route, CAST(leg AS BIGINT) AS leg, round(sum(metres),4) AS metres, count(*) AS nodes FROM l GROUP BY 1,2""")
def collapsed_legs(spark: SparkSession, d: str) -> DataFrame:
    out = gr.collapse(wo.legs(spark, d).withColumn("decision", F.col("seq") % 3 == 0))
    return out.select("route", "leg", F.round("metres", 4).alias("metres"), "nodes")


def _results(spark, d):
    li = wo.read(spark, d, "lineitem").select(F.col("l_returnflag").alias("shape"), F.when(F.col("l_quantity") < 48, F.col("l_extendedprice") % 400).alias("error"), (F.col("l_discount") * 10).alias("conc"), F.col("l_quantity").alias("turns"), F.col("l_linenumber").alias("questions"), F.col("l_tax").alias("curvature"), (F.col("l_quantity") % 7).alias("gain"))
    return li


_RES = "r AS (SELECT l_returnflag AS shape, CASE WHEN l_quantity<48 THEN l_extendedprice%400 END AS error, l_discount*10 AS conc, l_quantity AS turns, l_linenumber AS questions, l_tax AS curvature, l_quantity%7 AS gain FROM lineitem)"


@query("road_summary", "WITH " + _RES + ", s AS (SELECT *, coalesce(error<120,false) AND coalesce(conc>=0.8,false) AS ok FROM r) SELECT count(*) AS total, CAST(sum(ok::INT) AS BIGINT) AS located, round(avg(ok::INT),4) AS rate, round(avg(turns) FILTER (WHERE ok),2) AS turns, round(avg(questions) FILTER (WHERE ok),2) AS questions, round(avg(error) FILTER (WHERE ok),2) AS error FROM s")
def road_summary(spark: SparkSession, d: str) -> DataFrame:
    return rp.road_summary(_results(spark, d).withColumn("success", rp.road_success(F.lit(True), F.col("error"), F.col("conc"))))


@query("shape_leaderboard", "WITH " + _RES + """, g AS (SELECT shape, CAST(sum(coalesce(error<120,false)::INT) AS BIGINT) AS located, count(*) AS total, round(avg(coalesce(error<120,false)::INT),3) AS rate, round(median(error),1) AS median_error, round(avg(curvature),1) AS curvature FROM r GROUP BY 1)
 SELECT *, CAST(row_number() OVER (ORDER BY rate DESC, coalesce(nullif(median_error,0),9e9), shape) AS INT) AS place FROM g""")
def shape_leaderboard(spark: SparkSession, d: str) -> DataFrame:
    return rp.leaderboard(_results(spark, d).withColumn("success", rp.offtrail_success(F.col("error"))))


@query("feature_compare", "WITH " + _RES + f""", u AS (UNPIVOT (SELECT coalesce(error<120,false) AS ok, (turns/10)::DOUBLE AS early_gain_frac, (questions/7.0)::DOUBLE AS mid_gain_frac, (conc/5)::DOUBLE AS late_gain_frac, (gain*3)::DOUBLE AS elev_roughness_m_per_km, curvature::DOUBLE AS curvature_per_km, gain::DOUBLE AS elev_gain_m, turns::DOUBLE AS elev_range_m FROM r)
 ON {', '.join(rp.COMPARED)} INTO NAME feature VALUE value)
 SELECT feature, round(avg(value) FILTER (WHERE ok),2) AS located, round(avg(value) FILTER (WHERE NOT ok),2) AS "not" FROM u GROUP BY 1""")
def feature_compare(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).withColumn("success", rp.offtrail_success(F.col("error")))
    seven = [F.col("turns") / 10, F.col("questions") / 7.0, F.col("conc") / 5, F.col("gain") * 3, F.col("curvature"), F.col("gain"), F.col("turns")]
    return rp.feature_compare(r.select("success", *[c.cast("double").alias(n) for c, n in zip(seven, rp.COMPARED)]), rp.COMPARED)


@query("climb_metrics", with_sql("tele") + """, w AS (SELECT device_id, row_number() OVER (PARTITION BY device_id ORDER BY t,event_id) AS i, mag/100 AS elev FROM tele), x AS (SELECT *, elev-lag(elev) OVER q AS dd, i-2 AS k, count(*) OVER (PARTITION BY device_id)-1 AS n FROM w WINDOW q AS (PARTITION BY device_id ORDER BY i)),
 y AS (SELECT *, greatest(1, greatest(1,n)//3) AS th, CASE WHEN dd>0 THEN dd ELSE 0 END AS up FROM x)
 SELECT device_id AS walk, round(sum(up),6) AS gain, round(max(elev)-min(elev),6) AS range, round(arg_max(elev,i)-arg_min(elev,i),6) AS net, round(sum(abs(dd)),6) AS change, round(abs(arg_max(elev,i)-arg_min(elev,i))/sum(abs(dd)),6) AS monotony,
 round(coalesce(sum(up) FILTER (WHERE k BETWEEN 0 AND th-1),0)/sum(up),6) AS early, round(coalesce(sum(up) FILTER (WHERE k>=th AND k<2*th),0)/sum(up),6) AS mid, round(coalesce(sum(up) FILTER (WHERE k>=2*th),0)/sum(up),6) AS late FROM y GROUP BY 1""")  # fmt: skip
def climb_metrics(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("device_id").orderBy("t", "event_id")
    return r6(rp.terrain_metrics(wo.telemetry(spark, d).select(F.col("device_id").alias("walk"), F.row_number().over(w).alias("i"), (F.col("mag") / 100).alias("elev"))))


@query("walk_coverage", with_sql("tele") + """, w AS (SELECT device_id AS walk, row_number() OVER (PARTITION BY device_id ORDER BY t,event_id) AS i, k%20 AS node, (k%20)%5*100.0::DOUBLE AS x, (k%20)//5*100.0::DOUBLE AS y FROM tele),
 a AS (SELECT *, lag(node) OVER q AS pn, x-lag(x) OVER q AS dx, y-lag(y) OVER q AS dy FROM w WINDOW q AS (PARTITION BY walk ORDER BY i)), b AS (SELECT *, CASE WHEN pn IS NOT NULL THEN degrees(atan2(dx,dy)) END AS br, CASE WHEN pn IS NOT NULL THEN least(node,pn)*1000+greatest(node,pn) END AS ed FROM a),
 c AS (SELECT *, br-lag(br) OVER (PARTITION BY walk ORDER BY i) AS tb FROM b), f AS (SELECT *, abs((tb+180)-360*floor((tb+180)/360)-180) AS ta FROM c)
 SELECT walk, round(1-count(DISTINCT ed)/count(ed)::DOUBLE,6) AS edge_revisit, round(1-count(DISTINCT node)/count(*)::DOUBLE,6) AS node_revisit, round(sqrt((arg_max(x,i)-arg_min(x,i))**2+(arg_max(y,i)-arg_min(y,i))**2)/sum(sqrt(dx*dx+dy*dy)),6) AS straightness,
 (max(x)-min(x))*(max(y)-min(y)) AS box, CAST(sum(CASE WHEN ta>=30 THEN 1 ELSE 0 END) AS BIGINT) AS turns FROM f GROUP BY 1""")  # fmt: skip
def walk_coverage(spark: SparkSession, d: str) -> DataFrame:
    w, node = Window.partitionBy("device_id").orderBy("t", "event_id"), F.col("k") % 20
    walk = wo.telemetry(spark, d).select(F.col("device_id").alias("walk"), F.row_number().over(w).alias("i"), node.alias("node"), (node % 5 * 100.0).alias("x"), (F.floor(node / 5) * 100.0).alias("y"))
    return r6(rp.coverage(walk))


@query("payload_samples", with_sql("tele") + """, p AS (SELECT event_id AS pid, k, mag FROM tele WHERE k%4<3)
 SELECT pid, CASE WHEN k%4=0 THEN 'accel' WHEN k%4=1 THEN 'gyro' ELSE 'mag' END AS kind, CAST(0 AS INT) AS i, k::DOUBLE AS x, 0.5::DOUBLE AS y, -k::DOUBLE AS z FROM p UNION ALL SELECT pid, 'gyro', 1, 1.0, 2.0, 3.0 FROM p WHERE k%4=1""")
def payload_samples(spark: SparkSession, d: str) -> DataFrame:
    return pl.samples(_bodies(spark, d))


def _bodies(spark, d):
    k = F.col("k").cast("string")
    flat = F.concat(F.lit('{"accel_x": '), k, F.lit(', "accel_y": "0.5", "accel_z": -'), k, F.lit("}"))
    listed = F.concat(F.lit('{"messages": [], "payload": [{"name": "Gyroscope", "values": {"x": '), k, F.lit(', "y": 0.5, "z": -'), k, F.lit('}}, {"name": "gravity", "values": {"x": 9, "y": 9, "z": 9}}, {"name": "gyroscopeUncalibrated", "gx": 1, "gy": 2, "gz": 3}]}'))
    mag = F.concat(F.lit('{"mx": '), k, F.lit(', "my": 0.5, "mz": -'), k, F.lit("}"))
    body = F.when(F.col("k") % 4 == 0, flat).when(F.col("k") % 4 == 1, listed).when(F.col("k") % 4 == 2, mag).otherwise("not json")
    return wo.dealt(wo.telemetry(spark, d).select("event_id", "k"), "event_id", 100_000).select(F.col("event_id").alias("pid"), body.alias("body"))


@query("payload_rejects", with_sql("tele") + " SELECT event_id AS pid, 'not json' AS body FROM tele WHERE k%4=3")
def payload_rejects(spark: SparkSession, d: str) -> DataFrame:
    return pl.rejects(_bodies(spark, d))
