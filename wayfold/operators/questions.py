"""Questions that tell hypotheses apart: a boolean for each hypothesis (cid, x, y, w) and question."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hypotheses import even_question
from .spatial import feature_distance, line_distance, nearest_feature
from .terrain import horizon, relative_profile, sample, slope_aspect, straight_line

# Question -> kinds of features, and how near one must be (metres); the steepness that tells (degrees).
NEAR = {"water": (("water", "stream"), 25.0), "wood": (("wood",), 20.0), "meadow": (("meadow",), 25.0)}
NATURE = {"wetland": (("wetland",), 25.0), "park": (("park",), 30.0)}
LANDMARKS = {"junction": (("intersection",), 25.0), "stop": (("stop_sign",), 25.0), "light": (("traffic_light",), 25.0), "dead_end": (("dead_end",), 35.0)}
SIDE_M, STEEP_DEG = 30.0, 12.0
COMPASS = [45.0 * k for k in range(8)]
# Kind of named thing -> how many are asked about, how near the lead they must be, and how near one must be for yes.
NAMED = {"road": (3, 90.0, 25.0), "poi": (3, 130.0, 45.0), "trail": (2, 120.0, 30.0), "peak": (2, 800.0, 250.0)}


def _all(cloud: DataFrame, name: str, yes: DataFrame) -> DataFrame:
    """(q, cid, yes, w): of every hypothesis whether it is among ``yes(cid)``."""
    hit = yes.select("cid").distinct().withColumn("_hit", F.lit(True))
    return cloud.join(hit, "cid", "left").select(F.lit(name).alias("q"), "cid", F.coalesce("_hit", F.lit(False)).alias("yes"), "w")


def _near(cloud: DataFrame, features: DataFrame, kinds: tuple[str, ...], reach: float) -> DataFrame:
    """Whether there is one is asked once of each place and each line, however many share them: no pair of hypothesis and feature is listed."""
    shape = features.where(F.col("kind").isin(*kinds)).groupBy("line").agg(F.min("fid").alias("shape"))
    hit = line_distance(cloud.select("x", "y").distinct(), shape, reach).select("x", "y").distinct()
    return cloud.select("cid", "x", "y").join(hit, ["x", "y"], "left_semi").select("cid")


def bank(cloud: DataFrame, features: DataFrame, nature: bool, heading: float | None = None, steep: DataFrame | None = None) -> DataFrame:
    """(q, cid, yes, w) of every question there is data for; ``features(fid, kind, line)``, ``steep(cid, slope)``.

    Landmarks are asked about on roads, wetlands and parks off them; a stream to the left or right needs a heading.
    """
    asked = NEAR | (NATURE if nature else LANDMARKS)
    out = None
    for name, (kinds, reach) in asked.items():
        one = _all(cloud, name, _near(cloud, features, kinds, reach))
        out = one if out is None else out.unionByName(one)
    if heading is not None:
        streams = features.where("kind = 'stream'").select("fid", F.explode("line").alias("p")).select("fid", "p.x", "p.y")
        side = nearest_feature(cloud.select(F.col("cid").alias("pid"), "x", "y"), streams, SIDE_M)
        from .spatial import on_side

        for name in ("right", "left"):
            hit = side.where(on_side(F.col("bearing"), F.lit(heading), name)).select(F.col("pid").alias("cid"))
            out = out.unionByName(_all(cloud, f"stream_{name}", hit))
    if steep is not None:
        out = out.unionByName(_all(cloud, "steep", steep.where(F.col("slope") >= STEEP_DEG)))
    return out


def steepness(cloud: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float) -> DataFrame:
    """(cid, slope) of every hypothesis."""
    return slope_aspect(cloud.select("cid", "x", "y"), dem, cols, rows, cell, cell).select("cid", "slope")


def named(cloud: DataFrame, things: DataFrame, kind: str, lead_x: Column, lead_y: Column) -> DataFrame:
    """(q, cid, yes, w) about the named ``things(fid, name, line)`` nearest to the lead; of one name all lines count.

    One is yes for hypotheses near any of its lines.
    """
    most, reach, yes_m = NAMED[kind]
    lead = cloud.sparkSession.range(1).select(F.lit(0).cast("long").alias("pid"), lead_x.cast("double").alias("x"), lead_y.cast("double").alias("y"))
    kept = things.where("name IS NOT NULL AND name <> ''")
    near = feature_distance(lead, kept, reach).where(F.col("dist") < reach).join(kept.select("fid", "name"), "fid")
    chosen = near.groupBy("name").agg(F.min("dist").alias("dist")).orderBy("dist", "name").limit(most)
    lines = kept.join(chosen.select("name"), "name", "left_semi")
    # Asked once of each place and each line of a name, however many share them.
    shape = lines.select("line", "name", F.min("fid").over(Window.partitionBy("line")).alias("shape")).distinct()
    near_by = line_distance(cloud.select("x", "y").distinct(), shape.select("shape", "line").distinct(), yes_m).join(shape.select("shape", "name"), "shape")
    yes = near_by.select("name", "x", "y").distinct().withColumn("_hit", F.lit(True))
    grid = cloud.select("cid", "x", "y", "w").crossJoin(F.broadcast(chosen.select("name")))
    return grid.join(yes, ["name", "x", "y"], "left").select(F.col("name").alias("q"), "cid", F.coalesce("_hit", F.lit(False)).alias("yes"), "w")


def horizons(cloud: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float, reach: float = 4000.0, step: float = 60.0) -> DataFrame:
    """(q, cid, yes, w): whether a ridge hides what lies behind, from every hypothesis towards each of eight bearings."""
    compass = F.explode(F.array(*[F.lit(h) for h in COMPASS]))
    # Each place looks about once, however many hypotheses stand there.
    turned = cloud.select("x", "y").distinct().withColumn("q", compass)
    line = sample(straight_line(turned, F.col("q"), reach, step), dem, cols, rows, cell, "px", "py")
    found = horizon(relative_profile(line, ["q", "x", "y"]), ["q", "x", "y"], step)
    asked = cloud.select("cid", "x", "y", "w").withColumn("q", compass)
    return asked.join(found, ["q", "x", "y"], "left").select("q", "cid", F.coalesce("blocked", F.lit(False)).alias("yes"), "w")


def horizon_question(cloud: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float, reach: float = 4000.0, step: float = 60.0) -> DataFrame:
    """(q, score) of the bearing that splits the hypotheses most evenly; no row if none splits them."""
    return even_question(horizons(cloud, dem, cols, rows, cell, reach, step))
