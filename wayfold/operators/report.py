"""Walk metrics and benchmark summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def road_success(located: Column, error: Column, concentration: Column) -> Column:
    return located & F.coalesce(error < 120, F.lit(False)) & F.coalesce(concentration >= 0.8, F.lit(False))


def offtrail_success(error: Column) -> Column:
    return F.coalesce(error < 120, F.lit(False))


def road_summary(df: DataFrame) -> DataFrame:
    """One row: share of successes and means over them, nulls left out."""
    won = F.col("success")
    mean = lambda c: F.round(F.avg(F.when(won, F.col(c))), 2)
    return df.agg(F.count("*").alias("total"), F.sum(won.cast("int")).alias("located"), F.round(F.coalesce(F.avg(won.cast("int")), F.lit(0.0)), 4).alias("rate"), mean("turns").alias("turns"), mean("questions").alias("questions"), mean("error").alias("error"))


def leaderboard(df: DataFrame) -> DataFrame:
    """By shape: located, total, rate, median error; ranked by rate, then median, none or exactly 0 last."""
    out = df.groupBy("shape").agg(F.sum(F.col("success").cast("int")).alias("located"), F.count("*").alias("total"), F.round(F.avg(F.col("success").cast("int")), 3).alias("rate"), F.round(F.median("error"), 1).alias("median_error"), F.round(F.avg("curvature"), 1).alias("curvature"))
    rank = F.row_number().over(Window.orderBy(F.desc("rate"), F.coalesce(F.nullif("median_error", F.lit(0.0)), F.lit(9e9)), "shape"))
    return out.withColumn("place", rank)


def feature_compare(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, located, not): means of each feature over successes and failures."""
    long = df.unpivot(["success"], features, "feature", "value")
    return long.groupBy("feature").agg(F.round(F.avg(F.when(F.col("success"), F.col("value"))), 2).alias("located"), F.round(F.avg(F.when(~F.col("success"), F.col("value"))), 2).alias("not"))


def coverage(walk: DataFrame) -> DataFrame:
    """Of walks (walk, i, node, x, y): shares of edges and nodes trodden again, straightness, box area, turns of 30 degrees or more."""
    from ..functions.geo import angle_difference, planar_bearing

    w = Window.partitionBy("walk").orderBy("i")
    df = walk.withColumns({"_n": F.lag("node").over(w), "_dx": F.col("x") - F.lag("x").over(w), "_dy": F.col("y") - F.lag("y").over(w)})
    df = df.withColumns({"_edge": F.when(F.col("_n").isNotNull(), F.struct(F.least("node", "_n").alias("p"), F.greatest("node", "_n").alias("q"))), "_b": F.when(F.col("_n").isNotNull(), planar_bearing("_dx", "_dy")), "_s": F.hypot("_dx", "_dy")})
    df = df.withColumn("_t", F.abs(angle_difference(F.col("_b"), F.lag("_b").over(w))))
    out = df.groupBy("walk").agg(
        F.count("_edge").alias("edges"), F.countDistinct("_edge").alias("_de"), F.count("*").alias("_nodes"), F.countDistinct("node").alias("_dn"), F.sum("_s").alias("metres"),
        F.min_by(F.struct("x", "y"), "i").alias("_a"), F.max_by(F.struct("x", "y"), "i").alias("_z"), ((F.max("x") - F.min("x")) * (F.max("y") - F.min("y"))).alias("box"), F.sum(F.when(F.col("_t") >= 30, 1).otherwise(0)).alias("turns"),
    )
    net = F.hypot(F.col("_z.x") - F.col("_a.x"), F.col("_z.y") - F.col("_a.y"))
    again = lambda d, n: F.when(F.col(n) > 0, 1 - F.col(d) / F.col(n)).otherwise(0.0)
    return out.select("walk", again("_de", "edges").alias("edge_revisit"), again("_dn", "_nodes").alias("node_revisit"), F.when(F.col("metres") > 0, net / F.col("metres")).otherwise(0.0).alias("straightness"), "box", "turns")


def terrain_metrics(walk: DataFrame) -> DataFrame:
    """Of walks (walk, i, elev): gain, range, net, up and down, monotony, and where the climbing is by thirds."""
    w = Window.partitionBy("walk").orderBy("i")
    df = walk.withColumn("_d", F.col("elev") - F.lag("elev").over(w)).withColumns({"_k": F.row_number().over(w) - 2, "_n": F.count("*").over(Window.partitionBy("walk")) - 1})
    third = F.greatest(F.lit(1), F.floor(F.greatest(F.lit(1), F.col("_n")) / 3))
    up = F.greatest("_d", F.lit(0.0))
    part = lambda c: F.coalesce(F.sum(F.when(c, up)), F.lit(0.0))
    out = df.groupBy("walk").agg(
        F.coalesce(F.sum(F.when(F.col("_d").isNotNull(), up)), F.lit(0.0)).alias("gain"), (F.max("elev") - F.min("elev")).alias("range"), (F.max_by("elev", "i") - F.min_by("elev", "i")).alias("net"), F.coalesce(F.sum(F.abs("_d")), F.lit(0.0)).alias("change"),
        part(F.col("_k").between(0, third - 1)).alias("_e"), part((F.col("_k") >= third) & (F.col("_k") < 2 * third)).alias("_m"), part(F.col("_k") >= 2 * third).alias("_l"),
    )
    base = F.when(F.col("gain") > 0, F.col("gain")).otherwise(1.0)
    return out.select("walk", "gain", "range", "net", "change", F.when(F.col("change") > 0, F.abs("net") / F.col("change")).otherwise(0.0).alias("monotony"), (F.col("_e") / base).alias("early"), (F.col("_m") / base).alias("mid"), (F.col("_l") / base).alias("late"))


# What successes and failures are compared by.
COMPARED = ["early_gain_frac", "mid_gain_frac", "late_gain_frac", "elev_roughness_m_per_km", "curvature_per_km", "elev_gain_m", "elev_range_m"]


def compact_rows(walks: DataFrame, elevations: DataFrame) -> DataFrame:
    """A benchmark row for each of ``walks(walk, located, error, conc, lat, lon, end_lat, end_lon, asked, turns, heading_sd, turned, steps, metres, pre_error, pre_conc, least_asked)`` with the noisy ``elevations(walk, i, elev)``."""
    from ..functions.geo import rounded as r

    m = terrain_metrics(elevations).select("walk", "gain", "range")
    return walks.join(m, "walk").select(
        "walk", "located", r("error", 1).alias("locatedErrorM"), r("conc", 4).alias("locatedConc"), r("lat", 6).alias("locatedLat"), r("lon", 6).alias("locatedLon"), r("end_lat", 6).alias("trueEndLat"), r("end_lon", 6).alias("trueEndLon"),
        F.col("asked").alias("qAnsweredCount"), F.col("turns").alias("significantTurns"), r("heading_sd", 2).alias("headingStdDev"), r("turned", 1).alias("totalHeadingChangeDeg"), r("gain", 1).alias("elevGainM"), r("range", 1).alias("elevRangeM"),
        F.col("steps").alias("walkSteps"), r("metres", 0).cast("long").alias("walkDistanceM"), r("pre_error", 1).alias("preQuestionErrorM"), r("pre_conc", 4).alias("preQuestionConc"), F.col("least_asked").alias("minQuestionsUsed"),
    )


def single_walk(route: DataFrame, hypotheses: DataFrame, answers: DataFrame, questions: DataFrame, bins: DataFrame, most: int = 600) -> DataFrame:
    """(walk, body): a walk's whole result as JSON - its route (walk, i, lat, lon), a sample of ``hypotheses(walk, cid, lat, lon, w)``, the questions (walk, q, text, named) and every hypothesis's ``answers(walk, cid, q, yes)``, and its bins (walk, i, heading, elev, noisy).

    Of more than ``most`` hypotheses every k-th in order of cid is taken.
    """
    ordered = lambda df, by, *cols: df.groupBy("walk").agg(F.transform(F.array_sort(F.collect_list(F.struct(by, *cols))), lambda s: F.struct(*[s[c].alias(c) for c in cols])).alias("v"))
    n = hypotheses.groupBy("walk").agg(F.ceil(F.count("*") / most).alias("_k"))
    place = F.row_number().over(Window.partitionBy("walk").orderBy("cid")) - 1
    taken = hypotheses.withColumn("_r", place).join(n, "walk").where("_r % _k = 0").drop("_r", "_k")
    said = answers.join(taken.select("walk", "cid"), ["walk", "cid"]).groupBy("walk", "cid").agg(F.transform(F.array_sort(F.collect_list(F.struct("q", "yes"))), lambda s: s["yes"]).alias("row"))
    parts = {
        "route": ordered(route, "i", "lat", "lon"), "hypotheses": ordered(taken, "cid", "lat", "lon", "w"), "questions": ordered(questions, "q", "text", "named"),
        "questionAnswers": ordered(said, "cid", "row"), "profile": ordered(bins, "i", "heading", "elev", "noisy"),
    }
    out = route.select("walk").distinct()
    for name, part in parts.items():
        out = out.join(part.withColumnRenamed("v", name), "walk", "left")
    flat = lambda c, f: F.transform(c, lambda s: s[f])
    body = F.struct(
        F.size("profile").alias("walkSteps"), F.transform("route", lambda s: F.array(s["lat"], s["lon"])).alias("route"), F.transform("hypotheses", lambda s: F.array(s["lat"], s["lon"], s["w"])).alias("hypotheses"), "questions",
        flat("questionAnswers", "row").alias("questionAnswers"), flat("profile", "elev").alias("elevProfile"), flat("profile", "noisy").alias("noisyElev"), flat("profile", "heading").alias("headings"),
    )
    return out.select("walk", F.to_json(body).alias("body"))


def write_results(walks: DataFrame, path: str, drop: tuple[str, ...] = ("coords",)) -> None:
    """Results as lines of JSON, without the coordinates."""
    walks.drop(*drop).write.mode("overwrite").json(path)


def transcript(log: DataFrame) -> DataFrame:
    """(walk, i, line) of the questions of ``log(walk, i, question, answer, share)``, as one would read them."""
    said = F.when(F.col("answer"), "yes").otherwise("no")
    return log.select("walk", "i", F.concat(F.format_string("%d. ", F.col("i") + 1), F.col("question"), F.lit(" - "), said, F.format_string(" (%.0f%% of the weight at the lead)", F.col("share") * 100)).alias("line"))
