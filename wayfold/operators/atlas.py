"""Map patches: catalogue, merging, tiling and masks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Vector-tile layers and classes to feature kinds; named-only layers.
KINDS = {("water", None): "water", ("waterway", None): "stream", ("landcover", "wood"): "wood", ("landcover", "grass"): "meadow", ("landcover", "wetland"): "wetland", ("park", None): "park", ("mountain_peak", None): "peak", ("poi", None): "poi"}


def feature_kind(layer: Column, kind: Column, name: Column) -> Column:
    """Kind of a map feature; null for layers that are not kept and for points of interest without a name."""
    out = F.lit(None).cast("string")
    for (where, what), found in reversed(KINDS.items()):
        hit = layer == where
        out = F.when(hit if what is None else hit & (kind == what), F.lit(found)).otherwise(out)
    return F.when((out == "poi") & F.coalesce(F.length(name) == 0, F.lit(True)), None).otherwise(out)


def catalogue(spark: SparkSession, path: str) -> DataFrame:
    """Every area's description; files that can't be read are left out."""
    schema = "slug string, name string, lat double, lon double, radius_m double, created string, _bad string"
    found = spark.read.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("multiLine", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "meta.json").json(path)
    return found.where("_bad IS NULL AND slug IS NOT NULL").drop("_bad")


def merge_nodes(nodes: DataFrame) -> DataFrame:
    """Nodes (patch, id, lat, lon) of several patches, each id once: of the first patch that has it."""
    return nodes.groupBy("id").agg(F.min_by(F.struct("lat", "lon"), "patch").alias("v")).select("id", "v.*")


def merge_features(features: DataFrame, origins: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """Features (patch, fid, kind, name, line) of several patches about one origin; ``origins(patch, lat, lon)`` are the patches' own.

    Lines are arrays of (x, y) in metres.  A feature that patches share is told by kind, name and rounded first place, and
    is taken from the first patch.
    """
    from ..functions.geo import to_degrees, to_metres

    here = features.join(origins.select("patch", F.col("lat").alias("_lat"), F.col("lon").alias("_lon")), "patch")

    def moved(p: Column) -> Column:
        lat, lon = to_degrees(p["x"], p["y"], F.col("_lat"), F.col("_lon"))
        x, y = to_metres(lat, lon, lat0, lon0)
        return F.struct(x.alias("x"), y.alias("y"))

    line = here.withColumn("line", F.transform("line", moved)).drop("_lat", "_lon")
    first = F.get("line", 0)
    key = [F.col("kind"), F.coalesce("name", F.lit("")).alias("_name"), F.round(first["x"]).alias("_x"), F.round(first["y"]).alias("_y")]
    return line.groupBy(*key).agg(F.min_by(F.struct("patch", "fid", "name", "line"), F.struct("patch", "fid")).alias("v")).select("v.patch", "v.fid", "kind", "v.name", "v.line")


def write_patches(df: DataFrame, path: str) -> None:
    """Rows of patches, a folder for each; writing a patch again replaces it alone."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("patch").parquet(path)


def patch_index(spark: SparkSession, path: str) -> DataFrame:
    """(patch, rows) of the patches that are stored."""
    return spark.read.parquet(path).groupBy("patch").agg(F.count("*").alias("rows"))


def migrated(spark: SparkSession, path: str, patch: str) -> DataFrame:
    """A legacy area's rows as a patch."""
    return spark.read.parquet(path).withColumn("patch", F.lit(patch))


def first_patch(points: DataFrame, patches: DataFrame) -> DataFrame:
    """(pid, patch): the first patch (patch, s, n, w, e) that covers each point; patches meet points on whole degrees.

    Of patches of one box the first counts, and points of one place share theirs, so copies of either meet nothing more.
    """
    boxes = patches.groupBy("s", "n", "w", "e").agg(F.min("patch").alias("patch"))
    places = points.select("lat", "lon").distinct()
    span = lambda a, b: F.sequence(F.floor(F.col(a)), F.floor(F.col(b)))
    cells = boxes.withColumn("cy", F.explode(span("s", "n"))).withColumn("cx", F.explode(span("w", "e")))
    p = places.withColumns({"cy": F.floor("lat"), "cx": F.floor("lon")})
    hit = p.join(cells, ["cx", "cy"]).where(F.col("lat").between(F.col("s"), F.col("n")) & F.col("lon").between(F.col("w"), F.col("e")))
    first = hit.groupBy("lat", "lon").agg(F.min("patch").alias("patch"))
    return points.select("pid", "lat", "lon").join(first, ["lat", "lon"]).groupBy("pid").agg(F.min("patch").alias("patch"))


def missing_tiles(spark: SparkSession, patches: DataFrame, south: float, west: float, north: float, east: float, cell: float = 0.30) -> DataFrame:
    """(ix, iy, lat, lon) of the region's cells whose middle no patch covers."""
    nx, ny = max(1, round((east - west) / cell)), max(1, round((north - south) / cell))
    grid = spark.range(nx * ny).select((F.col("id") % nx).alias("ix"), F.floor(F.col("id") / nx).alias("iy"))
    grid = grid.withColumns({"lat": south + (F.col("iy") + 0.5) * cell, "lon": west + (F.col("ix") + 0.5) * cell, "pid": F.col("ix") * 1_000_000 + F.col("iy")})
    return grid.join(first_patch(grid.select("pid", "lat", "lon"), patches), "pid", "left_anti").drop("pid")


def plan_boxes(boxes: list[tuple[float, float, float, float]], cap: float = 0.35, bridge: float = 0.15) -> list[tuple[float, float, float, float]]:
    """Download boxes (s, w, n, e): made square within ``cap`` degrees, and those with gaps up to ``bridge`` joined."""
    square = []
    for s, w, n, e in boxes:
        half = min(cap, max(n - s, e - w)) / 2
        square.append(((s + n) / 2 - half, (w + e) / 2 - half, (s + n) / 2 + half, (w + e) / 2 + half))
    out: list[tuple[float, float, float, float]] = []
    for b in sorted(square):
        for i, o in enumerate(out):
            j = (min(b[0], o[0]), min(b[1], o[1]), max(b[2], o[2]), max(b[3], o[3]))
            apart = max(b[0] - o[2], o[0] - b[2], b[1] - o[3], o[1] - b[3])
            if apart <= bridge and max(j[2] - j[0], j[3] - j[1]) <= 2 * cap:
                out[i] = j
                break
        else:
            out.append(b)
    return out


def failed_honestly(walked: Column, concentration: Column, areas: Column) -> Column:
    """Whether a long walk has narrowed nothing."""
    return (walked > 350) & (concentration < 0.15) & (areas > 20)


def downhill_answer(slope: Column, downhill: Column, heading: Column) -> Column:
    """Whether a place agrees that downhill lies along a heading; flat ground abstains (true), off the map is false."""
    from ..functions.geo import bearing_gap

    return F.when(slope.isNull(), False).when(slope < 4, True).otherwise(bearing_gap(downhill, heading) <= 50)


def slope_confirms(expected: Column, observed: Column, leg_s: Column, in_range: Column) -> Column:
    """Whether the climb since the last node says that the next is reached."""
    return (F.abs(expected) >= 3) & (F.abs(observed - expected) <= F.greatest(F.lit(2.5), 0.45 * F.abs(expected))) & (leg_s >= 3) & in_range
