"""Elevation rasters and profiles.  A sample is one equi-join with the cells' four heights; a raster is broadcast only if its size is small."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EYE_M, BLOCKED_DEG = 1.7, 2.5
#: Rasters of up to so many cells (of some 40 bytes) are broadcast.
BROADCAST_CELLS = 250_000


def quads(dem: DataFrame, cols: int, rows: int) -> DataFrame:
    """(_x, _y, _a, _b, _c, _d): each cell's own height and those east, north and north-east of it; the far edge repeats its neighbours."""
    corner = F.explode(F.array(*[F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx in (0, 1) for dy in (0, 1)])).alias("o")
    own = dem.select("gx", "gy", "h", corner).select((F.col("gx") - F.col("o.dx")).alias("_x"), (F.col("gy") - F.col("o.dy")).alias("_y"), "o.dx", "o.dy", "h")
    pick = lambda dx, dy: F.max(F.when((F.col("dx") == dx) & (F.col("dy") == dy), F.col("h")))
    cell = own.where("_x >= 0 AND _y >= 0").groupBy("_x", "_y").agg(pick(0, 0).alias("_a"), pick(1, 0).alias("_b"), pick(0, 1).alias("_c"), pick(1, 1).alias("_d"))
    east, north = F.col("_x") == cols - 1, F.col("_y") == rows - 1
    last = F.when(east & north, F.col("_a")).when(east, F.col("_c")).when(north, F.col("_b")).otherwise(F.col("_d"))
    return cell.select("_x", "_y", "_a", F.when(east, F.col("_a")).otherwise(F.col("_b")).alias("_b"), F.when(north, F.col("_a")).otherwise(F.col("_c")).alias("_c"), last.alias("_d"))


def sample(df: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float, x: str = "x", y: str = "y", out: str = "h") -> DataFrame:
    """``out``: bilinear height at (x, y), null outside the grid; one equi-join with the cells' four heights."""
    fx, fy = F.col(x) / cell, F.col(y) / cell
    inside = (fx >= 0) & (fy >= 0) & (fx <= cols - 1) & (fy <= rows - 1)
    df = df.withColumns({"_x": F.when(inside, F.floor(fx).cast("int")), "_y": F.when(inside, F.floor(fy).cast("int")), "_tx": fx - F.floor(fx), "_ty": fy - F.floor(fy)})
    known = quads(dem, cols, rows)
    # A row for each cell: broadcast only up to a known number of cells.
    df = df.join(F.broadcast(known) if cols * rows <= BROADCAST_CELLS else known, ["_x", "_y"], "left")
    low = F.col("_a") + (F.col("_b") - F.col("_a")) * F.col("_tx")
    high = F.col("_c") + (F.col("_d") - F.col("_c")) * F.col("_tx")
    return df.withColumn(out, low + (high - low) * F.col("_ty")).drop("_x", "_y", "_tx", "_ty", "_a", "_b", "_c", "_d")


def mercator_sample(df: DataFrame, dem: DataFrame, cols: int, rows: int, zoom: int, px0: float, py0: float, lat: str = "lat", lon: str = "lon", out: str = "h") -> DataFrame:
    """``out``: bilinear height at a place in degrees, on a raster whose first pixel is (px0, py0) of the world's pixels at ``zoom``."""
    from ..functions.geo import mercator_pixel

    px, py = mercator_pixel(F.col(lat), F.col(lon), zoom)
    df = df.withColumns({"_px": px - px0, "_py": py - py0})
    return sample(df, dem, cols, rows, 1.0, "_px", "_py", out).drop("_px", "_py")


def mosaic_zoom(south: float, west: float, north: float, east: float, most_tiles: int = 90, least: int = 8, most: int = 13) -> int:
    """The greatest zoom from ``most`` down at which a box takes at most ``most_tiles`` tiles; ``least`` if none does."""

    def tile(lat: float, lon: float, z: int) -> tuple[int, int]:
        r = math.radians(lat)
        return math.floor((lon + 180) / 360 * 2**z), math.floor((1 - math.asinh(math.tan(r)) / math.pi) / 2 * 2**z)

    for z in range(most, least - 1, -1):
        (x0, y1), (x1, y0) = tile(south, west, z), tile(north, east, z)
        if (x1 - x0 + 1) * (y1 - y0 + 1) <= most_tiles:
            return z
    return least


def mosaic(tiles: DataFrame, side: int = 256) -> DataFrame:
    """(gx, gy, h) of tiles (tile_x, tile_y, cx, cy, h); a cell that several tiles hold takes the first tile's."""
    return tiles.groupBy((F.col("tile_x") * side + F.col("cx")).alias("gx"), (F.col("tile_y") * side + F.col("cy")).alias("gy")).agg(F.min_by("h", F.struct("tile_x", "tile_y")).alias("h"))


def terrarium(r: Column, g: Column, b: Column) -> Column:
    """Metres of an elevation tile's colour."""
    return (r * 256 + g + b / 256) - 32768


def as_int16(metres: Column) -> Column:
    """Whole metres within sixteen bits."""
    return F.least(F.greatest(F.round(metres), F.lit(-32768.0)), F.lit(32767.0)).cast("smallint")


def straight_line(df: DataFrame, heading: Column, length: float, step: float) -> DataFrame:
    """A row for each of the n + 1 points of a straight walk: i, px, py."""
    n = max(1, math.floor(length / step + 0.5))
    r = F.radians(heading)
    df = df.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(n))))
    return df.withColumns({"px": F.col("x") + F.sin(r) * step * F.col("i"), "py": F.col("y") + F.cos(r) * step * F.col("i")})


def relative_profile(df: DataFrame, keys: list[str]) -> DataFrame:
    """``rise``: height over the first point, for the points before the first that is off the map."""
    w = Window.partitionBy(*keys).orderBy("i")
    df = df.withColumn("_off", F.max(F.col("h").isNull()).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.withColumn("rise", F.col("h") - F.first("h").over(w)).where(~F.col("_off")).drop("_off")


def horizon(profile: DataFrame, keys: list[str], step: float) -> DataFrame:
    """``angle``: steepest look up along a profile, ``blocked``: whether a ridge hides what is behind; fewer than two points: 0."""
    look = F.degrees(F.atan2(F.col("rise") - EYE_M, F.col("i") * step))
    out = profile.groupBy(*keys).agg(F.coalesce(F.max(F.when(F.col("i") > 0, look)), F.lit(0.0)).alias("angle"))
    return out.withColumn("blocked", F.col("angle") >= BLOCKED_DEG)


def sunlit(df: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float, lat: float, lon: float, unix: float, reach: float = 5000.0, step: float = 60.0) -> DataFrame:
    """(pid, lit) of places (pid, x, y) about (lat, lon): whether the sun is up and above the terrain towards it."""
    from ..functions.geo import sun

    at = sun(lat, lon, unix)
    line = sample(straight_line(df.select("pid", "x", "y"), at["azimuth"], reach, step), dem, cols, rows, cell, "px", "py")
    angle = horizon(relative_profile(line, ["pid"]), ["pid"], step).select("pid", "angle")
    out = df.select("pid").join(angle, "pid", "left")
    return out.select("pid", ((at["elevation"] > 0) & (at["elevation"] > F.coalesce("angle", F.lit(0.0)))).alias("lit"))


def slope_aspect(df: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float, step: float) -> DataFrame:
    """``slope`` in degrees and ``downhill`` bearing by central differences; null where a sample is off the map, bearing 0 where flat."""
    from ..functions.geo import planar_bearing

    for name, dx, dy in (("_e", step, 0.0), ("_w", -step, 0.0), ("_n", 0.0, step), ("_s", 0.0, -step)):
        df = sample(df.withColumns({"_px": F.col("x") + dx, "_py": F.col("y") + dy}), dem, cols, rows, cell, "_px", "_py", name)
    gx, gy = (F.col("_e") - F.col("_w")) / (2 * step), (F.col("_n") - F.col("_s")) / (2 * step)
    df = df.withColumns({"_gx": gx, "_gy": gy})
    flat = (F.col("_gx") == 0) & (F.col("_gy") == 0)
    down = F.when(F.col("_gx").isNull() | F.col("_gy").isNull(), None).when(flat, 0.0).otherwise(planar_bearing(-F.col("_gx"), -F.col("_gy")))
    return df.withColumn("slope", F.degrees(F.atan(F.sqrt(F.col("_gx") * F.col("_gx") + F.col("_gy") * F.col("_gy"))))).withColumn("downhill", down).drop("_e", "_w", "_n", "_s", "_px", "_py", "_gx", "_gy")
