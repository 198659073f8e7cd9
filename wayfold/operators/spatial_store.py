"""Places stored along a space-filling curve, so that a look-up of a box reads only the files and row groups that can hold it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of a coordinate in a key, and how many of a key's leading bits name its folder.
BITS, ZONE_BITS = 20, 8
#: A box is covered by so many ranges of keys at most.
MOST_RANGES = 48


def _spread(v: Column) -> Column:
    """A number's bits, each followed by a gap of one."""
    for shift, mask in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        v = v.bitwiseOR(F.shiftleft(v, shift)).bitwiseAND(F.lit(mask))
    return v


def _cells(v: Column, low: float, span: float) -> Column:
    """Which of 2 ** BITS even cells a coordinate is in; the far edge is in the last."""
    top = (1 << BITS) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((v - low) / span * (top + 1)))).cast("long")


def morton(lat: Column, lon: Column) -> Column:
    """The key of a place in degrees: the bits of its cell, north and east in turn, so that what is near has mostly near keys."""
    return F.shiftleft(_spread(_cells(lat, -90.0, 180.0)), 1).bitwiseOR(_spread(_cells(lon, -180.0, 360.0)))


def ranges(south: float, west: float, north: float, east: float, most: int = MOST_RANGES) -> list[tuple[int, int]]:
    """Ranges of keys, first and last, that cover a box: cells of the curve are cut in four while they stick out and there is room for more."""
    top = 1 << BITS
    cell = lambda v, low, span: max(0, min(top - 1, int((v - low) // (span / top))))
    y0, y1, x0, x1 = cell(south, -90.0, 180.0), cell(north, -90.0, 180.0), cell(west, -180.0, 360.0), cell(east, -180.0, 360.0)
    # (bits below, row, column) of a square of cells; those that stick out of the box may be cut.
    whole: list[tuple[int, int, int]] = []
    edge = [(BITS, 0, 0)]
    while edge:
        parts = [(b - 1, 2 * y + dy, 2 * x + dx) for b, y, x in edge for dy in (0, 1) for dx in (0, 1)]
        parts = [(b, y, x) for b, y, x in parts if (y << b) <= y1 and ((y + 1) << b) > y0 and (x << b) <= x1 and ((x + 1) << b) > x0]
        inside = [(b, y, x) for b, y, x in parts if (y << b) >= y0 and ((y + 1) << b) - 1 <= y1 and (x << b) >= x0 and ((x + 1) << b) - 1 <= x1]
        out = [p for p in parts if p not in inside]
        if len(whole) + len(parts) > most:
            whole += edge
            break
        whole, edge = whole + inside, [p for p in out if p[0]]
        whole += [p for p in out if not p[0]]
    keyed = sorted((_key(y, x) << 2 * b, ((_key(y, x) + 1) << 2 * b) - 1) for b, y, x in whole)
    joined: list[tuple[int, int]] = []
    for a, z in keyed:
        if joined and a <= joined[-1][1] + 1:
            joined[-1] = (joined[-1][0], max(z, joined[-1][1]))
        else:
            joined.append((a, z))
    return joined


def _key(y: int, x: int) -> int:
    return sum(((y >> k & 1) << (2 * k + 1)) | ((x >> k & 1) << (2 * k)) for k in range(BITS))


def write_places(df: DataFrame, path: str, files: int = 16) -> None:
    """Rows (lat, lon ...) in order of their keys, in folders by the keys' leading bits; rows without a place are kept in a zone of their own."""
    keyed = df.withColumn("key", F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), morton(F.col("lat"), F.col("lon"))))
    keyed = keyed.withColumn("zone", F.coalesce(F.shiftright("key", 2 * BITS - ZONE_BITS), F.lit(-1)).cast("int"))
    keyed.repartitionByRange(files, "zone", "key").sortWithinPartitions("zone", "key").write.partitionBy("zone").mode("overwrite").parquet(path)


def in_box(spark: SparkSession, path: str, south: float, west: float, north: float, east: float) -> DataFrame:
    """The stored rows in a box, its edges included: folders are pruned by zone, row groups by key, and rows compared."""
    zone, key = None, None
    for a, z in ranges(south, west, north, east):
        in_zone = F.col("zone").between(a >> (2 * BITS - ZONE_BITS), z >> (2 * BITS - ZONE_BITS))
        zone, key = (in_zone, F.col("key").between(a, z)) if zone is None else (zone | in_zone, key | F.col("key").between(a, z))
    rows = spark.read.parquet(path).where(zone & key)
    return rows.where(F.col("lat").between(south, north) & F.col("lon").between(west, east)).drop("zone", "key")
