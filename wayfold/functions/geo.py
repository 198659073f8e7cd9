"""Angles, bearings, distances and map projections as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Metres of the great-circle radius and of a degree in the planar frame.
EARTH_RADIUS_M = 6_371_000.0
METRES_PER_DEGREE = 111_320.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(float(x))


def rounded(c: Column | str, places: int) -> Column:
    """``c`` rounded to decimal places as DuckDB does: the multiplied double to its nearest whole, halves away from zero, and back."""
    many = (F.col(c) if isinstance(c, str) else c) * (10.0**places)
    whole = F.rint(many)
    half = F.abs(many - whole) == 0.5
    return F.when(half, many + F.signum(many) * 0.5).otherwise(whole) / (10.0**places)


def magnitude(x, y, z) -> Column:
    """Length of a vector."""
    return F.sqrt(_c(x) * _c(x) + _c(y) * _c(y) + _c(z) * _c(z))


def wrap360(a) -> Column:
    """An angle in [0, 360)."""
    return F.pmod(_c(a), F.lit(360.0))


def angle_difference(a, b) -> Column:
    """a - b in [-180, 180)."""
    return F.pmod(_c(a) - _c(b) + 180.0, F.lit(360.0)) - 180.0


def bearing_gap(a, b) -> Column:
    """Unsigned difference, 0 to 180."""
    return F.abs(angle_difference(a, b))


def planar_bearing(dx, dy) -> Column:
    """Compass bearing of an east/north offset: 0 north, 90 east."""
    return wrap360(F.degrees(F.atan2(_c(dx), _c(dy))))


def geodesic_bearing(lat1, lon1, lat2, lon2) -> Column:
    """Initial great-circle bearing."""
    p, q, d = F.radians(_c(lat1)), F.radians(_c(lat2)), F.radians(_c(lon2) - _c(lon1))
    return wrap360(F.degrees(F.atan2(F.sin(d) * F.cos(q), F.cos(p) * F.sin(q) - F.sin(p) * F.cos(q) * F.cos(d))))


def haversine(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle metres."""
    p, q = F.radians(_c(lat1)), F.radians(_c(lat2))
    h = F.pow(F.sin((q - p) / 2), 2) + F.cos(p) * F.cos(q) * F.pow(F.sin(F.radians(_c(lon2) - _c(lon1)) / 2), 2)
    return 2 * EARTH_RADIUS_M * F.asin(F.least(F.lit(1.0), F.sqrt(h)))


def to_metres(lat, lon, lat0, lon0) -> tuple[Column, Column]:
    """East and north of an origin."""
    return (_c(lon) - _c(lon0)) * METRES_PER_DEGREE * F.cos(F.radians(_c(lat0))), (_c(lat) - _c(lat0)) * METRES_PER_DEGREE


def to_degrees(x, y, lat0, lon0) -> tuple[Column, Column]:
    """Latitude and longitude of an east/north offset."""
    return _c(lat0) + _c(y) / METRES_PER_DEGREE, _c(lon0) + _c(x) / (METRES_PER_DEGREE * F.cos(F.radians(_c(lat0))))


def box_around(lat, lon, radius_m) -> dict[str, Column]:
    """North, south, east and west of a square about a point."""
    up = _c(radius_m) / METRES_PER_DEGREE
    over = _c(radius_m) / (METRES_PER_DEGREE * F.greatest(F.cos(F.radians(_c(lat))), F.lit(1e-6)))
    return {"north": _c(lat) + up, "south": _c(lat) - up, "east": _c(lon) + over, "west": _c(lon) - over}


def turn_label(angle) -> Column:
    """Name of a signed turn."""
    a, size = _c(angle), F.abs(_c(angle))
    side = F.when(a > 0, "right").otherwise("left")
    return (
        F.when(size < 30, F.lit("straight")).when(size >= 150, F.concat(F.lit("sharp "), side, F.lit(" (U-turn)")))
        .when(size >= 100, F.concat(F.lit("sharp "), side)).when(size >= 55, side).otherwise(F.concat(F.lit("slight "), side))
    )


def sector(bearing) -> Column:
    """Nearest of eight compass points."""
    names = F.array(*[F.lit(x) for x in ("N", "NE", "E", "SE", "S", "SW", "W", "NW")])
    return F.get(names, (F.floor(wrap360(bearing) / 45 + 0.5) % 8).cast("int"))


def tilt_heading(ax, ay, az, mx, my, mz) -> Column:
    """Compass heading from gravity and a magnetometer, rotated to the horizontal."""
    ax, ay, az, mx, my, mz = map(_c, (ax, ay, az, mx, my, mz))
    flat = F.sqrt(ay * ay + az * az)
    roll, pitch = F.atan2(ay, az), F.atan2(-ax, F.when(flat == 0, F.lit(1e-9)).otherwise(flat))
    north = mx * F.cos(pitch) + mz * F.sin(pitch)
    east = mx * F.sin(roll) * F.sin(pitch) + my * F.cos(roll) - mz * F.sin(roll) * F.cos(pitch)
    return wrap360(F.degrees(F.atan2(-east, north)))


def yaw_rate(wx, wy, wz, gx, gy, gz) -> Column:
    """Degrees a second about gravity; 0 where gravity vanishes."""
    g = magnitude(gx, gy, gz)
    dot = _c(wx) * _c(gx) + _c(wy) * _c(gy) + _c(wz) * _c(gz)
    return F.when(g > 1e-6, F.degrees(dot / g)).otherwise(F.lit(0.0))


def mercator_pixel(lat, lon, zoom: int) -> tuple[Column, Column]:
    """Global web-mercator pixel at a zoom."""
    world = 256.0 * 2**zoom
    r = F.radians(_c(lat))
    return (_c(lon) + 180.0) / 360.0 * world, (1 - F.log(F.tan(r) + 1 / F.cos(r)) / math.pi) / 2 * world


def pixel_degrees(px, py, zoom: int) -> tuple[Column, Column]:
    """Latitude and longitude of a global pixel."""
    world = 256.0 * 2**zoom
    return F.degrees(F.atan(F.sinh(F.lit(math.pi) * (1 - 2 * _c(py) / world)))), _c(px) / world * 360.0 - 180.0


def sun(lat, lon, unix) -> dict[str, Column]:
    """Azimuth and elevation of the sun (the public low-precision solar equations)."""
    lat, lon, unix = map(_c, (lat, lon, unix))
    mod = lambda x, m: F.pmod(x, F.lit(float(m)))
    day = unix / 86_400 + 2_440_587.5
    c = (day - 2_451_545.0) / 36_525.0
    mean = mod(280.46646 + c * (36_000.76983 + c * 0.0003032), 360)
    anomaly = F.radians(357.52911 + c * (35_999.05029 - 0.0001537 * c))
    ecc = 0.016708634 - c * (0.000042037 + 0.0000001267 * c)
    centre = F.sin(anomaly) * (1.914602 - c * (0.004817 + 0.000014 * c)) + F.sin(2 * anomaly) * (0.019993 - 0.000101 * c) + F.sin(3 * anomaly) * 0.000289
    node = F.radians(125.04 - 1_934.136 * c)
    apparent = F.radians(mean + centre - 0.00569 - 0.00478 * F.sin(node))
    tilt = F.radians(23 + (26 + (21.448 - c * (46.815 + c * (0.00059 - c * 0.001813))) / 60) / 60 + 0.00256 * F.cos(node))
    decl = F.asin(F.sin(tilt) * F.sin(apparent))
    y = F.pow(F.tan(tilt / 2), 2)
    l0 = F.radians(mean)
    equation = 4 * F.degrees(y * F.sin(2 * l0) - 2 * ecc * F.sin(anomaly) + 4 * ecc * y * F.sin(anomaly) * F.cos(2 * l0) - 0.5 * y * y * F.sin(4 * l0) - 1.25 * ecc * ecc * F.sin(2 * anomaly))
    minutes = mod(day + 0.5, 1) * 1_440
    solar = mod(minutes + equation + 4 * lon, 1_440)
    hour = F.radians(solar / 4 - 180)
    latr = F.radians(lat)
    zenith = F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.sin(latr) * F.sin(decl) + F.cos(latr) * F.cos(decl) * F.cos(hour))))
    cos_az = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), (F.sin(latr) * F.cos(zenith) - F.sin(decl)) / (F.cos(latr) * F.sin(zenith))))
    a = F.degrees(F.acos(cos_az))
    azimuth = F.when(F.sin(zenith) < 1e-9, F.lit(0.0)).when(hour > 0, mod(a + 180, 360)).otherwise(mod(540 - a, 360))
    return {"azimuth": azimuth, "elevation": 90 - F.degrees(zenith)}


def decimal_year(ts) -> Column:
    """The year with the part of it that is over."""
    ts = _c(ts)
    start, after = F.make_date(F.year(ts), F.lit(1), F.lit(1)), F.make_date(F.year(ts) + 1, F.lit(1), F.lit(1))
    seconds = lambda d: F.unix_micros(d.cast("timestamp")) / 1e6
    return F.year(ts) + (F.unix_micros(ts) / 1e6 - seconds(start)) / (seconds(after) - seconds(start))
