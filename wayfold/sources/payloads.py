"""Sensor payloads: JSON of several shapes to samples, and back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sensor names and key styles that payloads use.
NAMES = {"accel": ("accelerometer",), "gyro": ("gyroscope", "gyroscopeuncalibrated"), "mag": ("magnetometer", "magnetometeruncalibrated")}
FLAT = {"accel": (("accel_x", "accel_y", "accel_z"), ("x", "y", "z"), ("ax", "ay", "az")), "gyro": (("gyro_x", "gyro_y", "gyro_z"), ("gx", "gy", "gz")), "mag": (("mag_x", "mag_y", "mag_z"), ("mx", "my", "mz"))}
STYLES = (("x", "y", "z"), ("accel_x", "accel_y", "accel_z"), ("gyro_x", "gyro_y", "gyro_z"), ("ax", "ay", "az"), ("gx", "gy", "gz"))
LISTS = ("messages", "payload", "data")


def xyz(values: Column, styles=STYLES) -> Column:
    """(x, y, z) of the first key style of which all three are there; null if one is no number."""
    out = F.lit(None).cast("struct<x:double,y:double,z:double>")
    for keys in reversed(styles):
        raw = [F.try_variant_get(values, f"$.{k}", "variant") for k in keys]
        got = [F.coalesce(F.try_variant_get(values, f"$.{k}", "double"), F.try_variant_get(values, f"$.{k}", "string").try_cast("double")) for k in keys]
        there = raw[0].isNotNull() & raw[1].isNotNull() & raw[2].isNotNull()
        whole = got[0].isNotNull() & got[1].isNotNull() & got[2].isNotNull()
        value = F.when(whole, F.struct(*[g.alias(a) for g, a in zip(got, "xyz")]))
        out = F.when(there, value).otherwise(out)
    return out


def _listed(v: Column) -> Column:
    """Array of (kind, i, x, y, z) of a parsed payload's samples, in the order accel, gyro, mag."""
    return F.concat(*_by_kind(v))


def _by_kind(v: Column) -> list[Column]:
    out = []
    for kind, names in NAMES.items():
        any_flat = F.lit(False)
        for keys in FLAT[kind]:
            here = F.lit(True)
            for k in keys:
                here = here & F.try_variant_get(v, f"$.{k}", "variant").isNotNull()
            any_flat = any_flat | here
        none = F.array().cast("array<struct<x:double,y:double,z:double>>")
        lists = []
        for name in LISTS:
            named = F.filter(F.try_variant_get(v, f"$.{name}", "array<variant>"), lambda m: F.lower(F.try_variant_get(m, "$.name", "string")).isin(*names))
            got = F.filter(F.transform(named, lambda m: xyz(F.coalesce(F.try_variant_get(m, "$.values", "variant"), m))), lambda s: s.isNotNull())
            lists.append(F.coalesce(got, none))
        # Each list is read once; the first that yields anything counts.
        batch = F.coalesce(F.get(F.filter(F.array(*lists), lambda g: F.size(g) > 0), F.lit(0)), none)
        got = F.when(any_flat, F.filter(F.array(xyz(v, FLAT[kind])), lambda s: s.isNotNull())).otherwise(batch)
        out.append(_numbered(kind, got))
    return out


def _numbered(kind: str, found: Column) -> Column:
    return F.transform(found, lambda s, i: F.struct(F.lit(kind).alias("kind"), i.alias("i"), s["x"].alias("x"), s["y"].alias("y"), s["z"].alias("z")))


def samples(payloads: DataFrame) -> DataFrame:
    """(pid, kind, i, x, y, z) of every sample in ``payloads(pid, body)``.

    A flat sample wins; else the first of the lists that yields samples of the sensor's name.  All samples of a
    payload share its one time stamp.  Each body is parsed once.
    """
    return payloads.select("pid", F.try_parse_json("body").alias("v")).select("pid", F.inline(_listed(F.col("v"))))


def rejects(payloads: DataFrame) -> DataFrame:
    """Payloads of which no sample can be read."""
    # A filter is pushed below a column and the parse put in for each of its mentions, but not below an exploded one: each body is parsed once.
    parsed = payloads.select("*", F.explode(F.array(F.try_parse_json("body"))).alias("_v"))
    some = reduce(Column.__or__, [F.coalesce(F.size(found), F.lit(0)) > 0 for found in _by_kind(F.col("_v"))])
    return parsed.where(~some).drop("_v")


def post(bodies: DataFrame, running: Column) -> DataFrame:
    """Samples of posted bodies (pid, body); what is posted while no session runs is ignored."""
    return samples(bodies.where(running).select("pid", "body"))


def encode(df: DataFrame) -> DataFrame:
    """(pid, body): each acceleration as a flat JSON payload."""
    return df.select("pid", F.to_json(F.struct(F.col("x").alias("accel_x"), F.col("y").alias("accel_y"), F.col("z").alias("accel_z"))).alias("body"))
