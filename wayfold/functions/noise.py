"""Random numbers that depend on a seed and a key alone: the same however rows are dealt, and when a task runs again."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def uniform(seed: int, *keys: str | Column) -> Column:
    """In [0, 1), from 53 bits of a hash."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *keys), 11) / F.lit(float(1 << 53))


def gauss(seed: int, *keys: str | Column) -> Column:
    """Standard normal, by Box and Muller's transform of two uniform numbers."""
    u, v = F.greatest(uniform(2 * seed, *keys), F.lit(1e-12)), uniform(2 * seed + 1, *keys)
    return F.sqrt(-2 * F.log(u)) * F.cos(2 * math.pi * v)


def accelerations(moving: Column, seed: int, *keys: str | Column, driving: float = 0.30, idle: float = 0.002) -> Column:
    """A mock accelerometer's (x, y, z) in g: noise about gravity, large while it moves."""
    sigma = F.when(moving, driving).otherwise(idle)
    x, y, z = (gauss(3 * seed + k, *keys) * sigma for k in range(3))
    return F.struct(x.alias("x"), y.alias("y"), (z + 1.0).alias("z"))
