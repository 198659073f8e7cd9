"""Resampling and comparing ordered sequences."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_difference


def _intervals(df: DataFrame, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(at)
    lead = {f"_{f}": F.lead(f).over(w) for f in [at, *fields]}
    return df.withColumns(lead | {"_from": F.first(at).over(w), "_to": F.last(at).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))}).where(F.col(f"_{at}").isNotNull())


def distance_profile(df: DataFrame, step: float, keys: list[str], heading: str | None = None) -> DataFrame:
    """(keys, i, rise[, heading]): altitude over the first sample's at every ``step`` of ``d``, between samples by a line.

    Each sample interval yields the bins that end in it: a bin belongs to the first interval that reaches
    it.  The heading is that of the nearer sample.  Walks shorter than one step have no bins.
    """
    df = _intervals(df, keys, "d", ["alt", *([heading] if heading else [])]).where(F.col("_to") - F.col("_from") >= step)
    first = F.when(F.col("d") == F.col("_from"), 0).otherwise(F.floor((F.col("d") - F.col("_from")) / step) + 1)
    last = F.floor((F.col("_d") - F.col("_from")) / step)
    df = df.where(first <= last).withColumn("i", F.explode(F.sequence(first.cast("int"), last.cast("int"))))
    t = (F.col("_from") + F.col("i") * step - F.col("d")) / (F.col("_d") - F.col("d"))
    df = df.withColumn("_t", F.when(F.col("_d") > F.col("d"), t).otherwise(0.0))
    df = df.withColumn("_h", F.col("alt") + (F.col("_alt") - F.col("alt")) * F.col("_t"))
    out = df.withColumn("rise", F.col("_h") - F.first("_h").over(Window.partitionBy(*keys).orderBy("i")))
    return out.select(*keys, "i", "rise", *([F.when(F.col("_t") < 0.5, F.col(heading)).otherwise(F.col(f"_{heading}")).alias(heading)] if heading else []))


def step_resample(df: DataFrame, step: float, keys: list[str], at: str, fields: list[str]) -> DataFrame:
    """(keys, i, fields): for every target step, 2 step ... the first sample at or past it; several targets may share one."""
    w = Window.partitionBy(*keys).orderBy(at)
    before = F.coalesce(F.lag(at).over(w), F.lit(0.0))
    low, high = F.floor(before / step) + 1, F.floor(F.col(at) / step)
    df = df.withColumns({"_low": F.greatest(low, F.lit(1)), "_high": high}).where("_low <= _high")
    return df.withColumn("i", F.explode(F.sequence(F.col("_low").cast("int"), F.col("_high").cast("int")))).select(*keys, "i", *fields)


def heading_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """n, circular deviation in degrees, total change, turns of more than 30 degrees, and where the walk ends after unit steps."""
    w = Window.partitionBy(*keys).orderBy("i")
    df = df.withColumn("_d", F.abs(angle_difference(F.col("heading"), F.lag("heading").over(w))))
    s, c = F.avg(F.sin(F.radians("heading"))), F.avg(F.cos(F.radians("heading")))
    length = F.least(F.greatest(F.sqrt(s * s + c * c), F.lit(1e-9)), F.lit(1.0))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n"), F.degrees(F.sqrt(F.abs(-2 * F.log(length)))).alias("deviation"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("change"),
        F.sum(F.when(F.col("_d") > 30, 1).otherwise(0)).alias("turns"), F.sum(F.sin(F.radians("heading"))).alias("end_x"), F.sum(F.cos(F.radians("heading"))).alias("end_y"),
    )


def retraced(df: DataFrame, keys: list[str], within: float = 25.0, apart: int = 4, least: int = 6) -> DataFrame:
    """(keys, share): points close to one at least ``apart`` bins earlier; a cell equi-join finds the neighbours."""
    cells = df.withColumns({"_cx": F.floor(F.col("x") / within), "_cy": F.floor(F.col("y") / within)})
    around = F.explode(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1)]))
    old = cells.select(*[F.col(k).alias(f"_{k}") for k in keys], F.col("i").alias("_i"), F.col("x").alias("_x"), F.col("y").alias("_y"), "_cx", "_cy", around.alias("o"))
    old = old.withColumns({"_ox": F.col("_cx") + F.col("o.a"), "_oy": F.col("_cy") + F.col("o.b")}).drop("_cx", "_cy", "o")
    near = (F.col("_i") <= F.col("i") - apart) & (F.hypot(F.col("x") - F.col("_x"), F.col("y") - F.col("_y")) <= within)
    same = [F.col(k) == F.col(f"_{k}") for k in keys] + [F.col("_cx") == F.col("_ox"), F.col("_cy") == F.col("_oy")]
    cond = near
    for s in same:
        cond = cond & s
    hit = cells.join(old, cond, "left_semi").groupBy(*keys).agg(F.count("*").alias("_hit"))
    n = df.groupBy(*keys).agg(F.count("*").alias("_n")).join(hit, keys, "left")
    return n.select(*keys, F.when(F.col("_n") < least, 0.0).otherwise(F.coalesce("_hit", F.lit(0)) / F.col("_n")).alias("share"))


def polyline_length(df: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, length) of points in order of i."""
    w = Window.partitionBy(*keys).orderBy("i")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    return df.withColumn("_s", step).groupBy(*keys).agg(F.coalesce(F.sum("_s"), F.lit(0.0)).alias("length"))


def along(df: DataFrame, step: float, keys: list[str], heading: bool = False) -> DataFrame:
    """(keys, k, x, y), with ``heading`` also that of the side it stands on: a point at every ``step`` of the polyline's length."""
    from ..functions.geo import planar_bearing

    w = Window.partitionBy(*keys).orderBy("i")
    df = df.withColumns({"_x": F.lead("x").over(w), "_y": F.lead("y").over(w)}).where(F.col("_x").isNotNull())
    df = df.withColumn("_len", F.hypot(F.col("_x") - F.col("x"), F.col("_y") - F.col("y"))).withColumn("_end", F.sum("_len").over(w)).withColumn("_start", F.col("_end") - F.col("_len"))
    low, high = F.ceil(F.col("_start") / step), F.ceil(F.col("_end") / step) - 1
    df = df.where(low <= high).withColumn("k", F.explode(F.sequence(low.cast("int"), high.cast("int"))))
    t = (F.col("k") * step - F.col("_start")) / F.col("_len")
    more = [planar_bearing(F.col("_x") - F.col("x"), F.col("_y") - F.col("y")).alias("heading")] if heading else []
    return df.select(*keys, "k", (F.col("x") + (F.col("_x") - F.col("x")) * t).alias("x"), (F.col("y") + (F.col("_y") - F.col("y")) * t).alias("y"), *more)


def variance(profile: Column) -> Column:
    """Population variance of an array."""
    n = F.size(profile)
    mean = F.aggregate(profile, F.lit(0.0), lambda a, x: a + x) / n
    return F.when(n < 2, 0.0).otherwise(F.aggregate(profile, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean)) / n)


def deviation(values: Column) -> Column:
    """Population standard deviation of an array, by Welford's running mean in the array's order: where a last digit decides a rounding, it is the SQL's."""

    def step(s: Column, x: Column) -> Column:
        n = s["n"] + 1
        mean = s["mean"] + (x - s["mean"]) / n
        return F.struct(n.alias("n"), mean.alias("mean"), (s["squares"] + (x - mean) * (x - s["mean"])).alias("squares"))

    none = F.struct(*[F.lit(0.0).alias(c) for c in ("n", "mean", "squares")])
    return F.aggregate(F.filter(values, lambda x: x.isNotNull()), none, step, lambda s: F.when(s["n"] > 0, F.sqrt(s["squares"] / s["n"])))


def band_width(n: int, m: int, share: float = 0.2) -> int:
    return max(abs(n - m) + 1, int(np.ceil(max(n, m) * share)))


def dtw_many(a: np.ndarray, b: np.ndarray, share: float = 0.2) -> np.ndarray:
    """Banded time-warp distance of each row of ``a`` to ``b``, by length: all rows step through the band together."""
    n, m = a.shape[1], len(b)
    if not n or not m:
        return np.full(len(a), np.inf)
    band = band_width(n, m, share)
    before = np.full((len(a), m + 1), np.inf)
    before[:, 0] = 0
    for i in range(1, n + 1):
        now = np.full_like(before, np.inf)
        for j in range(max(1, i - band), min(m, i + band) + 1):
            best = np.minimum(before[:, j], np.minimum(now[:, j - 1], before[:, j - 1]))
            now[:, j] = np.abs(a[:, i - 1] - b[j - 1]) + best
        before = now
    return before[:, m] / (n + m)


def dtw(df: DataFrame, profile: str, observed: list[float], out: str = "cost") -> DataFrame:
    """``out``: distance of each row's profile to the observed one; in Arrow batches, profiles of one length at a time."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        b = np.asarray(observed, float)
        for s in batches:
            cost = np.full(len(s), np.inf)
            length = s.map(len)
            for n in length.unique():
                at = np.flatnonzero(length == n)
                cost[at] = dtw_many(np.stack([np.asarray(x, float) for x in s.iloc[at]]).reshape(len(at), n), b)
            yield pd.Series(cost)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return df.withColumn(out, F.pandas_udf(run, "double")(profile))


def likelihood(cost: Column, sigma: float = 5.0) -> Column:
    """Weight of a time-warp cost."""
    return F.when(cost.isNull() | (cost == float("inf")), 0.0).otherwise(F.exp(-(cost * cost) / (2 * sigma * sigma)))
