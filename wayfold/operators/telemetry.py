"""Motion state from ordered sensor rows: window functions first, ordered folds where state is needed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geo import angle_difference, wrap360

# The detector's defaults.
WINDOW_ROWS, STILL_BELOW, MOVING_ABOVE, STILL_HOLD, MOVING_HOLD = 75, 0.015, 0.040, 1.0, 0.8
ROTATION_DPS = 8.0


def rolling_variance(df: DataFrame, rows: int = WINDOW_ROWS, keys: tuple[str, ...] = ("device_id",), order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """``variance``: population variance of mag over the last ``rows`` rows; 0 for one row.  ``keys`` may hold a leg, which resets it."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(rows - 1), 0)
    return df.withColumn("variance", F.coalesce(F.when(F.count("mag").over(w) < 2, 0.0).otherwise(F.var_pop("mag").over(w)), F.lit(0.0)))


def stationary(df: DataFrame, below: float = STILL_BELOW, above: float = MOVING_ABOVE, still_hold: float = STILL_HOLD, moving_hold: float = MOVING_HOLD, rotating: Column | None = None, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """``still``: the Schmitt trigger with holds, in closed form.

    A run below (above) the threshold that has lasted its hold is a set (clear) event, rotation clears and
    vetoes; the state is that of the last event.  Nothing is folded, so it is all window functions.
    """
    w = Window.partitionBy(*keys).orderBy("t", "event_id")
    turn = F.coalesce(rotating, F.lit(False)) if rotating is not None else F.lit(False)
    df = df.withColumns({"_rn": F.row_number().over(w), "_turn": turn})
    for name, inside in (("lo", F.col("variance") < below), ("hi", F.col("variance") > above)):
        df = df.withColumn(f"_{name}", inside).withColumn(f"_{name}_run", F.max(F.when(~inside, F.col("_rn"))).over(w))
        run = Window.partitionBy(*keys, f"_{name}_run")
        df = df.withColumn(f"_{name}_since", F.min(F.when(F.col(f"_{name}"), F.col("t"))).over(run))
    set_on = F.col("_lo") & (F.col("t") - F.col("_lo_since") >= still_hold) & ~F.col("_turn")
    clear = (F.col("_hi") & (F.col("t") - F.col("_hi_since") >= moving_hold)) | F.col("_turn")
    event = F.when(set_on, 1).when(clear, 0)
    df = df.withColumn("still", F.coalesce(F.last(event, ignorenulls=True).over(w), F.lit(0)) == 1)
    return df.drop("_rn", "_turn", "_lo", "_lo_run", "_lo_since", "_hi", "_hi_run", "_hi_since")


def intervals(df: DataFrame) -> DataFrame:
    """Stretches of equal state: device_id, still, since, until, rows."""
    w = Window.partitionBy("device_id").orderBy("t", "event_id")
    df = df.withColumn("_new", F.coalesce((F.col("still") != F.lag("still").over(w)).cast("int"), F.lit(1))).withColumn("stretch", F.sum("_new").over(w))
    return df.groupBy("device_id", "stretch", "still").agg(F.min("t").alias("since"), F.max("t").alias("until"), F.count("*").alias("rows"))


def integrate_gyro(df: DataFrame, deadband: float = 2.0, most_dt: float = 1.0) -> DataFrame:
    """``turned``: yaw integrated over steps shorter than ``most_dt`` and beyond the deadband, wrapped once; ``change``: since the first row."""
    w = Window.partitionBy("device_id").orderBy("t", "event_id")
    dt = F.col("t") - F.lag("t").over(w)
    step = F.when((dt > 0) & (dt < most_dt) & (F.abs("yaw") >= deadband), F.col("yaw") * dt).otherwise(0.0)
    df = df.withColumn("_step", step).withColumn("turned", wrap360(F.sum("_step").over(w)))
    return df.withColumn("change", angle_difference("turned", F.first("turned").over(w))).drop("_step")


def fold(df: DataFrame, fields: list[str], start: Column, step, read, keys: tuple[str, ...] = ("device_id",), order: tuple[str, ...] = ("t", "event_id")) -> DataFrame:
    """An ordered fold of each key's rows, for recurrences that have no closed form; JVM-side ``aggregate`` over a sorted array."""
    rows = F.sort_array(F.collect_list(F.struct(*order, *fields)))
    return df.groupBy(*keys).agg(F.aggregate(rows, start, step, read).alias("out"))


#: Seconds of a chunk: of one device so much is ordered in one task.
CHUNK_S = 6 * 3600.0


def decayed(df: DataFrame, values: dict[str, Column], keep: float, keys: tuple[str, ...] = ("device_id",), order: tuple[str, ...] = ("t", "event_id"), chunk_s: float = CHUNK_S, primed: bool = False) -> DataFrame:
    """(keys, n, a column for each of ``values``): keep * previous + (1 - keep) * value after each key's last row; from 0, or the first value if ``primed``.

    A step is an affine map, and so is a chunk of steps: what it keeps of the state before, and what its rows add.  Chunks of
    ``chunk_s`` seconds are summed up on their own, so one device's history is spread over many tasks, and only the chunks' maps, a few numbers
    each, are put together in order of time.  Rows without a value are left out.
    """
    from functools import reduce

    rows = df.select(*keys, *order, *(c.alias(f"_{k}") for k, c in values.items())).where(reduce(lambda a, b: a & b, (F.col(f"_{k}").isNotNull() for k in values)))
    rows = rows.withColumn("_chunk", F.floor(F.col(order[0]) / chunk_s))
    back = Window.partitionBy(*keys, "_chunk").orderBy(*(F.desc(c) for c in order))
    rows = rows.withColumn("_after", F.row_number().over(back) - 1)
    adds = [F.sum(F.col(f"_{k}") * (1 - keep) * F.pow(F.lit(keep), "_after")).alias(k) for k in values]
    starts = [F.min_by(f"_{k}", F.struct(*order)).alias(f"_first_{k}") for k in values]
    maps = rows.groupBy(*keys, "_chunk").agg(F.count("*").alias("_n"), *adds, *starts)
    listed = maps.groupBy(*keys).agg(F.sum("_n").alias("n"), F.sort_array(F.collect_list(F.struct("_chunk", "_n", *values, *(f"_first_{k}" for k in values)))).alias("_maps"))
    start = F.struct(*((F.get("_maps", F.lit(0))[f"_first_{k}"] if primed else F.lit(0.0)).cast("double").alias(k) for k in values))
    step = lambda a, m: F.struct(*((a[k] * F.pow(F.lit(keep), m["_n"]) + m[k]).alias(k) for k in values))
    return listed.withColumn("_end", F.aggregate("_maps", start, step)).select(*keys, "n", *(F.col(f"_end.{k}").alias(k) for k in values))


def ema(df: DataFrame, field: str, keep: float) -> DataFrame:
    """``out``: keep * previous + (1 - keep) * value, from 0."""
    return decayed(df, {"out": F.col(field)}, keep).drop("n")


def low_pass(df: DataFrame, field: str, keep: float = 0.6) -> DataFrame:
    """``out``: the same, primed with the first value."""
    return decayed(df, {"out": F.col(field)}, keep, primed=True).drop("n")


def complementary(df: DataFrame, field: str, trust: float = 0.92) -> DataFrame:
    """``out``: a heading drawn to the compass by 1 - trust of the difference."""
    return fold(df, [field], F.lit(None).cast("double"), lambda a, x: F.when(a.isNull(), x[field]).otherwise(wrap360(a + (1 - trust) * angle_difference(x[field], a))), lambda a: a)


def calibrate(df: DataFrame, compass: str, bearing: str, alpha: float = 0.03, least: int = 40) -> DataFrame:
    """``out``: (n, ready, offset) of the circular moving average of compass - bearing."""
    off = F.radians(wrap360(F.col(compass) - F.col(bearing)))
    ends = decayed(df, {"s": F.sin(off), "c": F.cos(off)}, 1 - alpha)
    ready = (F.col("n") >= least) & (F.col("s") * F.col("s") + F.col("c") * F.col("c") > 1e-6)
    return ends.select("device_id", F.struct(F.col("n").cast("int").alias("n"), ready.alias("ready"), wrap360(F.degrees(F.atan2("s", "c"))).alias("offset")).alias("out"))


def calibrate_gated(df: DataFrame, compass: str, bearing: str, ok: str, alpha: float = 0.03, least: int = 40, most_off: float = 40.0) -> DataFrame:
    """The same, over rows that pass ``ok``; once ready, samples more than ``most_off`` from the offset are dropped."""
    sample = lambda x: wrap360(x[compass] - x[bearing])
    start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("c"), F.lit(0).alias("n"))

    def step(a, x):
        o = F.radians(sample(x))
        now = wrap360(F.degrees(F.atan2(a.s, a.c)))
        ready = (a.n >= least) & (a.s * a.s + a.c * a.c > 1e-6)
        use = x[ok] & ~(ready & (F.abs(angle_difference(sample(x), now)) > most_off))
        return F.when(use, F.struct((a.s * (1 - alpha) + F.sin(o) * alpha).alias("s"), (a.c * (1 - alpha) + F.cos(o) * alpha).alias("c"), (a.n + 1).alias("n"))).otherwise(a)

    read = lambda a: F.struct(a.n.alias("n"), wrap360(F.degrees(F.atan2(a.s, a.c))).alias("offset"))
    return fold(df, [compass, bearing, ok], start, step, read)


def thin(df: DataFrame, period: float, keys: tuple[str, ...] = ("device_id",)) -> DataFrame:
    """``out``: times kept by greedy thinning, each at least ``period`` after the one kept before.

    A time's successor is the first that is late enough, so the kept times are those reached from the first one;
    a batch of devices' sorted times is followed by binary search, a step for each kept time.
    """
    listed = df.groupBy(*keys).agg(F.array_sort(F.collect_list("t")).alias("out"))
    names = [*keys, "out"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = []
            for t in batch.column("out"):
                times, at, own = t.values.to_numpy(), 0, []
                while at < len(times):
                    own.append(times[at])
                    at = int(np.searchsorted(times, times[at] + period, side="left"))
                kept.append(own)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(kept, pa.list_(pa.float64()))], names)

    return listed.select(*names).mapInArrow(run, listed.select(*names).schema)


# Seconds between rows of a log, by what is logged.
LOG_PERIOD = {"sensor": 0.33, "motion": 0.04}


def log_rows(df: DataFrame, owner: str) -> DataFrame:
    """The rows (owner, kind, t, ...) of one owner that a log keeps: sensors and raw motion thinned, each kind on its own, all else whole."""
    own = df.where(F.col("owner") == owner)
    out = own.where(~F.col("kind").isin(*LOG_PERIOD))
    for kind, period in LOG_PERIOD.items():
        rows = own.where(F.col("kind") == kind)
        kept = thin(rows.select("owner", "t"), period, ("owner",)).select("owner", F.explode("out").alias("t")).distinct()
        out = out.unionByName(rows.dropDuplicates(["owner", "t"]).join(kept, ["owner", "t"], "left_semi").select(*df.columns))
    return out


def write_log(df: DataFrame, owner: str, path: str) -> None:
    """Append the kept rows as lines of JSON."""
    log_rows(df, owner).write.mode("append").json(path)
