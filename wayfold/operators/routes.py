"""Progress along routes: legs, dead reckoning, arrivals, gait."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The engine's defaults.
SNAP_M, LEAST_LEG_S, LEAST_SPEED, MOST_SPEED, OLD_SHARE, FIRST_SPEED = 50.0, 3.0, 1.0, 45.0, 0.7, 11.0


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def expected_time(metres: Column, speed: Column) -> Column:
    """Seconds for a leg."""
    return metres / speed


def progress(ticks: DataFrame, keys: tuple[str, ...] = ("route", "leg")) -> DataFrame:
    """``done``: dead-reckoned metres of a leg, held at its length; ``prompt``: whether the gate is reached.

    Within a leg the speed is constant and no increment is negative, so the clamped sum is exact.
    """
    w = Window.partitionBy(*keys).orderBy("t").rowsBetween(Window.unboundedPreceding, 0)
    df = ticks.withColumn("done", F.least(F.sum(F.when(F.col("moving"), F.col("speed") * F.col("dt")).otherwise(0.0)).over(w), F.col("metres")))
    return df.withColumn("prompt", F.col("done") >= F.col("metres"))


def progress_by_clock(legs: DataFrame, clock: list[tuple[int, bool, float]]) -> DataFrame:
    """The rows of :func:`progress` for ``legs(..., metres, speed)`` that all get the ticks (t, moving, dt) of one clock, and ``t`` and ``moving``.

    A leg's sums are one array, added up in the order of ticks as the window adds them, and written out in the plan:
    for clocks of some tens of ticks.  No tick is shuffled or sorted.
    """
    sums, ticks, stood = [F.lit(0.0)], [], False
    for t, moving, dt in sorted(clock):
        stood = stood or not moving
        if moving:
            sums.append(sums[-1] + F.coalesce(F.col("speed") * dt, F.lit(0.0)))
        ticks.append(F.struct(F.lit(t).alias("t"), F.lit(moving).alias("moving"), F.lit(len(sums) - 1).alias("_k"), F.lit(stood).alias("_stood")))
    df = legs.withColumn("_sums", F.array(*sums)).select("*", F.inline(F.array(*ticks)))
    # Where no increment is known yet, there is no sum.
    total = F.when(F.col("_stood") | F.col("speed").isNotNull(), F.get("_sums", F.col("_k")))
    return df.withColumn("done", F.least(total, F.col("metres"))).withColumn("prompt", F.col("done") >= F.col("metres")).drop("_sums", "_k", "_stood")


def snaps(done: Column, metres: Column, still: Column, leg_s: Column) -> Column:
    """Whether a stop counts as arriving: still, close before the end, and the leg not too young."""
    return still & (metres - done <= SNAP_M) & (leg_s >= LEAST_LEG_S)


def smoothed_speeds(legs: DataFrame, first: float = FIRST_SPEED, calibrated: bool = False) -> DataFrame:
    """``out``: a route's speed after each arrival, as an array by seq.

    New speed = clamp(0.7 old + 0.3 D / max(t, 3)).  With ``calibrated`` the first arrival sets it outright.
    """
    rows = F.sort_array(F.collect_list(F.struct("seq", "metres", "seconds")))
    start = F.array(F.lit(first))

    def step(a, x):
        v = x.metres / F.greatest(x.seconds, F.lit(LEAST_LEG_S))
        old = F.element_at(a, -1)
        new = old * OLD_SHARE + v * (1 - OLD_SHARE)
        return F.concat(a, F.array(clamp(F.when(F.size(a) == 1, v).otherwise(new) if calibrated else new, LEAST_SPEED, MOST_SPEED)))

    return legs.groupBy("route").agg(F.aggregate(rows, start, step).alias("out"))


def cumulative(legs: DataFrame) -> DataFrame:
    """``start_m, end_m``: where each leg begins and ends along its route."""
    w = Window.partitionBy("route").orderBy("seq")
    end = F.sum("metres").over(w)
    return legs.withColumns({"end_m": end, "start_m": end - F.col("metres")})


def locate(targets: DataFrame, legs: DataFrame) -> DataFrame:
    """The leg of ``targets(route, at_m)`` and the share of it that is done: an equi-join on the route, then an interval."""
    found = targets.join(cumulative(legs), "route").where((F.col("at_m") >= F.col("start_m")) & (F.col("at_m") < F.col("end_m")))
    return found.select("route", "at_m", "seq", ((F.col("at_m") - F.col("start_m")) / F.col("metres")).alias("share"))


def turns(legs: DataFrame, bearing: str = "bearing") -> DataFrame:
    """``turn``: change of bearing at the start of each leg, null for the first."""
    from ..functions.geo import angle_difference

    before = F.lag(bearing).over(Window.partitionBy("route").orderBy("seq"))
    return legs.withColumn("turn", F.when(before.isNotNull(), angle_difference(F.col(bearing), before)))


def gait(df: DataFrame, rows: int = 8) -> DataFrame:
    """``slope, level``: speed as a line in cadence over the last good samples; through the origin for one, level if all cadences are alike."""
    good = df.where((F.col("cadence") >= 0.5) & (F.col("speed") > 0) & (F.col("speed") <= 8))
    w = Window.partitionBy("device_id").orderBy("t", "event_id").rowsBetween(-(rows - 1), 0)
    n, spread = F.count("*").over(w), F.var_pop("cadence").over(w)
    line = (n >= 2) & (spread > 1e-9)
    slope = F.when(line, F.regr_slope("speed", "cadence").over(w)).when(n == 1, F.col("speed") / F.col("cadence")).otherwise(0.0)
    level = F.when(line, F.regr_intercept("speed", "cadence").over(w)).when(n == 1, 0.0).otherwise(F.avg("speed").over(w))
    return good.withColumn("slope", slope).withColumn("level", level)


def first_leg(df: DataFrame) -> DataFrame:
    """Per device: n, r2 of steps against time (0 if degenerate), stride, and whether the pedometer predicts distance."""
    r2 = F.coalesce(F.when(F.count("*") >= 3, F.greatest(F.regr_r2("steps", "t"), F.lit(0.0))), F.lit(0.0))
    out = df.groupBy("device_id").agg(F.count("*").alias("n"), r2.alias("r2"), F.max("steps").alias("steps"), F.max("metres").alias("metres"))
    stride = F.when(F.col("steps") > 0, F.col("metres") / F.col("steps")).otherwise(0.0)
    out = out.withColumn("stride", stride)
    return out.withColumn("predictive", (F.col("steps") >= 8) & (F.col("r2") >= 0.8) & (F.col("stride") > 0.25) & (F.col("stride") < 1.5)).drop("metres")


def guard_gaps(df: DataFrame, most_gap: float) -> DataFrame:
    """``walked``: distance without the jumps over gaps of more than ``most_gap`` seconds; ``lost_s``: seconds in such gaps so far."""
    w = Window.partitionBy("device_id").orderBy("t", "event_id")
    dt, jump = F.col("t") - F.lag("t").over(w), F.col("d") - F.lag("d").over(w)
    df = df.withColumns({"_dt": dt, "_jump": jump})
    gap = F.col("_dt") > most_gap
    return df.withColumn("walked", F.sum(F.when(gap, 0.0).otherwise(F.coalesce("_jump", F.lit(0.0)))).over(w)).withColumn("lost_s", F.sum(F.when(gap, F.col("_dt")).otherwise(0.0)).over(w)).drop("_dt", "_jump")


def breadcrumbs(df: DataFrame, most_gap: float = 3.0, gate: float = 0.05, apart: float = 5.0) -> DataFrame:
    """(device_id, i, x, y): a walk's crumbs, from rows (device_id, t, event_id, d, heading), d being the metres walked so far.

    A step is taken where more than ``gate`` metres have come since the last one; after a gap of more than ``most_gap``
    seconds what came in it is dropped; a crumb falls every ``apart`` metres from the last crumb, the first at the start.
    Each rule looks back at what the one before it did, so a device's rows are folded in order.
    """
    rows = F.sort_array(F.collect_list(F.struct("t", "event_id", "d", "heading")))
    place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
    zero = F.lit(0.0)
    start = F.struct(zero.alias("base"), F.lit(None).cast("double").alias("t"), zero.alias("x"), zero.alias("y"), place(zero, zero).alias("last"), F.array(place(zero, zero)).alias("crumbs"))

    def step(a, r):
        gap = F.coalesce(r["t"] - a["t"] > most_gap, F.lit(False))
        base = F.when(gap, r["d"]).otherwise(a["base"])
        go = r["d"] - base
        moved = go > gate
        x = F.when(moved, a["x"] + F.sin(F.radians(r["heading"])) * go).otherwise(a["x"])
        y = F.when(moved, a["y"] + F.cos(F.radians(r["heading"])) * go).otherwise(a["y"])
        # A root of squares, as SQL has it: at just the distance a last digit decides.
        dx, dy = x - a["last"]["x"], y - a["last"]["y"]
        falls = moved & (F.sqrt(dx * dx + dy * dy) >= apart)
        return F.struct(F.when(moved, r["d"]).otherwise(base).alias("base"), r["t"].alias("t"), x.alias("x"), y.alias("y"), F.when(falls, place(x, y)).otherwise(a["last"]).alias("last"), F.when(falls, F.concat(a["crumbs"], F.array(place(x, y)))).otherwise(a["crumbs"]).alias("crumbs"))

    out = df.groupBy("device_id").agg(F.aggregate(rows, start, step, lambda a: a["crumbs"]).alias("crumbs"))
    return out.select("device_id", F.posexplode("crumbs").alias("i", "c")).select("device_id", "i", "c.x", "c.y")


# When one is off the route, and when a turn confirms a node.
OFF_ROUTE_DEG, STEADY_DPS, TURN_DEG, TURN_RANGE_M, TURN_SHARE = 60.0, 10.0, 30.0, 120.0, 0.5


def off_route(heading: Column, bearing: Column, still: Column, yaw: Column) -> Column:
    """Whether a calibrated heading is far from the leg's bearing while one moves and does not turn; unknown headings are not."""
    from ..functions.geo import bearing_gap

    return F.coalesce(~still & (F.abs(yaw) < STEADY_DPS) & (bearing_gap(heading, bearing) > OFF_ROUTE_DEG), F.lit(False))


def turn_confirmed(expected: Column, detected: Column, left_m: Column, has_gyro: Column) -> Column:
    """Whether a sensed turn of about the size expected, either way, says that the node ahead is reached."""
    return F.coalesce(has_gyro & (F.abs(expected) >= TURN_DEG) & (left_m <= TURN_RANGE_M) & (F.abs(detected) >= TURN_SHARE * F.abs(expected)), F.lit(False))


def auto_advances(confirmations: Column, paused: Column) -> Column:
    """Whether nodes are passed without asking: after two confirmations, unless it is paused."""
    return (confirmations >= 2) & ~paused


def travel_speed(engine: Column, override: Column, calibrated: Column, arrivals: Column) -> Column:
    """The speed that dead reckoning uses: one set by hand within 0 to 45, else the engine's, held at none before the first arrival where it must be calibrated."""
    return F.when(override.isNotNull(), clamp(override, 0.0, MOST_SPEED)).when(calibrated & (arrivals == 0), 0.0).otherwise(engine)
