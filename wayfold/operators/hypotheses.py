"""Clouds of weighted hypotheses (cid, x, y, w): scoring, pruning, estimates and questions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import bearing_gap
from ..functions.noise import uniform
from ..sources.tables import settled
from .sequences import dtw, dtw_many
from .terrain import BROADCAST_CELLS, sample

# Matcher defaults.
SOFT, MERGE_M, BEAM, PENALTY_CAP, BRANCH_GATE = 0.25, 8.0, 18_000, 5.0, 150.0
BAND = (0.18, 0.82)


def candidate_grid(spark: SparkSession, x0: float, y0: float, x1: float, y1: float, most: int = 15_000, least_m: float = 28.0) -> DataFrame:
    """(cid, x, y) on a square grid of spacing max(28, sqrt(area / 15000))."""
    spacing = max(least_m, ((x1 - x0) * (y1 - y0) / most) ** 0.5)
    nx, ny = int((x1 - x0) / spacing) + 1, int((y1 - y0) / spacing) + 1
    return spark.range(nx * ny).select(F.col("id").alias("cid"), (x0 + F.col("id") % nx * spacing).alias("x"), (y0 + F.floor(F.col("id") / nx) * spacing).alias("y"))


def path_offsets(spark: SparkSession, headings: list[float], step: float) -> DataFrame:
    """(i, dx, dy): where each bin of a walk begins, from its start; the last row is its end."""
    x = np.concatenate([[0.0], np.cumsum(np.sin(np.radians(headings)) * step)])
    y = np.concatenate([[0.0], np.cumsum(np.cos(np.radians(headings)) * step)])
    rows = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(float(a)).alias("dx"), F.lit(float(b)).alias("dy")) for i, (a, b) in enumerate(zip(x, y))])
    return spark.range(1).select(F.inline(rows))


def path_profiles(candidates: DataFrame, headings: list[float], step: float, dem: DataFrame, cols: int, rows: int, cell: float) -> DataFrame:
    """(cid, x, y, profile): heights over the start along the walk from each candidate, up to where it leaves the map."""
    at = path_offsets(candidates.sparkSession, headings, step).where(F.col("i") < len(headings))
    p = candidates.crossJoin(F.broadcast(at)).withColumns({"px": F.col("x") + F.col("dx"), "py": F.col("y") + F.col("dy")})
    p = sample(p, dem, cols, rows, cell, "px", "py")
    listed = F.transform(F.sort_array(F.collect_list(F.struct("i", "h"))), lambda s: s["h"])
    out = p.groupBy("cid", "x", "y").agg(listed.alias("h"), F.min(F.when(F.col("h").isNull(), F.col("i"))).alias("cut"))
    kept = F.slice("h", 1, F.coalesce("cut", F.size("h")))
    return out.select("cid", "x", "y", F.transform(kept, lambda v: v - F.get("h", 0)).alias("profile"))


def normalise(df: DataFrame, score: str = "score", constraint: str = "constraint", by: tuple[str, ...] = ()) -> DataFrame:
    """``w``: score times constraint over their sum; all zero stays zero."""
    raw = F.col(score) * F.col(constraint)
    total = df.groupBy(*by).agg(F.sum(raw).alias("_total"))
    # One row is broadcast; a row for each group is left to the planner.
    df = df.join(total, list(by)) if by else df.crossJoin(F.broadcast(total))
    return df.withColumn("w", F.when(F.col("_total") > 0, raw / F.col("_total")).otherwise(raw)).drop("_total")


def curve_costs(candidates: DataFrame, headings: list[float], step: float, dem: DataFrame, cols: int, rows: int, cell: float, observed: list[float]) -> DataFrame:
    """(cid, x, y, cost, length): the time-warp distance of the observed heights to those along the walk from each candidate, up to where it leaves the map.

    A raster of a checked size goes to every worker, where a batch of candidates is scored at once and nothing is shuffled;
    a larger one is joined (:func:`path_profiles`).
    """
    if cols * rows > BROADCAST_CELLS:
        p = dtw(path_profiles(candidates, headings, step, dem, cols, rows, cell), "profile", observed)
        return p.select("cid", "x", "y", "cost", F.size("profile").alias("length"))
    found = dem.select("gx", "gy", "h").toPandas()
    grid = np.full((rows + 1, cols + 1), np.nan)
    grid[found["gy"], found["gx"]] = found["h"]
    grid[rows], grid[:, cols] = grid[rows - 1], grid[:, cols - 1]  # the far edge repeats its neighbours
    grid[rows, cols] = grid[rows - 1, cols - 1]
    turn = np.radians(headings[:-1] if len(headings) else [])
    dx, dy = (np.concatenate([[0.0], np.cumsum(f(turn) * step)]) for f in (np.sin, np.cos))
    seen = np.array(observed, float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in "xy")
            fx, fy = (x[:, None] + dx) / cell, (y[:, None] + dy) / cell
            inside = (fx >= 0) & (fy >= 0) & (fx <= cols - 1) & (fy <= rows - 1)
            i, j = (np.where(inside, np.floor(f), 0).astype(int) for f in (fx, fy))
            tx, ty = fx - np.floor(fx), fy - np.floor(fy)
            low, high = grid[j, i] + (grid[j, i + 1] - grid[j, i]) * tx, grid[j + 1, i] + (grid[j + 1, i + 1] - grid[j + 1, i]) * tx
            h = np.where(inside, low + (high - low) * ty, np.nan)
            gone = np.isnan(h)
            length = np.where(gone.any(axis=1), gone.argmax(axis=1), h.shape[1])
            cost = np.full(len(x), np.inf)
            for n in np.unique(length[length > 0]):
                own = length == n
                cost[own] = dtw_many(h[own, :n] - h[own, :1], seen)
            yield pa.RecordBatch.from_arrays([batch.column("cid"), pa.array(x), pa.array(y), pa.array(cost), pa.array(length.astype(np.int32))], ["cid", "x", "y", "cost", "length"])

    return candidates.select("cid", "x", "y").mapInArrow(run, "cid long, x double, y double, cost double, length int")


def cumulate(df: DataFrame, order: str, value: str, out: str, parts: int = 64) -> DataFrame:
    """``out``: the running sum of ``value`` in order of the number ``order``, by sums of up to ``parts`` ranges and windows inside them, so that no task sees all rows."""
    edges = df.agg(F.percentile_approx(order, [i / parts for i in range(1, parts)], 1000).alias("_edges"))
    part = F.size(F.filter(F.coalesce("_edges", F.array()), lambda e: F.col(order) > e))
    df = df.crossJoin(F.broadcast(edges)).withColumn("_part", part).drop("_edges")
    sums = df.groupBy("_part").agg(F.sum(value).alias("_sum"))
    before = sums.select("_part", F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    run = F.sum(value).over(Window.partitionBy("_part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return df.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + run).drop("_part", "_before")


def constrain(df: DataFrame, keep: Column, hard: bool) -> DataFrame:
    """Multiply the constraint of hypotheses that contradict an answer by 0 or a quarter."""
    return df.withColumn("constraint", F.when(keep, F.col("constraint")).otherwise(F.col("constraint") * (0.0 if hard else SOFT)))


def summary(df: DataFrame, radius: float) -> DataFrame:
    """One row: weighted mean, spread, effective sample size, share within ``radius`` of the mean, live count."""
    mean = df.agg((F.sum(F.col("x") * F.col("w")) / F.sum("w")).alias("mx"), (F.sum(F.col("y") * F.col("w")) / F.sum("w")).alias("my"), F.max("w").alias("top"), F.sum("w").alias("all"))
    d2 = (F.col("x") - F.col("mx")) ** 2 + (F.col("y") - F.col("my")) ** 2
    return df.crossJoin(F.broadcast(mean)).groupBy("mx", "my").agg(
        F.sqrt(F.sum(F.col("w") * d2) / F.first("all")).alias("spread"), (F.first("all") * F.first("all") / F.sum(F.col("w") * F.col("w"))).alias("ess"),
        (F.sum(F.when(F.sqrt(d2) <= radius, F.col("w")).otherwise(0.0)) / F.first("all")).alias("inside"), F.sum(F.when(F.col("w") > 0.05 * F.col("top"), 1).otherwise(0)).alias("live"),
    )


def coverage_count(clusters: DataFrame, share: float = 0.85) -> DataFrame:
    """n: fewest clusters (cid, w), heaviest first, that hold the share of the weight."""
    run = cumulate(clusters.withColumn("_down", -F.col("w")), "_down", "w", "_r")
    total = clusters.agg(F.sum("w").alias("_t"))
    return run.crossJoin(F.broadcast(total)).agg((F.sum(F.when(F.col("_r") < share * F.col("_t"), 1).otherwise(0)) + 1).alias("n"))


#: Runs of no more live hypotheses than this are clustered in one task each.
TOGETHER = 20_000


def clusters(df: DataFrame, radius: float, run: str = "run", least: float = 0.02, weighted: bool = True, together: int = TOGETHER) -> DataFrame:
    """(run, x, y, w): greedy clusters of each run's hypotheses in order of cid.

    A hypothesis that no cluster has taken begins one and takes all within ``radius``.  Order matters, but only nearby: small runs
    are folded in a task each, their size being counted, and larger ones settled in rounds over cells, with the same result.
    """
    top = df.groupBy(run).agg((F.max("w") * least).alias("_floor"))
    live = settled(df.select(run, "cid", "x", "y", "w").join(top, run).where("w > _floor").drop("_floor"))
    if live.count() > together and live.groupBy(run).count().agg(F.max("count")).first()[0] > together:
        return in_rounds(live, radius, run, weighted)

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("cid")
        x, y, w = (pdf[c].to_numpy(float) for c in ("x", "y", "w"))
        left = np.ones(len(w), bool)
        out = []
        for i in range(len(w)):
            if left[i]:
                hit = left & (np.hypot(x - x[i], y - y[i]) <= radius)
                left &= ~hit
                v = w[hit] if weighted else np.ones(hit.sum())
                out.append((pdf[run].iloc[0], float((x[hit] * v).sum() / v.sum()), float((y[hit] * v).sum() / v.sum()), float(w[hit].sum())))
        return pd.DataFrame(sorted(out, key=lambda r: -r[3]), columns=[run, "x", "y", "w"])

    return live.groupBy(run).applyInPandas(greedy, f"{run} long, x double, y double, w double")


def in_rounds(live: DataFrame, radius: float, run: str = "run", weighted: bool = True) -> DataFrame:
    """The greedy clusters of ``live(run, cid, x, y, w)``, whatever the size of a run.

    A hypothesis begins a cluster as soon as none that comes before it and is still open lies within ``radius``; what lies
    within ``radius`` of one that begins is not open any more.  A cell is so small that its members are all within ``radius`` of each
    other, so only its first open one can begin, and it looks at the cells two around.  When none is open, each joins the first beginning in reach.
    """
    side = radius * 0.7
    cell = lambda c: F.floor(F.col(c) / side)
    each = settled(live.select(run, "cid", "x", "y", "w", cell("x").alias("gx"), cell("y").alias("gy")))
    near = F.array(*(F.struct(F.lit(a).alias("dx"), F.lit(b).alias("dy")) for a in range(-2, 3) for b in range(-2, 3)))

    def reaching(some: DataFrame, name: str) -> DataFrame:
        """Hypotheses listed in the cells that they may reach into."""
        listed = some.select(run, "gx", "gy", F.col("cid").alias(name), F.col("x").alias(f"{name}_x"), F.col("y").alias(f"{name}_y"), F.explode(near).alias("d"))
        return listed.select(run, (F.col("gx") + F.col("d.dx")).alias("gx"), (F.col("gy") + F.col("d.dy")).alias("gy"), name, f"{name}_x", f"{name}_y")

    def within(name: str):
        return F.hypot(F.col("x") - F.col(f"{name}_x"), F.col("y") - F.col(f"{name}_y")) <= radius

    open_, begun = each, None
    while True:
        first = settled(open_.groupBy(run, "gx", "gy").agg(F.min(F.struct("cid", "x", "y")).alias("f")).select(run, "gx", "gy", "f.*"))
        # Those that something open before them reaches wait.
        waits = open_.join(reaching(first, "head"), [run, "gx", "gy"]).where((F.col("cid") < F.col("head")) & within("head")).select(run, F.col("head").alias("cid")).distinct()
        begins = settled(first.join(waits, [run, "cid"], "left_anti"))
        begun = begins if begun is None else begun.unionByName(begins)
        taken = open_.join(reaching(begins, "head"), [run, "gx", "gy"]).where(within("head")).select(run, "cid").distinct()
        open_ = settled(open_.join(taken, [run, "cid"], "left_anti"))
        if open_.isEmpty():
            break
    joined = each.join(reaching(begun, "head"), [run, "gx", "gy"]).where(within("head")).groupBy(run, "cid", "x", "y", "w").agg(F.min("head").alias("head"))
    v = F.col("w") if weighted else F.lit(1.0)
    return joined.groupBy(run, "head").agg((F.sum(F.col("x") * v) / F.sum(v)).alias("x"), (F.sum(F.col("y") * v) / F.sum(v)).alias("y"), F.sum("w").alias("w")).select(run, "x", "y", "w")


def resample(df: DataFrame, n: int, offset: float, jitter: float = 0.0, seed: int = 0) -> DataFrame:
    """(k, cid), with a jitter also (x, y, w): systematic resampling - n evenly spaced picks on the cumulated weights in order of cid.

    Each hypothesis lists its own picks from the interval it covers, so no range join is needed.
    """
    total = df.agg(F.sum("w").alias("_t"))
    df = cumulate(df, "cid", "w", "_run").crossJoin(F.broadcast(total))
    df = df.withColumn("_c", F.col("_run") / F.col("_t")).withColumn("_b", F.col("_c") - F.col("w") / F.col("_t"))
    low, high = F.ceil(F.col("_b") * n - offset), F.ceil(F.col("_c") * n - offset) - 1
    picks = df.where(low <= high).withColumn("k", F.explode(F.sequence(low.cast("int"), high.cast("int")))).where(F.col("k").between(0, n - 1))
    if not jitter:
        return picks.select("k", "cid")
    moved = lambda c, s: F.col(c) + (uniform(s, "k", "cid") * 2 - 1) * jitter
    return picks.select("k", "cid", moved("x", seed).alias("x"), moved("y", seed + 1).alias("y"), F.lit(1.0 / n).alias("w"))


def assess(inside: Column, clusters_n: Column, clustered: Column) -> Column:
    """What a recovery run has come to."""
    return F.when(inside >= 0.6, "located").when(clusters_n.between(2, 3) & (clustered > 0.6), "ambiguous").otherwise("searching")


# Road hypotheses: walkers (a, b, s, logw, e_prev) on directed edges (a, b, ax, ay, bx, by, len).


def seed(edges: DataFrame, spacing: float, keep: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, s, *keep): a walker at half a spacing and every spacing from there along every directed edge, with columns of that."""
    last = F.ceil((F.col("len") - spacing / 2) / spacing) - 1
    return edges.where(F.col("len") > spacing / 2).select("a", "b", *keep, F.explode(F.sequence(F.lit(0), last.cast("int"))).alias("k")).select("a", "b", (spacing / 2 + F.col("k") * spacing).alias("s"), *keep)


def spacing_for(edges: DataFrame, target: int) -> Column:
    """Spacing that gives about ``target`` seeds by the undirected length."""
    return F.greatest(F.lit(12.0), F.sum("len") / 2 / target)


#: A hypothesis takes so many edges in one step, at most; a step is shorter than that many edges.
MOST_POPS = 16
#: Edges whose walkers one task takes, about: of larger graphs there are more tasks, and none is larger.
TASK_EDGES = 50_000


def tasks_for(edges: DataFrame) -> int:
    """Into how many tasks the walkers of a graph are dealt."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // TASK_EDGES))


def advance(walkers: DataFrame, edges: DataFrame, step: float | Column, heading: float, keep: tuple[str, ...] = (), tasks: int | None = None) -> DataFrame:
    """Walkers moved ``step`` metres: those past their edge's end go on along every edge there that does not turn
    back and lies within the gate of the heading, until all have stopped; dead ends vanish.

    step: metres, or for driving a column over the walker's starting edge, such as :func:`driven`.
    keep: columns of the edges that walkers bring from theirs (:func:`seed`, with ``len``, and ``speed`` if edges have one),
    and get from the one that they end on; without it they are joined with their edges first.
    """
    tasks = tasks or tasks_for(edges)
    has_speed = "speed" in edges.columns
    metres = step if isinstance(step, Column) else F.lit(float(step))
    own = [c for c in keep if c not in ("len", "speed")]
    start = edges.select("a", "b", "len", *([F.col("speed").alias("_speed")] if has_speed else []))
    # So many junctions a step can pass at most: the longest step over the shortest edge.
    longest, shortest = start.agg(F.max(metres), F.min("len")).first()
    hops = 0 if longest is None else min(MOST_POPS, int(longest / max(shortest, 1e-9)) + 1)
    if not keep:
        now = walkers.join(start, ["a", "b"])
    else:
        now = walkers.withColumnRenamed("speed", "_speed") if has_speed else walkers
    now = now.withColumn("s", F.col("s") + metres).drop("_speed")
    # Edges by the node that they leave, in the same tasks as the walkers who come there.
    e = edges.select(*(F.col(c).alias(f"_{c}") for c in ("a", "b", "len", "bearing")), *(F.col(c).alias(f"_to_{c}") for c in own)).repartition(tasks, "_a")
    done = now.where("s <= len")
    for hop in range(hops):
        on = now.where("s > len").drop(*own).withColumnRenamed("len", "_old").repartition(tasks, "b")
        on = on.join(e, (F.col("b") == F.col("_a")) & (F.col("_b") != F.col("a"))).where(bearing_gap(F.col("_bearing"), F.lit(heading)) <= BRANCH_GATE)
        now = on.withColumns({"s": F.col("s") - F.col("_old"), "a": F.col("_a"), "b": F.col("_b"), "len": F.col("_len"), **{c: F.col(f"_to_{c}") for c in own}})
        now = now.select(*done.columns)
        now = settled(now) if hop % 4 == 3 else now
        done = done.unionByName(now.where("s <= len"))
    return done if "len" in keep else done.drop("len")


def counted(walkers: DataFrame, tasks: int) -> DataFrame:
    """(a, b, s, n): how many walkers stand at each place; those of an edge meet in one task, and counts are made there alone."""
    return walkers.select("a", "b", "s").repartition(tasks, "a", "b").groupBy("a", "b", "s").agg(F.count("*").alias("n"))


def driven(seconds: float, scale: float = 1.0, default: float = 13.0) -> Column:
    """Metres that a walker drives at the speed of the edge it starts from."""
    return F.coalesce("_speed", F.lit(default)) * scale * seconds


def score(walkers: DataFrame, edges: DataFrame, heading: float, climb: float, sigma_h: float, sigma_s: float, height: str = "h") -> DataFrame:
    """logw less a capped penalty for heading and climb; off the map only the heading counts and e_prev stays. Walkers may bring their edge's bearing."""
    df = walkers if "bearing" in walkers.columns else walkers.join(edges.select("a", "b", "bearing"), ["a", "b"])
    gap = bearing_gap(F.col("bearing"), F.lit(heading))
    off = F.coalesce((F.col(height) - F.col("e_prev") - climb) ** 2 / (2 * sigma_s**2), F.lit(0.0))
    df = df.withColumn("logw", F.col("logw") - F.least(gap * gap / (2 * sigma_h**2) + off, F.lit(PENALTY_CAP)))
    return df.withColumn("e_prev", F.coalesce(height, "e_prev")).drop("bearing", height)


def merge_and_prune(walkers: DataFrame, beam: int = BEAM, tasks: int | None = None) -> DataFrame:
    """The best walker of each edge and ``MERGE_M`` metres, and of those the ``beam`` best; if ``tasks`` is given, the walkers are dealt to that many by their edges."""
    if tasks:
        walkers = walkers.repartition(tasks, "a", "b")
    bucket = F.round(F.col("s") / MERGE_M)
    best = walkers.groupBy("a", "b", bucket.alias("_k")).agg(F.max_by(F.struct("s", "logw", "e_prev"), F.struct("logw", -F.col("s"))).alias("v"))
    return best.select("a", "b", "v.*").orderBy(F.desc("logw"), "a", "b", "s").limit(beam)


def walk_end(bins: DataFrame, keys: list[str], step: float) -> DataFrame:
    """(keys, dx, dy): where a walk of bins (keys, i, heading) ends, from its start."""
    r = F.radians("heading")
    return bins.groupBy(*keys).agg(F.sum(F.sin(r) * step).alias("dx"), F.sum(F.cos(r) * step).alias("dy"))


def curve_score(adherence: Column, cost: Column, length: Column, observed: int, sigma: float = 5.0, sharpness: float = 4.0) -> Column:
    """A candidate's score against the whole curve: how well it keeps to roads, to a power, times the likelihood of its heights; a curve that leaves the map early scores 0.

    adherence: null where there are no roads to keep to.  A curve of fewer than three heights is scored by roads alone.
    """
    heights = F.lit(1.0) if observed < 3 else F.when(length < max(2, observed // 2), 0.0).otherwise(F.exp(-cost * cost / (2 * sigma * sigma)))
    return F.pow(F.coalesce(adherence, F.lit(1.0)), F.lit(sharpness)) * heights


def weigh_by_roads(cloud: DataFrame, fit: DataFrame, sharpness: float) -> DataFrame:
    """Weights times adherence ``fit(cid, adherence)`` to a power, rescaled."""
    fits = cloud.join(fit, "cid", "left").withColumns({"score": F.col("w"), "constraint": F.pow(F.coalesce("adherence", F.lit(0.0)), F.lit(sharpness))})
    return normalise(fits).drop("adherence", "score", "constraint")


# When a walk is too flat to tell anything, and the recovery engine's radii.
FLAT_VARIANCE, LOCK_M, CLUSTER_M, MOST_CLUSTERS = 1.0, 120.0, 120.0, 3


def recovery_step(cloud: DataFrame, fit: DataFrame, variance: float, jitter: float = 8.0, seed: int = 1, impossible: Column | None = None) -> tuple[DataFrame, str]:
    """The cloud (cid, x, y, w) after one observation and what it has come to: ``fit(cid, likelihood)`` weighs it, and it is resampled when fewer than half of it count.

    A flat walk (``variance`` of its heights) changes nothing.  impossible: places (by x and y) that resampling may not move into.
    """
    if variance < FLAT_VARIANCE:
        return cloud, "flatline"
    weighed = cloud.join(fit, "cid", "left").withColumns({"score": F.col("w"), "constraint": F.coalesce("likelihood", F.lit(0.0))})
    now = settled(normalise(weighed).select("cid", "x", "y", "w"))
    n, ess = now.agg(F.count("*"), F.sum("w") * F.sum("w") / F.sum(F.col("w") * F.col("w"))).first()
    if ess is not None and ess < n / 2:
        now = settled(resampled(now, n, jitter, seed, impossible))
    return now, state(now)


def resampled(cloud: DataFrame, n: int, jitter: float, seed: int, impossible: Column | None = None) -> DataFrame:
    """A cloud of n even hypotheses; those moved into impossible places weigh nothing, unless all are."""
    new = resample(cloud, n, 0.5, jitter, seed).select(F.col("k").cast("long").alias("cid"), "x", "y", "w")
    if impossible is None:
        return new
    masked = normalise(new.withColumns({"score": F.col("w"), "constraint": F.when(impossible, 0.0).otherwise(1.0)})).select("cid", "x", "y", "w")
    return masked


def state(cloud: DataFrame) -> str:
    """located, ambiguous or searching."""
    inside = summary(cloud, LOCK_M).select("inside").first()
    areas = [r["w"] for r in clusters(cloud.withColumn("run", F.lit(0).cast("long")), CLUSTER_M).select("w").collect()]
    if not areas:
        return "searching"
    told = cloud.sparkSession.range(1).select(assess(F.lit(inside["inside"]), F.lit(len(areas)), F.lit(sum(areas[:MOST_CLUSTERS])))).first()[0]
    return told


def interrogated(cloud: DataFrame, keep: Column, hard: bool, jitter: float = 8.0, seed: int = 1) -> DataFrame:
    """The cloud after a person's answer: what contradicts it is weakened or goes, and the cloud is resampled."""
    n = cloud.count()
    now = normalise(constrain(cloud.withColumns({"score": F.col("w"), "constraint": F.lit(1.0)}), keep, hard)).select("cid", "x", "y", "w")
    return resampled(now, n, jitter, seed)


def possible(cloud: DataFrame, surface: str, in_water: DataFrame, in_area: DataFrame | None = None, on_road: DataFrame | None = None) -> DataFrame:
    """Hypotheses that a surface allows: never in water; on ``road`` only near a road, ``offroad`` only away from roads; in the search area where there is one.

    in_water, in_area, on_road: the cid of hypotheses in each.
    """
    out = cloud.join(in_water.select("cid"), "cid", "left_anti")
    if in_area is not None:
        out = out.join(in_area.select("cid"), "cid", "left_semi")
    if on_road is not None and surface != "any":
        out = out.join(on_road.select("cid"), "cid", "left_semi" if surface == "road" else "left_anti")
    return out


def as_cloud(df: DataFrame, cid: str = "cid", x: str = "x", y: str = "y", weight: Column | None = None, log_weight: str | None = None) -> DataFrame:
    """Any matcher's hypotheses as a cloud (cid, x, y, w) whose weights add up to one."""
    if log_weight is not None:
        top = df.agg(F.max(log_weight).alias("_top"))
        df = df.crossJoin(F.broadcast(top)).withColumn("_w", F.exp(F.col(log_weight) - F.col("_top")))
        weight = F.col("_w")
    even = df.select(F.col(cid).cast("long").alias("cid"), F.col(x).alias("x"), F.col(y).alias("y"), (weight if weight is not None else F.lit(1.0)).alias("score"), F.lit(1.0).alias("constraint"))
    return normalise(even).select("cid", "x", "y", "w")


def best_split(answers: DataFrame) -> DataFrame:
    """(q, share) of the question (q, yes, w) whose yes share of the weight is nearest one half, within the band; first of equals."""
    share = F.sum(F.when(F.col("yes"), F.col("w")).otherwise(0.0)) / F.sum("w")
    asked = answers.groupBy("q").agg(share.alias("share")).where(F.col("share").between(*BAND))
    return asked.orderBy(F.round(F.abs(F.col("share") - 0.5), 9), "q").limit(1)


def even_question(answers: DataFrame) -> DataFrame:
    """(q, score) of the question that leaves the most on its smaller side, one at least; first of equals."""
    yes, no = F.sum(F.col("yes").cast("int")), F.sum((~F.col("yes")).cast("int"))
    return answers.groupBy("q").agg(F.least(yes, no).alias("score")).where("score >= 1").orderBy(F.desc("score"), "q").limit(1)


def without_repeats(bank: DataFrame) -> DataFrame:
    """Questions (q, text), the first of each text."""
    return bank.groupBy("text").agg(F.min("q").alias("q")).select("q", "text")
