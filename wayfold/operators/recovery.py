"""Recovery from a lost position: particles, masks, questions asked in turn, and guidance back."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.geo import METRES_PER_DEGREE
from ..functions.noise import uniform
from ..sources.tables import settled
from .hypotheses import BAND, SOFT, cumulate, normalise

# How far named things may be confirmed, and the lock's share.
CONFIRM_M, REJECT_M, LOCK_SHARE = 70.0, 300.0, 0.80


def scatter(spark: SparkSession, n: int, cx: float, cy: float, radius: float, seed: int, impossible: Callable[[Column, Column], Column] | None = None, tries: int = 8) -> DataFrame:
    """(cid, x, y, w): uniform in a disc; of ``tries`` draws the first that is possible, else the last."""
    return scattered(spark.range(n).withColumnRenamed("id", "cid"), F.lit(cx), F.lit(cy), radius, seed, impossible, tries).withColumn("w", F.lit(1.0 / n))


def scattered(df: DataFrame, cx: Column, cy: Column, radius: float, seed: int, impossible: Callable[[Column, Column], Column] | None = None, tries: int = 8) -> DataFrame:
    """(cid, x, y): a place in the disc about (cx, cy) for each row of ``df(cid ...)``, the same in every run."""
    spots = []
    for k in range(tries):
        r, a = F.sqrt(uniform(seed + 2 * k, "cid")) * radius, uniform(seed + 2 * k + 1, "cid") * (2 * np.pi)
        df = df.withColumns({f"_x{k}": cx + r * F.cos(a), f"_y{k}": cy + r * F.sin(a)})
        spots.append(F.struct(F.col(f"_x{k}").alias("x"), F.col(f"_y{k}").alias("y")))
    pick = spots[-1]
    for k in reversed(range(tries - 1)):
        ok = ~impossible(F.col(f"_x{k}"), F.col(f"_y{k}")) if impossible else F.lit(True)
        pick = F.when(ok, spots[k]).otherwise(pick)
    return df.select("cid", pick.alias("p")).select("cid", "p.x", "p.y")


def mask(df: DataFrame, impossible: Column) -> DataFrame:
    """Zero the weight of impossible hypotheses and rescale; unchanged if that would leave none."""
    left = F.when(impossible, 0.0).otherwise(F.col("w"))
    total = df.agg(F.sum(left).alias("_left"))
    return df.crossJoin(F.broadcast(total)).withColumn("w", F.when(F.col("_left") > 0, left / F.col("_left")).otherwise(F.col("w"))).drop("_left")


def stride(df: DataFrame, most: int) -> DataFrame:
    """Every k-th hypothesis in order of cid, k such that about ``most`` stay."""
    n = df.count()
    if n <= most:
        return df
    k = -(-n // most)
    return cumulate(df.withColumn("_one", F.lit(1)), "cid", "_one", "_r").where((F.col("_r") - 1) % k == 0).drop("_r", "_one")


def confirm_named(df: DataFrame, x: float, y: float) -> DataFrame:
    """Keep hypotheses close to a named place that was recognised."""
    return df.where(F.hypot(F.col("x") - x, F.col("y") - y) <= CONFIRM_M)


def reject_lock(df: DataFrame, x: float, y: float) -> DataFrame:
    """Drop hypotheses around a lock that was wrong."""
    return df.where(F.hypot(F.col("x") - x, F.col("y") - y) > REJECT_M)


def softened(df: DataFrame, keep: Column, soft: float) -> DataFrame:
    """Road hypotheses after an answer: contradicted ones go, or lose log weight."""
    return df.where(keep) if soft <= 0 else df.withColumn("logw", F.when(keep, F.col("logw")).otherwise(F.col("logw") + float(np.log(soft))))


def softmax_lead(df: DataFrame, radius: float) -> DataFrame:
    """One row: the likeliest road hypothesis and the share of the mass around it."""
    lead = df.agg(F.max_by(F.struct("x", "y"), F.struct("logw", -F.col("x"), -F.col("y"))).alias("l"), F.max("logw").alias("top"))
    mass = F.exp(F.col("logw") - F.col("top"))
    near = F.hypot(F.col("x") - F.col("l.x"), F.col("y") - F.col("l.y")) <= radius
    return df.crossJoin(F.broadcast(lead)).groupBy(F.col("l.x").alias("x0"), F.col("l.y").alias("y0")).agg((F.sum(F.when(near, mass).otherwise(0.0)) / F.sum(mass)).alias("concentration"))


def ask(cloud: DataFrame, questions: dict[str, Column], answer: Callable[[str], bool], most: int = 16, least: int = 1, hard: bool = False) -> tuple[DataFrame, list[tuple[str, bool, float]]]:
    """Ask until the cloud is locked: (cloud, [(question, answer, share of weight within 120 m of the lead)]).

    Each round is one aggregate over the cached cloud: the yes share of every question left.  The one nearest
    one half, within the band, is asked; hypotheses that contradict the answer are weakened.
    """
    cloud, left, log = cloud.withColumns({"score": F.col("w"), "constraint": F.lit(1.0)}), dict(questions), []
    while left and len(log) < most:
        cloud = cloud.cache()
        row = cloud.agg(*[F.sum(F.when(c, F.col("w")).otherwise(0.0)).alias(q) for q, c in left.items()], F.sum("w").alias("_all"), F.max_by(F.struct("x", "y"), F.struct("w", -F.col("cid"))).alias("_lead")).first()
        lead = row["_lead"]
        held = cloud.agg(F.sum(F.when(F.hypot(F.col("x") - lead["x"], F.col("y") - lead["y"]) <= 120, F.col("w")).otherwise(0.0))).first()[0] / (row["_all"] or 1.0)
        if len(log) >= least and held >= LOCK_SHARE:
            break
        share = {q: row[q] / row["_all"] for q in left if row["_all"]}
        fit = [q for q in share if BAND[0] <= share[q] <= BAND[1]]
        if not fit:
            break
        q = min(fit, key=lambda k: abs(share[k] - 0.5))
        said = answer(q)
        keep = left.pop(q)
        cloud = cloud.withColumn("constraint", F.when(keep if said else ~keep, F.col("constraint")).otherwise(F.col("constraint") * (0.0 if hard else SOFT)))
        cloud = normalise(cloud)
        log.append((q, said, held))
    return cloud, log


def nearest_node(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """(pid, node, dist): the nearest node (node, x, y) within ``reach``, the first of equals; on cells of that size."""
    from .spatial import nearest_feature

    found = nearest_feature(points, nodes.select(F.col("node").alias("fid"), "x", "y"), reach)
    return found.select("pid", F.col("fid").alias("node"), "dist")


def nearest_node_anywhere(points: DataFrame, nodes: DataFrame, reach: float) -> DataFrame:
    """The same however far the node is: the reach grows for the points that have found none, until it spans all."""
    ends = [f.agg(F.min("x"), F.max("x"), F.min("y"), F.max("y")).first() for f in (points, nodes)]
    if any(e[0] is None for e in ends):
        return nearest_node(points, nodes, reach)
    wide = sum(max(e[k + 1] for e in ends) - min(e[k] for e in ends) for k in (0, 2))
    left, done = points, None
    while True:
        found = settled(nearest_node(left, nodes, reach))
        done = found if done is None else done.unionByName(found)
        left = settled(left.join(found.select("pid"), "pid", "left_anti"))
        if reach > wide or left.isEmpty():
            return done
        reach *= 4


def retrace(crumbs: DataFrame, here: DataFrame, back_m: float = 20.0) -> DataFrame:
    """(device_id, i, left_m, target): the crumb nearest to where one is, the way left along the path, and the crumb to head for."""
    w = Window.partitionBy("device_id").orderBy("i")
    step = F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w))
    c = crumbs.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("m", F.sum("_s").over(w)).drop("_s")
    near = c.join(here, "device_id").groupBy("device_id").agg(F.min_by(F.struct("i", "m"), F.struct(F.hypot(F.col("x") - F.col("hx"), F.col("y") - F.col("hy")), "i")).alias("n"))
    back = c.join(near, "device_id").where(F.col("m") <= F.greatest(F.col("n.m") - back_m, F.lit(0.0)))
    return back.groupBy("device_id").agg(F.first("n").alias("n"), F.max("i").alias("target")).select("device_id", "n.i", F.col("n.m").alias("left_m"), "target")


def expected_climb(route: DataFrame) -> DataFrame:
    """``climb``: change of height since the node before; places off the map count as 0."""
    h = F.coalesce("h", F.lit(0.0))
    return route.withColumn("climb", h - F.lag(h).over(Window.partitionBy("route").orderBy("seq")))


def padded_box(path: DataFrame, pad: float = 0.005) -> DataFrame:
    """South, west, north and east of each path with a margin in degrees."""
    return path.groupBy("route").agg((F.min("lat") - pad).alias("s"), (F.min("lon") - pad).alias("w"), (F.max("lat") + pad).alias("n"), (F.max("lon") + pad).alias("e"))


def expanded(boxes: DataFrame, s: float, w: float, n: float, e: float) -> DataFrame:
    """Boxes of paths with the map's box: their union where the path's middle lies in the map, else the path's own."""
    inside = ((F.col("s") + F.col("n")) / 2).between(s, n) & ((F.col("w") + F.col("e")) / 2).between(w, e)
    both = {"s": F.least("s", F.lit(s)), "w": F.least("w", F.lit(w)), "n": F.greatest("n", F.lit(n)), "e": F.greatest("e", F.lit(e))}
    return boxes.select("route", *[F.when(inside, v).otherwise(F.col(k)).alias(k) for k, v in both.items()])


def landmarks(edges: DataFrame) -> DataFrame:
    """(u, degree, kind): dead ends and intersections of the graph taken both ways."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    d = both.groupBy("u").agg(F.count("*").alias("degree"))
    return d.withColumn("kind", F.when(F.col("degree") >= 3, "intersection").when(F.col("degree") == 1, "dead_end"))


def metres(df: DataFrame, lat0: float, lon0: float) -> DataFrame:
    """x and y in metres about an origin."""
    return df.withColumns({"x": (F.col("lon") - lon0) * METRES_PER_DEGREE * F.cos(F.radians(F.lit(lat0))), "y": (F.col("lat") - lat0) * METRES_PER_DEGREE})


# How much weaker a contradicted hypothesis gets, by the kind of question.
SOFT_NAMED, SOFT_PLAIN = 0.02, 0.2


class Interview:
    """A recovery session over road hypotheses (cid, x, y, logw): what was asked, and the cloud that is left.

    ``answer`` weakens what contradicts; ``skip`` only puts the question aside; ``reset`` and ``start`` go back to a cloud.
    """

    def __init__(self, cloud: DataFrame) -> None:
        self.start(cloud)

    def start(self, cloud: DataFrame) -> None:
        self.first = self.cloud = settled(cloud)
        self.asked: list[tuple[str, bool | None]] = []

    def reset(self) -> None:
        self.cloud, self.asked = self.first, []

    def skip(self, question: str) -> None:
        self.asked.append((question, None))

    def answer(self, question: str, yes: bool, holds: DataFrame, named: bool = False) -> None:
        """holds: (cid, yes) of every hypothesis."""
        told = self.cloud.join(holds.select("cid", "yes"), "cid", "left").withColumn("yes", F.coalesce("yes", F.lit(False)))
        self.cloud = settled(softened(told, F.col("yes") == yes, SOFT_NAMED if named else SOFT_PLAIN).drop("yes"))
        self.asked.append((question, yes))

    def open(self, bank: DataFrame) -> DataFrame:
        """The questions (q, ...) not yet asked or put aside."""
        return bank.where(~F.col("q").isin(*[q for q, _ in self.asked])) if self.asked else bank


def meander(starts: DataFrame, height: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float, steps: int, most_grade: float = 0.35) -> DataFrame:
    """(walk, i, x, y, heading): off-trail walks that weigh seven turns by grade; the walks of a batch step together, each by its own draws."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if not len(pdf):
                continue
            x, y, h = _drawn(pdf["x"].to_numpy(float), pdf["y"].to_numpy(float), pdf["seed"].to_numpy(), height, step, steps, most_grade)
            yield _rows({"walk": pdf["walk"].to_numpy()}, x, y, h)

    return starts.select("walk", "x", "y", "seed").mapInPandas(some, "walk long, i int, x double, y double, heading double")


def _drawn(x: np.ndarray, y: np.ndarray, seed: np.ndarray, height: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float, steps: int, most_grade: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places and headings of meanders, a row for each walk and a column for each of its points."""
    rngs = [np.random.default_rng(int(s)) for s in seed]
    h = np.array([r.uniform(0, 360) for r in rngs])
    turns = np.stack([r.normal(0, 25, (steps, 7)) for r in rngs])
    draws = np.stack([r.uniform(0, 1, steps) for r in rngs])
    out = []
    for i in range(steps):
        out.append((x, y, h))
        turn = (h[:, None] + turns[:, i]) % 360
        nx, ny = x[:, None] + np.sin(np.radians(turn)) * step, y[:, None] + np.cos(np.radians(turn)) * step
        grade = np.abs(height(nx, ny) - height(x, y)[:, None]) / step
        p = np.cumsum(np.exp(-((grade / most_grade) ** 2)) + 1e-9, axis=1)
        k = np.minimum((p < draws[:, i, None] * p[:, -1:]).sum(axis=1), 6)
        at = np.arange(len(k))
        x, y, h = nx[at, k], ny[at, k], turn[at, k]
    return tuple(np.stack(c, axis=1) for c in zip(*out))


def _rows(keys: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray, h: np.ndarray) -> pd.DataFrame:
    """Walks as rows, with the keys of each."""
    n = x.shape[1]
    return pd.DataFrame({k: np.repeat(v, n) for k, v in keys.items()} | {"i": np.tile(np.arange(n, dtype=np.int32), len(x)), "x": x.ravel(), "y": y.ravel(), "heading": h.ravel()})


# Tries for each terrain walk, and the climb that one may take.
TERRAIN_TRIES, CLIMB_BUDGET_M = 25, 500.0
#: So many walks are drawn as arrays at a time.
TERRAIN_TOGETHER = 1000


def terrain_walks(starts: DataFrame, height: Callable[[np.ndarray, np.ndarray], np.ndarray], step: float, steps: int, most_grade: float, x1: float, y1: float) -> DataFrame:
    """(walk, attempt, i, x, y, heading): of ``TERRAIN_TRIES`` meanders from each of ``starts(walk, x, y, seed)`` the first that stays on the map (0 to x1, 0 to y1) and within the climb budget and the grade; none if all fail."""

    def some(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), TERRAIN_TOGETHER):
                left = batch.iloc[at : at + TERRAIN_TOGETHER]
                # Only walks that have not come off yet are tried again, and only those that do are rows.
                for attempt in range(TERRAIN_TRIES):
                    if not len(left):
                        break
                    x, y, h = _drawn(left["x"].to_numpy(float), left["y"].to_numpy(float), left["seed"].to_numpy() * TERRAIN_TRIES + attempt, height, step, steps, most_grade)
                    climb = np.diff(height(x, y), axis=1)
                    inside = ((x >= 0.0) & (x <= x1) & (y >= 0.0) & (y <= y1)).all(axis=1)
                    good = inside & (np.maximum(climb, 0.0).sum(axis=1) <= CLIMB_BUDGET_M) & (np.abs(climb).max(axis=1, initial=0.0) <= most_grade * step)
                    if good.any():
                        done = left["walk"].to_numpy()[good]
                        yield _rows({"walk": done, "attempt": np.full(len(done), attempt, np.int32)}, x[good], y[good], h[good])
                    left = left[~good]

    # A small table is one partition: its starts are dealt to all cores.
    dealt = starts.select("walk", "x", "y", "seed").repartition(4 * starts.sparkSession.sparkContext.defaultParallelism, "walk")
    return dealt.mapInPandas(some, "walk long, attempt int, i int, x double, y double, heading double")
