"""Walk generation, walk sessions and whole-walk matching: sequential by nature, in Arrow batches or groups of an area's walks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: name -> (corners, closed); the zigzag is open.
OUTLINES = {
    "triangle": ([(0.0, 0.0), (1.0, 0.0), (0.5, math.sqrt(3) / 2)], True),
    "square": ([(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], True),
    "rectangle": ([(0.0, 0.0), (2.0, 0.0), (2.0, 1.0), (0.0, 1.0)], True),
    "circle": ([(math.cos(2 * math.pi * i / 240), math.sin(2 * math.pi * i / 240)) for i in range(240)], True),
}


def zigzag(angle: float = 30.0, legs: int = 6) -> list[tuple[float, float]]:
    a = math.radians(min(89.0, max(1.0, angle)))
    return [(k * math.cos(a), math.sin(a) if k % 2 else 0.0) for k in range(legs + 1)]


def outlines(spark: SparkSession, angle: float = 30.0) -> DataFrame:
    """(shape, i, x, y) of every outline, closed ones back at their start."""
    rows = [(name, i, float(x), float(y)) for name, (pts, closed) in OUTLINES.items() for i, (x, y) in enumerate([*pts, pts[0]] if closed else pts)]
    rows += [("zigzag", i, float(x), float(y)) for i, (x, y) in enumerate(zigzag(angle))]
    return spark.createDataFrame(rows, "shape string, i int, x double, y double")


def placed(outline: DataFrame, placements: DataFrame, perimeter: float) -> DataFrame:
    """(shape, pid, i, x, y): each outline scaled to a length, turned and moved so that its middle is at each placement (pid, cx, cy, turn)."""
    from pyspark.sql import Window

    w = Window.partitionBy("shape").orderBy("i")
    step = outline.withColumn("_s", F.hypot(F.col("x") - F.lag("x").over(w), F.col("y") - F.lag("y").over(w)))
    # A row for each shape.
    size = step.groupBy("shape").agg(F.sum("_s").alias("_len"), F.avg("x").alias("_mx"), F.avg("y").alias("_my"))
    # Outlines are a constant few hundred points; placements may be many.
    # Each shape is scaled once and each placement's turn taken once, not for every pair.
    k = perimeter / F.col("_len")
    scaled = outline.join(size, "shape").select("shape", "i", ((F.col("x") - F.col("_mx")) * k).alias("_dx"), ((F.col("y") - F.col("_my")) * k).alias("_dy"))
    turned = placements.select("pid", "cx", "cy", F.cos(F.radians("turn")).alias("_cos"), F.sin(F.radians("turn")).alias("_sin"))
    p, dx, dy, cos, sin = turned.crossJoin(F.broadcast(scaled)), *(F.col(c) for c in ("_dx", "_dy", "_cos", "_sin"))
    return p.select("shape", "pid", "i", (F.col("cx") + dx * cos - dy * sin).alias("x"), (F.col("cy") + dx * sin + dy * cos).alias("y"))


def _by_area(walks: DataFrame, edges: DataFrame, fold, schema: str, lanes: int = 8) -> DataFrame:
    """Walks (area, walk ...) with the graph of their area (area, a, b ...), both dealt by area: ``fold(walks, edges)``.

    An area's walks are spread over ``lanes`` groups, each of which gets the area's graph; no graph passes through the driver.
    """
    w = walks.withColumn("_lane", F.pmod(F.xxhash64("walk"), F.lit(lanes)).cast("int"))
    e = edges.withColumn("_lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    return w.groupBy("area", "_lane").cogroup(e.groupBy("area", "_lane")).applyInPandas(fold, schema)


def _adjacency(edges: pd.DataFrame) -> dict[int, list[tuple[int, float]]]:
    out: dict[int, list[tuple[int, float]]] = {}
    for a, b, m in edges[["a", "b", "len"]].sort_values(["a", "b"]).itertuples(index=False):
        out.setdefault(int(a), []).append((int(b), float(m)))
    return out


def random_walks(starts: DataFrame, edges: DataFrame, least_m: float, style: str = "plain", most_steps: int = 400, tries: int = 14) -> DataFrame:
    """(area, walk, i, node) from ``starts(area, walk, node, seed)`` over ``edges(area, a, b, len)``.

    ``plain`` never turns straight back unless it must; ``avoiding`` prefers nodes not yet seen;
    ``trail`` uses no edge twice and is tried again with other draws when it gets stuck.
    """

    def walk(adj: dict, node: int, rng: np.random.Generator) -> tuple[list[int], float]:
        path, metres, used, before = [node], 0.0, set(), None
        for _ in range(most_steps):
            if metres >= least_m:
                break
            here = path[-1]
            ahead = adj.get(here, [])
            if style == "trail":
                ahead = [(b, m) for b, m in ahead if (min(here, b), max(here, b)) not in used]
                alive = [(b, m) for b, m in ahead if any((min(b, c), max(b, c)) not in used and c != here for c, _ in adj.get(b, []))]
                ahead = alive or ahead
            else:
                onward = [(b, m) for b, m in ahead if b != before]
                if style == "avoiding":
                    onward = [x for x in onward if x[0] not in path] or onward
                ahead = onward or ahead
            if not ahead:
                break
            b, m = ahead[rng.integers(len(ahead))]
            used.add((min(here, b), max(here, b)))
            before = here
            path.append(b)
            metres += m
        return path, metres

    def some(starts: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        adj, out = _adjacency(edges), []
        for r in starts.itertuples():
            rng = np.random.default_rng(int(r.seed))
            best: tuple[list[int], float] = ([int(r.node)], 0.0)
            for _ in range(tries if style == "trail" else 1):
                best = max(best, walk(adj, int(r.node), rng), key=lambda x: x[1])
                if best[1] >= least_m:
                    break
            out += [(r.area, r.walk, i, n) for i, n in enumerate(best[0])]
        return pd.DataFrame(out, columns=["area", "walk", "i", "node"])

    return _by_area(starts, edges, some, "area long, walk long, i int, node long")


ATTEMPTS = 12


def generate(starts: DataFrame, edges: DataFrame, places: DataFrame, least_m: float, style: str = "trail", least_turns: int = 0) -> DataFrame:
    """(area, walk, attempt, i, node): for each of ``starts(area, walk, node, seed)`` at a node of two edges or more the first of ``ATTEMPTS`` walks that no other has drawn and that turns ``least_turns`` times.

    A set of edges that several drew belongs to the least (walk, attempt); ``places(area, node, x, y)`` tells turns.
    """
    from .report import coverage

    busy = edges.groupBy("area", F.col("a").alias("node")).agg(F.countDistinct("b").alias("_d")).where("_d >= 2").select("area", "node")
    tried = starts.join(busy, ["area", "node"], "left_semi").withColumn("attempt", F.explode(F.sequence(F.lit(0), F.lit(ATTEMPTS - 1))))
    tried = tried.select("area", (F.col("walk") * ATTEMPTS + F.col("attempt")).alias("walk"), "node", (F.col("seed") * ATTEMPTS + F.col("attempt")).alias("seed"))
    drawn = distinct_walks(random_walks(tried, edges, least_m, style))
    turns = coverage(drawn.join(places, ["area", "node"])).where(F.col("turns") >= least_turns).select("walk")
    first = turns.groupBy(F.floor(F.col("walk") / ATTEMPTS).alias("_w")).agg(F.min("walk").alias("walk"))
    return drawn.join(first, "walk").select("area", F.col("_w").alias("walk"), (F.col("walk") % ATTEMPTS).cast("int").alias("attempt"), "i", "node")


def distinct_walks(walks: DataFrame) -> DataFrame:
    """Walks whose sets of edges differ: of equal ones the first stays."""
    from pyspark.sql import Window

    before = F.lag("node").over(Window.partitionBy("walk").orderBy("i"))
    step = walks.withColumn("_b", before).where(F.col("_b").isNotNull())
    key = step.groupBy("walk").agg(F.array_sort(F.collect_set(F.struct(F.least("node", "_b"), F.greatest("node", "_b")))).alias("edges"))
    first = key.groupBy("edges").agg(F.min("walk").alias("walk")).select("walk")
    return walks.join(first, "walk", "left_semi")


def observe(bins: DataFrame, seed: int = 7, height_m: float = 0.5, heading_deg: float = 4.0) -> DataFrame:
    """Sensor noise on (walk, i, heading, climb) of a walk's bins: of one seed and bin the same in every run, however the rows are dealt."""
    from ..functions.noise import gauss

    return bins.withColumn("heading", F.pmod(F.col("heading") + gauss(seed, "walk", "i") * heading_deg, F.lit(360.0))).withColumn("climb", F.col("climb") + gauss(seed + 1, "walk", "i") * height_m)


#: A session's state before its first tick: leg, speed, metres done on the leg, when it was entered, time of the last tick.
BEGIN = (0, 11.0, 0.0, None, None)


def tick(state: tuple, t: float, moving: bool, still: bool, answer: str | None, lengths: list[float]) -> tuple[tuple, tuple | None]:
    """A session's state after a tick, and the event (kind, leg, speed) that the tick brings about, if any."""
    leg, speed, done, entered, last = state
    entered = t if entered is None else entered
    dt = 0.0 if last is None else t - last
    if answer != "arrive":
        if answer == "deny":
            done = max(0.0, lengths[leg] - speed)
        if moving:
            done = min(done + speed * dt, lengths[leg])
    if answer == "arrive" or (still and lengths[leg] - done <= 50.0 and t - entered >= 3.0):
        speed = min(45.0, max(1.0, 0.7 * speed + 0.3 * (lengths[leg] / max(t - entered, 3.0))))
        kind = "destination" if leg + 1 == len(lengths) else "arrived" if answer == "arrive" else "snapped"
        return (leg + 1, speed, 0.0, t, t), (kind, leg + 1, speed)
    return (leg, speed, done, entered, t), ("prompt", leg + 1, speed) if done >= lengths[leg] else None


def session(ticks: DataFrame) -> DataFrame:
    """(route, t, event, leg, speed): arrivals, prompts and the end of each route's session.

    ``ticks(route, t, moving, still, answer, lengths)``: ``lengths`` are the route's legs in metres, ``answer``
    is null, ``arrive`` or ``deny``.  Order within a tick: an answer, then progress, then the stop, then the
    gate.  A session without a leg left is over.  A route's ticks are one array, and batches hold many routes.
    """
    own = F.sort_array(F.collect_list(F.struct("t", "moving", "still", "answer"))).alias("ticks")
    routes = ticks.groupBy("route").agg(own, F.first("lengths").alias("lengths"))

    def fold(route: int, rows, lengths: list[float], out: list[tuple]) -> None:
        state = BEGIN
        for r in rows:
            if state[0] >= len(lengths):
                break
            state, event = tick(state, r["t"], r["moving"], r["still"], r["answer"], lengths)
            if event:
                out.append((route, r["t"], *event))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                out: list[tuple] = []
                part = batch.slice(at, 256)
                for route, rows, lengths in zip(*(part.column(c).to_pylist() for c in ("route", "ticks", "lengths"))):
                    fold(route, rows, lengths, out)
                cols = list(zip(*out)) or [()] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.float64()))], ["route", "t", "event", "leg", "speed"])

    return routes.select("route", "ticks", "lengths").mapInArrow(some, "route long, t double, event string, leg int, speed double")


def session_by_clock(routes: DataFrame, clock: list[tuple[float, bool, bool, str | None]]) -> DataFrame:
    """The same rows for ``routes(route, lengths)`` that all get the ticks (t, moving, still, answer) of one clock.

    No route has ticks of its own to be shuffled or listed: all routes of a batch step together, as arrays, until none has a leg left.
    """
    ordered = sorted(clock, key=lambda r: (r[0], r[1], r[2], r[3] is not None, r[3] or ""))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("lengths")
            count = lengths.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            route, first, flat = batch.column("route").to_numpy(zero_copy_only=False), np.cumsum(count) - count, lengths.flatten().to_numpy(zero_copy_only=False)
            leg, speed, done, entered, last = np.zeros(len(route), np.int32), np.full(len(route), BEGIN[1]), np.zeros(len(route)), np.full(len(route), np.nan), None
            out: list[tuple] = []
            for t, moving, still, answer in ordered:
                open_ = leg < count
                if not open_.all():
                    route, first, count, leg, speed, done, entered = (x[open_] for x in (route, first, count, leg, speed, done, entered))
                if not len(route):
                    break
                here, dt = flat[first + leg], 0.0 if last is None else t - last
                entered = np.full(len(route), t) if last is None else entered
                last = t
                if answer == "deny":
                    done = np.maximum(0.0, here - speed)
                if answer != "arrive" and moving:
                    done = np.minimum(done + speed * dt, here)
                came = np.full(len(route), True) if answer == "arrive" else (here - done <= 50.0) & (t - entered >= 3.0) if still else np.full(len(route), False)
                prompt = ~came & (done >= here)
                if came.any():
                    speed = np.where(came, np.minimum(45.0, np.maximum(1.0, 0.7 * speed + 0.3 * (here / np.maximum(t - entered, 3.0)))), speed)
                    end = leg[came] + 1 == count[came]
                    out.append((route[came], np.full(came.sum(), t), np.where(end, "destination", "arrived" if answer == "arrive" else "snapped"), leg[came] + 1, speed[came]))
                if prompt.any():
                    out.append((route[prompt], np.full(prompt.sum(), t), np.full(prompt.sum(), "prompt"), leg[prompt] + 1, speed[prompt]))
                leg, done, entered = leg + came.astype(np.int32), np.where(came, 0.0, done), np.where(came, t, entered)
            for cols in out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.float64(), pa.string(), pa.int32(), pa.float64()))], ["route", "t", "event", "leg", "speed"])

    return routes.select("route", "lengths").mapInArrow(some, "route long, t double, event string, leg int, speed double")


#: Points of a road's height profile are so far apart, at most.
PROFILE_M = 5.0


def with_heights(edges: DataFrame, dem: DataFrame, cols: int, rows: int, cell: float) -> DataFrame:
    """Edges (area, a, b, ax, ay, bx, by, len ...) with ``heights``: the raster along each, evenly spaced, null off the map."""
    from .terrain import sample

    n = F.greatest(F.ceil(F.col("len") / PROFILE_M), F.lit(1)).cast("int")
    p = edges.select("area", "a", "b", "ax", "ay", "bx", "by", n.alias("_n")).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_n"))))
    f = F.col("_k") / F.col("_n")
    p = p.withColumns({"_px": F.col("ax") + (F.col("bx") - F.col("ax")) * f, "_py": F.col("ay") + (F.col("by") - F.col("ay")) * f})
    listed = F.transform(F.array_sort(F.collect_list(F.struct("_k", "h"))), lambda s: s["h"])
    h = sample(p, dem, cols, rows, cell, "_px", "_py").groupBy("area", "a", "b").agg(listed.alias("heights"))
    return edges.join(h, ["area", "a", "b"])


class Roads:
    """A graph's directed edges as arrays, for matching many hypotheses at once."""

    def __init__(self, edges: pd.DataFrame) -> None:
        e = edges.sort_values(["a", "b"], ignore_index=True)
        self.a, self.b = e["a"].to_numpy(), e["b"].to_numpy()
        self.ax, self.ay, self.bx, self.by, self.len, self.bearing = (e[c].to_numpy(float) for c in ("ax", "ay", "bx", "by", "len", "bearing"))
        self.speed = e["speed"].to_numpy(float) if "speed" in e else np.full(len(e), DEFAULT_SPEED)
        profiles = [np.array([np.nan if v is None else v for v in x], float) for x in e["heights"]] if "heights" in e else [np.full(2, np.nan)] * len(e)
        self.first = np.concatenate([[0], np.cumsum([len(x) for x in profiles])])
        self.height = np.concatenate(profiles) if profiles else np.zeros(0)
        # Edges are in order of a: those out of a node follow each other.
        self.low, self.high = np.searchsorted(self.a, self.b, "left"), np.searchsorted(self.a, self.b, "right")

    def elevation(self, edge: np.ndarray, s: np.ndarray) -> np.ndarray:
        n = np.diff(self.first)[edge] - 1
        at = np.where(self.len[edge] > 0, s / np.maximum(self.len[edge], 1e-9), 0) * n
        i = np.clip(np.floor(at).astype(int), 0, n - 1)
        low, high = self.height[self.first[edge] + i], self.height[self.first[edge] + i + 1]
        return low + (high - low) * (at - i)

    def place(self, edge: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        f = np.where(self.len[edge] > 0, s / np.maximum(self.len[edge], 1e-9), 0)
        return self.ax[edge] + (self.bx - self.ax)[edge] * f, self.ay[edge] + (self.by - self.ay)[edge] * f

    def seeds(self, spacing: float) -> tuple[np.ndarray, np.ndarray]:
        n = np.maximum(np.ceil((self.len - spacing / 2) / spacing), 0).astype(int)
        edge = np.repeat(np.arange(len(self.a)), n)
        return edge, spacing / 2 + spacing * (np.arange(len(edge)) - np.repeat(np.cumsum(n) - n, n))

    def advance(self, edge: np.ndarray, s: np.ndarray, metres: np.ndarray, heading: float, gate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Edge, place and source of every hypothesis after so many metres: on through junctions, not straight back, within the gate; at most ``MOST_POPS`` edges of each."""
        source, rest, pops, done = np.arange(len(edge)), metres.astype(float), np.zeros(len(edge), int), []
        while len(edge):
            # Of one source edges are taken in order, up to the bound.
            order = np.argsort(source, kind="stable")
            edge, s, rest, source = edge[order], s[order], rest[order], source[order]
            nth = np.arange(len(source)) - np.searchsorted(source, source)
            few = pops[source] + nth < MOST_POPS
            np.add.at(pops, source, 1)
            edge, s, rest, source = edge[few], s[few], rest[few], source[few]
            stay = s + rest <= self.len[edge]
            done.append((edge[stay], (s + rest)[stay], source[stay]))
            edge, rest, source = edge[~stay], (rest - (self.len[edge] - s))[~stay], source[~stay]
            n = (self.high - self.low)[edge]
            nxt = np.repeat(self.low[edge], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            here = np.repeat(edge, n)
            gap = np.abs((self.bearing[nxt] - heading + 540) % 360 - 180)
            ok = (self.b[nxt] != self.a[here]) & (gap <= gate)
            edge, rest, source = nxt[ok], np.repeat(rest, n)[ok], np.repeat(source, n)[ok]
            s = np.zeros(len(edge))
        return tuple(np.concatenate(x) for x in zip(*done)) if done else (edge, s, source)


# The matcher's defaults.
DEFAULT_SPEED, MOST_POPS, SIGMA_HEADING, SIGMA_CLIMB, MOST_PENALTY, MERGE_M, BEAM, GATE = 13.0, 16, 25.0, 3.0, 5.0, 8.0, 18_000, 150.0


def follow(roads: Roads, bins: pd.DataFrame, spacing: float, step: float | None, scale: float = 1.0, beam: int = BEAM, sigma_heading: float = SIGMA_HEADING, sigma_climb: float = SIGMA_CLIMB) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Edge, place and log weight of the hypotheses that are left after a walk's bins (heading, climb, seconds).

    step: metres of a bin; None: each hypothesis drives at its edge's speed, times ``scale``, for the bin's seconds.
    Hypotheses off the height map are not seeded where there is a map at all, and later are scored by heading alone.
    """
    edge, s = roads.seeds(spacing)
    logw, before = np.zeros(len(edge)), roads.elevation(edge, s)
    if np.isfinite(before).any():
        edge, s, logw, before = (x[np.isfinite(before)] for x in (edge, s, logw, before))
    for heading, climb, seconds in zip(bins["heading"].to_numpy(float), bins["climb"].to_numpy(float), bins["seconds"].to_numpy(float) if "seconds" in bins else np.zeros(len(bins))):
        metres = np.full(len(edge), step) if step is not None else roads.speed[edge] * scale * seconds
        edge, s, source = roads.advance(edge, s, metres, heading, GATE)
        if not len(edge):
            break
        logw, before = logw[source], before[source]
        gap = np.abs((roads.bearing[edge] - heading + 540) % 360 - 180)
        h = roads.elevation(edge, s)
        off = np.where(np.isfinite(h) & np.isfinite(before), (h - before - climb) ** 2 / (2 * sigma_climb**2), 0.0)
        logw = logw - np.minimum(gap * gap / (2 * sigma_heading**2) + off, MOST_PENALTY)
        before = np.where(np.isfinite(h), h, before)
        order = np.lexsort((s, edge, -logw))
        key = edge[order] * (1 << 20) + np.floor(s[order] / MERGE_M + 0.5).astype(int)
        keep = order[np.sort(np.unique(key, return_index=True)[1])][:beam]
        edge, s, logw, before = edge[keep], s[keep], logw[keep], before[keep]
    return edge, s, logw


def areas(x: np.ndarray, y: np.ndarray, logw: np.ndarray, radius: float, most: int = 1500, least: float = 0.05) -> list[tuple[float, float, float]]:
    """(x, y, w) of greedy clusters of about ``most`` of the hypotheses, heaviest first."""
    every = max(1, len(x) // most)
    x, y, w = x[::every], y[::every], np.exp(logw[::every] - logw.max())
    left, out = w > least * w.max(), []
    for i in range(len(w)):
        if left[i]:
            hit = left & (np.hypot(x - x[i], y - y[i]) <= radius)
            left &= ~hit
            out.append((float((x[hit] * w[hit]).sum() / w[hit].sum()), float((y[hit] * w[hit]).sum() / w[hit].sum()), float(w[hit].sum())))
    return sorted(out, key=lambda c: -c[2])


_MATCH = "area long, walk long, x double, y double, concentration double, areas int, lead_x double, lead_y double, lead_share double, scale double"


def match_walks(walks: DataFrame, edges: DataFrame, spacing: float, step: float | None, scales: tuple[float, ...] = (1.0,), radius: float = 120.0, beam: int = BEAM, search_spacing: float | None = None) -> DataFrame:
    """Where on its area's roads each of ``walks(area, walk, i, heading, climb, seconds)`` ends: the best hypothesis, the share of the mass near it, and the areas that survive.

    edges: (area, a, b, ax, ay, bx, by, len, bearing), with ``heights`` (see :func:`with_heights`) and ``speed`` where there are any.
    scales: of several speed scales the one with the best concentration at ``search_spacing`` is matched again at ``spacing``.
    All hypotheses of a walk advance together as arrays.
    """

    def told(roads: Roads, bins: pd.DataFrame, scale: float, spacing: float) -> tuple | None:
        edge, s, logw = follow(roads, bins, spacing, step, scale, beam)
        if not len(edge):
            return None
        x, y = roads.place(edge, s)
        w = np.exp(logw - logw.max())
        top = int(np.lexsort((y, x, -logw))[0])
        near = np.hypot(x - x[top], y - y[top]) <= radius
        found = areas(x, y, logw, radius)
        return float(x[top]), float(y[top]), float(w[near].sum() / w.sum()), len(found), found[0][0], found[0][1], found[0][2] / sum(c[2] for c in found), scale

    def some(walks: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(walks) and len(edges):
            roads = Roads(edges)
            for (area, walk), bins in walks.groupby(["area", "walk"]):
                bins = bins.sort_values("i")
                best = scales[0]
                if len(scales) > 1:
                    tried = {k: told(roads, bins, k, search_spacing or spacing) for k in scales}
                    best = max(scales, key=lambda k: tried[k][2] if tried[k] else -1.0)
                if (r := told(roads, bins, best, spacing)) is not None:
                    out.append((area, walk, *r))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MATCH.split(", ")])

    return _by_area(walks, edges, some, _MATCH)
