"""Streams with timers against the batch, scans in chunks and clusters in rounds against loops."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from wayfold.operators import hypotheses as hy
from wayfold.operators import telemetry as te
from wayfold.operators import walks as wa
from wayfold.streaming import sessions as st

TICKS = "route long, t double, moving boolean, still boolean, answer string, lengths array<double>"


def test_a_live_session_equals_the_batch(spark, tmp_path):
    rng = random.Random(1)
    rows = [(r, t + rng.random() / 2, t % 14 != 0, t % 14 == 0, {58: "arrive", 30: "deny"}.get(t % 60), [120.0 + r * 10, 300.0, 80.0]) for r in range(5) for t in range(0, 240, 2)]
    # The last tick moves the watermark on; its own session is held back.
    came = sorted(rows, key=lambda r: r[1] + rng.uniform(0, 40)) + [(9, 5000.0, False, False, None, [1.0])]
    for k in range(3):
        part = came[k * len(came) // 3 : (k + 1) * len(came) // 3]
        spark.createDataFrame(part, TICKS).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        time.sleep(1.1)
    source = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = sorted(map(tuple, st.written(st.sessions(source), "sessions").collect()))
    assert got == sorted(map(tuple, wa.session(spark.createDataFrame(rows, TICKS)).collect())) and len(got) > 50


def test_ticks_of_a_route_go_to_its_state_together(spark, tmp_path):
    rng = random.Random(2)
    rows = [(r, float(t), t % 5 != 0, t % 5 == 0, rng.choice([None, None, "deny", "arrive"]), [90.0, 40.0 * r, 700.0]) for r in range(7) for t in range(30)]
    rng.shuffle(rows)
    batch = spark.createDataFrame(rows, TICKS).coalesce(1)
    packs = batch.select("route", *st.TICK, "lengths").mapInArrow(st._packed, st.PACK).collect()
    assert sorted(r["route"] for r in packs) == list(range(7)) and all(r["t"] == [float(t) for t in range(30)] and r["last"] == 29.0 for r in packs)
    # A tick without a time is none, wherever it comes.
    odd = [(3, None, True, False, "arrive", [90.0, 120.0, 700.0]), (8, None, True, False, None, [5.0]), (9, 5000.0, False, False, None, [1.0])]
    for k, part in enumerate((rows[:100], rows[100:] + odd)):
        spark.createDataFrame(part, TICKS).coalesce(1).write.parquet(f"{tmp_path}/{k}")
        time.sleep(1.1)
    source = spark.readStream.schema(TICKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = sorted(map(tuple, st.written(st.sessions(source), "sessions").collect()))
    assert got == sorted(map(tuple, wa.session(batch).collect())) and len(got) > 20


def test_silence_is_noticed_without_a_packet(spark, tmp_path):
    spark.createDataFrame([(1,), (1,), (2,)], "device_id long").coalesce(1).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("device_id long").parquet(f"{tmp_path}/in")
    before = {k: spark.conf.get(k, None) for k in st.STORE}
    for k, v in st.STORE.items():
        spark.conf.set(k, v)
    q = st.staleness(source, 1.0).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(processingTime="500 milliseconds").start()
    try:
        rows, until = [], time.time() + 60
        while len(rows) < 4 and time.time() < until:
            time.sleep(1)
            rows = spark.read.schema("device_id long, stale boolean, packets long").parquet(f"{tmp_path}/out").collect() if (tmp_path / "out").exists() else []
    finally:
        q.stop()
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert sorted(map(tuple, rows)) == [(1, False, 2), (1, True, 2), (2, False, 1), (2, True, 1)]


@pytest.mark.parametrize("chunk_s", [1.0, 7.0, 1e9])
def test_scans_in_chunks_equal_a_loop(spark, chunk_s):
    rng = random.Random(int(chunk_s))
    rows = [(d, e, rng.choice([0.0, 0.5, 3.0]) + e // 3, rng.uniform(-5, 5) if rng.random() > 0.1 else None) for d in range(4) for e in range(60)]
    df = spark.createDataFrame(rows, "device_id long, event_id long, t double, v double").repartition(3)
    for primed in (False, True):
        got = {r["device_id"]: (r["n"], r["out"]) for r in te.decayed(df, {"out": F.col("v")}, 0.8, chunk_s=chunk_s, primed=primed).collect()}
        for d in range(4):
            own = [v for t, _, v in sorted((t, e, v) for x, e, t, v in rows if x == d) if v is not None]
            a = own[0] if primed else 0.0
            for v in own[1:] if primed else own:
                a = a * 0.8 + v * 0.2
            assert got[d] == (len(own), pytest.approx(a, abs=1e-12))
    assert te.decayed(df.limit(0), {"out": F.col("v")}, 0.8).count() == 0


def test_one_device_is_spread_over_many_tasks(spark):
    df = spark.range(200_000).select(F.lit(1).alias("device_id"), F.col("id").alias("event_id"), F.col("id").cast("double").alias("t"), F.sin("id").alias("v"))
    plan = te.ema(df, "v", 0.9)._jdf.queryExecution().executedPlan().toString()
    assert "_chunk" in plan and "Python" not in plan
    a = 0.0
    for k in range(200_000):
        a = a * 0.9 + math.sin(k) * 0.1
    assert te.decayed(df, {"out": F.col("v")}, 0.9, chunk_s=2000.0).first()["out"] == pytest.approx(a, abs=1e-12)


def greedy(rows, radius, weighted):
    out, left = [], {i: (x, y, w) for i, x, y, w in rows if w > 0.02 * max(r[3] for r in rows)}
    for i in sorted(left):
        if i in left:
            x, y, _ = left[i]
            hit = [j for j, p in left.items() if math.hypot(p[0] - x, p[1] - y) <= radius]
            own = [left.pop(j) for j in hit]
            v = [p[2] if weighted else 1.0 for p in own]
            out.append((sum(p[0] * u for p, u in zip(own, v)) / sum(v), sum(p[1] * u for p, u in zip(own, v)) / sum(v), sum(p[2] for p in own)))
    return sorted((round(a, 6), round(b, 6), round(c, 6)) for a, b, c in out)


@pytest.mark.parametrize("weighted", [True, False])
def test_clusters_in_rounds_equal_the_loop(spark, weighted):
    rng = random.Random(6)
    # One run at random, one in rows as a grid is, one of equal places.
    runs = {0: [(i, rng.uniform(-300, 300), rng.uniform(-300, 300), rng.random()) for i in range(150)], 1: [(i, i % 12 * 30.0, i // 12 * 30.0, 1.0 + i % 3) for i in range(120)], 2: [(i, 5.0, -5.0, 0.5) for i in range(30)]}
    df = spark.createDataFrame([(r, *x) for r, rows in runs.items() for x in rows], "run long, cid long, x double, y double, w double")
    for together in (0, hy.TOGETHER):
        got = {r: [] for r in runs}
        for r in hy.clusters(df, 90.0, weighted=weighted, together=together).collect():
            got[r["run"]].append((round(r["x"], 6), round(r["y"], 6), round(r["w"], 6)))
        assert {r: sorted(v) for r, v in got.items()} == {r: greedy(rows, 90.0, weighted) for r, rows in runs.items()}


def test_datagrams_come_by_a_spool_and_once(spark, tmp_path):
    import socket
    import threading

    from wayfold.streaming import motion, spool

    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as free:
        free.bind(("127.0.0.1", 0))
        port = free.getsockname()[1]
    folder, stop, came = str(tmp_path / "spool"), threading.Event(), []
    t = threading.Thread(target=lambda: came.append(spool.receive(folder, "127.0.0.1", port, lambda: not stop.is_set(), 0.2, 7)))
    t.start()
    time.sleep(0.5)
    for k in range(40):
        motion.send([{"n": k}], "127.0.0.1", port)
        time.sleep(0.005)
    time.sleep(0.8)
    stop.set()
    t.join()
    assert came == [40]

    def run():
        q = spool.spooled(spark, folder, 2).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted(r["body"] for r in spark.read.schema(spool.ROW).parquet(f"{tmp_path}/out").collect())

    want = sorted(f'{{"n": {k}}}' for k in range(40))
    # Begun again, the stream goes on where it was.
    assert run() == want and run() == want and spool.spooled(spark, folder).isStreaming
