"""Invariants of generated walks, sessions and streams."""

from __future__ import annotations

import socket
import time
from collections import defaultdict

from pyspark.sql import functions as F

from wayfold.operators import walks as wa
from wayfold.plans import search, world
from wayfold.streaming import motion as live


def test_trails_use_no_edge_twice(spark):
    paths = defaultdict(list)
    for r in sorted(world.generated_trails(spark, "").collect(), key=lambda r: (r["walk"], r["i"])):
        paths[r["walk"]].append(r["node"])
    sets = []
    for p in paths.values():
        used = [frozenset(x) for x in zip(p, p[1:])]
        assert len(used) == len(set(used))
        sets.append(frozenset(used))
    assert paths and len(sets) == len(set(sets))


def test_road_match_holds_the_truth(spark):
    """Every observed walk keeps a hypothesis, and concentrations are shares."""
    got = world.matched_walks(spark, "").collect()
    assert len(got) == 40 and all(0 < r["concentration"] <= 1 for r in got)


def test_session_events(spark):
    rows = [(1, float(t), True, False, None, [50.0, 400.0]) for t in range(8)] + [(1, 9.0, False, True, None, [50.0, 400.0]), (1, 10.0, False, False, "arrive", [50.0, 400.0]), (1, 11.0, True, False, None, [50.0, 400.0])]
    got = [(r["t"], r["event"]) for r in wa.session(spark.createDataFrame(rows, "route long, t double, moving boolean, still boolean, answer string, lengths array<double>")).orderBy("t").collect()]
    assert got[0] == (5.0, "prompt") and got[-2][1] == "snapped" and got[-1] == (10.0, "destination")


def test_udp_round_trip(spark):
    live.register(spark)
    with socket.socket(socket.AF_INET, socket.SOCK_DGRAM) as s:
        s.bind(("127.0.0.1", 0))
        port = s.getsockname()[1]
    reader = live.UdpSource({"host": "127.0.0.1", "port": str(port)}).simpleStreamReader(None)
    try:
        assert live.send([{"accel_x": 1, "accel_y": 2, "accel_z": 3}] * 3, "127.0.0.1", port) == 3
        for _ in range(50):
            rows, end = reader.read({"n": 0})
            if end["n"] == 3:
                break
            time.sleep(0.05)
        assert len(list(rows)) == 3
        reader.commit(end)
        assert list(reader.readBetweenOffsets(end, end)) == []
    finally:
        reader.socket.close()


def test_advance_branches_but_does_not_turn_back(spark):
    e = search._edges(spark)
    one = spark.createDataFrame([(0, 1, 190.0, 0.0, 0.0)], "a long, b long, s double, logw double, e_prev double")
    from wayfold.operators import hypotheses as hy

    got = {(r["a"], r["b"], r["s"]) for r in hy.advance(one, e, 30.0, 90.0).collect()}
    assert got == {(1, 2, 20.0), (1, 10, 20.0)}
    assert hy.merge_and_prune(one.unionByName(one.withColumn("logw", F.lit(-1.0)))).count() == 1
