"""What makes many rows of few is dealt out first, and done once for each of the few."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayfold.operators import hypotheses as hy
from wayfold.operators import routes as ro
from wayfold.operators import walks as wa
from wayfold.plans import registry
from wayfold.plans.search import _edges
from wayfold.sources import payloads as pl
from wayfold.sources import worlds as wo


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString().lower()


def test_suppliers_and_customers_are_dealt_out(spark, tmp_path):
    spark.range(1, 2501).selectExpr("id AS s_suppkey").coalesce(1).write.parquet(f"{tmp_path}/supplier.parquet")
    spark.range(1, 12001).selectExpr("id AS c_custkey", "1.0 AS c_acctbal").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    assert wo.towns(spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert "repartition" in plan(registry.queries()["tile_mosaic"](spark, str(tmp_path)))
    assert registry.queries()["placed_shapes"](spark, str(tmp_path)).rdd.getNumPartitions() == 3
    assert wo.dealt(spark.range(0), "id", 1000).count() == 0


def test_turns_are_taken_once_for_a_placement(spark):
    df = wa.placed(wa.outlines(spark), spark.createDataFrame([(1, 0.0, 0.0, 90)], "pid long, cx double, cy double, turn int"), 1200.0)
    assert plan(df).count("cos(") == 1


def test_a_rejected_body_is_parsed_once(spark):
    df = pl.rejects(spark.createDataFrame([(1, "not json"), (2, '{"ax": 1, "ay": 2, "az": 3}'), (3, None), (4, "{}")], "pid long, body string").repartition(2))
    assert plan(df).count("parse_json") <= 1 and sorted(r["pid"] for r in df.collect()) == [1, 3, 4] and df.columns == ["pid", "body"]


def test_ticks_of_one_clock_are_the_rows_of_the_window(spark, tmp_path):
    clock = [(0, True, 2.0), (1, False, 2.0), (2, True, 0.3), (3, True, 0.7), (4, False, 1.0), (5, True, 0.1)]
    legs = spark.createDataFrame([(1, 1, 100.0, 8.1), (1, 2, 0.9, 0.3), (2, 1, 5.0, None), (2, 2, None, 3.3), (3, 1, 0.0, 0.0)], "route long, leg int, metres double, speed double")
    ticks = legs.crossJoin(spark.createDataFrame(clock, "t int, moving boolean, dt double"))
    rows = lambda df: sorted(map(str, df.select("route", "leg", "t", "moving", "done", "prompt").collect()))
    assert rows(ro.progress_by_clock(legs, clock)) == rows(ro.progress(ticks)) and len(rows(ro.progress(ticks))) == 30
    # Legs are dealt out once, and no tick is.
    reckoned = registry.queries()["dead_reckoning"](spark, "/root/testdata/sf0.001")
    assert reckoned._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_walkers_are_dealt_to_tasks_that_grow_with_the_graph(spark, monkeypatch):
    monkeypatch.setattr(hy, "TASK_EDGES", 100)
    e = _edges(spark, "/root/testdata/sf0.001").withColumn("speed", 10.0 + F.col("a") % 5)
    tasks = hy.tasks_for(e)
    assert tasks == -(-e.count() // 100) > 20
    for name in ("driving_advance", "road_advance", "long_advance"):
        moved = registry.queries()[name](spark, "/root/testdata/sf0.001")
        # Counts are made where the walkers of an edge are; none is joined with the edge that it comes from.
        assert moved.rdd.getNumPartitions() == tasks and "join inner, ((a#" not in plan(moved)
    scores = registry.queries()["road_scores"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert f", {tasks}), REPARTITION_BY_NUM" in scores and "hashpartitioning(a" in scores and scores.count("SortMergeJoin") <= 1


def test_walkers_that_bring_their_edge_go_where_others_do(spark):
    e = _edges(spark).withColumn("speed", 10.0 + F.col("a") % 5)
    keep = ("ax", "bearing", "len")
    rows = lambda df, *more: sorted(map(tuple, df.select("a", "b", "s", *more).collect()))
    for step in (hy.driven(6.0, 0.9), 450.0, 1000.0, -10.0):
        bare = hy.advance(hy.seed(e, 50.0), e, step, 90.0)
        with_edge = hy.advance(hy.seed(e, 50.0, (*keep, "speed")), e, step, 90.0, keep, 7)
        assert bare.columns == ["a", "b", "s"] and rows(with_edge) == rows(bare)
        # What a walker brings is of the edge on which it ends.
        assert rows(with_edge, *keep) == rows(bare.join(e.select("a", "b", *keep), ["a", "b"]), *keep)
