"""Sweeps over intervals and points, gaps filled without a product."""

import numpy as np
from pyspark.sql import functions as F

from spark_analog.operators import clean, events, intervals, memory


def test_open_intervals_equal_a_loop(spark):
    rng = np.random.default_rng(3)
    points = [(k, int(t)) for k in "ab" for t in rng.integers(-50, 300, 80)]
    spans = [(k, int(a), int(a + n)) for k in "abc" for a, n in zip(rng.integers(-60, 280, 25), rng.integers(-3, 90, 25))]
    spans += [("a", None, 5), ("a", 5, None), ("b", 7, 7), ("b", 7, 7)]
    p = spark.createDataFrame(points, "k string, t bigint")
    s = spark.createDataFrame(spans, "k string, start bigint, stop bigint")
    want = sorted((k, t, sum(a is not None and b is not None and a <= t <= b for x, a, b in spans if x == k))
                  for k, t in points)
    for span in (7, 64, 65_536):
        got = intervals.open_intervals(p, s, ["k"], span=span)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_an_interval_of_a_hundred_million_steps(spark):
    p = spark.createDataFrame([("a", 5), ("a", 60_000_000), ("a", 10 ** 8 + 5), ("a", 10 ** 8 + 6), ("b", 9)],
                              "k string, t bigint")
    s = spark.createDataFrame([("a", 6, 10 ** 8 + 5)], "k string, start bigint, stop bigint")
    got = {(r["k"], r["t"]): r["open"] for r in intervals.open_intervals(p, s, ["k"]).collect()}
    assert got == {("a", 5): 0, ("a", 60_000_000): 1, ("a", 10 ** 8 + 5): 1, ("a", 10 ** 8 + 6): 0, ("b", 9): 0}


def test_members_equal_a_loop_and_keep_nulls(spark):
    rng = np.random.default_rng(4)
    points = [(k, int(t), None if t % 5 == 0 else float(t), f"{k}{t}") for k in "ab" for t in rng.permutation(120)]
    spans = [(i, k, int(a), int(a + n)) for i, (k, a, n) in enumerate(
        (k, a, n) for k in "abc" for a, n in zip(rng.integers(-20, 130, 15), rng.integers(0, 70, 15)))]
    p = spark.createDataFrame(points, "k string, t bigint, v double, name string")
    s = spark.createDataFrame(spans, "id int, k string, start bigint, stop bigint")
    want = sorted((i, k, a, b, t, v, n) for i, k, a, b in spans for x, t, v, n in points if x == k and a <= t < b)
    for span in (16, 4_096):
        got = intervals.members(s, p, ["k"], span=span)
        assert got.columns == ["id", "k", "start", "stop", "t", "v", "name"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(want, key=str)
    assert intervals.members(s.limit(0), p, ["k"]).count() == 0


def test_unspoiled_windows_equal_a_loop(spark):
    w = spark.range(30).selectExpr("'e' as entity", "id as w")
    labels = spark.createDataFrame([("e", t, int(t in (10, 11, 25))) for t in range(30)],
                                   "entity string, t bigint, label int")
    got = sorted(r["w"] for r in memory.unspoiled(w, labels, 4, 2).collect())
    assert got == [w for w in range(30) if not any(w - 4 <= t <= w + 1 for t in (10, 11, 25))]


def test_dense_grid_fills_each_series_of_its_own(spark):
    seen = spark.createDataFrame([("e", 1, "x", 2.0), ("e", 1, "x", 4.0), ("f", 6, "y", 1.0), ("f", 9, "y", None)],
                                 "entity string, t bigint, channel string, value double")
    want = sorted([("e", t, "x", 3.0 if t == 1 else None) for t in range(8)]
                  + [("f", t, "y", 1.0 if t == 6 else None) for t in range(8)] + [("f", 9, "y", None)], key=str)
    for block in (3, 4_096):
        got = clean.densify(seen, 0, 8, F.avg("value"), block=block)
        assert got.columns == ["entity", "t", "channel", "value"]
        assert sorted((tuple(r) for r in got.collect()), key=str) == want
    assert clean.densify(seen.limit(0), 0, 8, F.avg("value")).count() == 0


def test_traces_come_in_bounded_chunks(spark):
    scores = spark.range(100).selectExpr("'e' as entity", "0 as segment", "id as t", "0 as label",
                                         "cast(id as double) as native_score", "cast(null as double) as fused_score")
    at = spark.createDataFrame([("e", 0, 40, 35, 60)], "entity string, segment int, event_start bigint, "
                                                       "interval_start bigint, interval_stop bigint")
    got = {r["chunk"]: [p["t"] for p in r["trace"]] for r in events.event_traces(at, scores, 10).collect()}
    assert got == {0: list(range(35, 45)), 1: list(range(45, 55)), 2: list(range(55, 60))}
