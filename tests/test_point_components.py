"""Calibration, fusion and averages inside one task give what the operators give row by row."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_analog.functions import kernels
from spark_analog.operators import fuse, score
from spark_analog.plans import detect as plan
from test_pipeline import make, settings

H = 3
COLUMNS = "entity string, role string, segment long, channel string, w long, y array<double>, yhat array<double>, " \
          "nearest double, divergence array<double>"


def frame(spark, without=()):
    rng = random.Random(8)

    def some(share=0.1):
        return None if rng.random() < share else round(rng.random(), 1)

    rows = []
    for entity in "ab":
        for channel in "xy":
            for role, segment, start, n in (("normal", 0, 0, 25), ("score", 0, 30, 14), ("test", 1, 44, 20), ("test", 2, 64, 9)):
                if (entity, channel, role) in without:
                    continue
                for w in range(start, start + n):
                    lists = [[some(share) for _ in range(H)] for share in (0.1, 0.02, 0.1)]
                    if w == 50:
                        lists = [[some() for _ in range(2)], lists[1], None if channel == "y" else lists[2]]
                    rows.append((entity, role, segment, channel, w, lists[0], lists[1], some(), lists[2]))
    return spark.createDataFrame(rows, COLUMNS)


def rows(df):
    return {(r.entity, r.role, r.segment, r.channel, r.t): (r.residual, r.memory, r.agreement, r.n) for r in df.collect()}


@pytest.mark.parametrize("span", [7, score.SPAN])
@pytest.mark.parametrize("signals,agreement", [(True, True), (True, False), (False, False)])
def test_a_task_per_key_equals_a_row_per_step(spark, span, signals, agreement):
    f = frame(spark, {("b", "y", "normal")})  # this key has no statistics and no points
    f = f.withColumn("divergence", F.when((F.col("entity") == "b") & (F.col("role") == "normal"), F.array_repeat(
        F.lit(None).cast("double"), H)).otherwise(F.col("divergence")))  # nothing to calibrate by
    normal, late = f.where("role = 'normal'"), f.where("role <> 'normal'")
    stats = score.mad_stats(score.residual_steps(normal))
    steps = score.signal_steps(late, normal if signals else None)
    if not agreement:
        steps = steps.withColumn("agreement", F.lit(0.0))
    want = rows(score.components(steps, stats))
    got_frame = score.point_components(late, normal if signals else None, stats, use_agreement=agreement, most=1000, span=span)
    assert [(c.name, c.dataType) for c in got_frame.schema] == [
        (c.name, c.dataType) for c in score.components(steps, stats).schema]
    got = rows(got_frame)
    assert got.keys() == want.keys() and len(got) == got_frame.count()
    for key, values in want.items():
        assert got[key] == pytest.approx(values, abs=1e-12), key


def test_fusion_in_the_scan_equals_fusion_of_its_candidates(spark):
    from spark_analog.operators import forecast
    s = settings()
    blocked = plan.prepare(make(spark)[0], s)
    bank = plan.build_memory(blocked, s)
    few = bank.where("channel <> 'z'")  # a channel without a memory keeps its native forecast
    model = forecast.linear_forecaster(blocked.where("role = 'base'"), s.context, s.horizon)
    keep = ["entity", "role", "segment", "channel", "w", "y", "yhat", "native", "nearest", "divergence", "gate"]
    for m in (model, None):
        want = fuse.fusion(plan.forecast_windows(blocked, s, few, m), s.horizon, s.gamma, mode=s.fusion_mode, k=s.k)
        got = plan.fused_windows(blocked, s, few, m)
        assert "candidates" not in got.columns
        a, b = ({tuple(r[:5]): r for r in df.select(*keep).collect()} for df in (want, got))
        assert a.keys() == b.keys() and len(a) > 100
        for key, r in a.items():
            for c in keep[5:]:
                assert b[key][c] == pytest.approx(r[c], abs=1e-12), (key, c)


def test_comparing_all_counts_as_sorting_does(monkeypatch):
    rng = np.random.default_rng(1)
    scores = rng.integers(0, 6, (5, 2000)).astype(float)
    scores[rng.random(scores.shape) < 0.1] = np.nan
    asked = rng.integers(-1, 7, (5, 40)).astype(float)
    asked[:, 3] = np.nan
    parts = [kernels.at_or_above(scores[:, a:a + 500], asked) for a in range(0, 2000, 500)]
    assert (sum(parts) == kernels.at_or_above(scores, asked)).all()


@pytest.mark.parametrize("source", ["base_memory", "memory"])
def test_a_series_in_one_task_gives_the_same_blocks(spark, monkeypatch, source):
    s = settings(block=16, memory_source=source)
    series = make(spark)[0]
    longer = series.where("t >= 0").groupBy("entity").agg(F.max("t").alias("last"))
    series = series.join(longer, "entity").where(  # another length, and a channel that starts with a gap
        (F.col("entity") != longer.select(F.min("entity")).first()[0]) | (F.col("t") < F.col("last") - 9)).select(
        "entity", "t", "channel", F.when((F.col("t") > 6) | (F.col("channel") != "x"), F.col("value")).alias("value"))
    got = plan.prepare(series, s)
    monkeypatch.setattr(plan.memory, "GROUP_ROWS", 0)
    want = plan.prepare(series, s)
    assert [(c.name, c.dataType) for c in got.schema] == [(c.name, c.dataType) for c in want.schema]
    a, b = ({tuple(r[:7]): r["values"] for r in df.collect()} for df in (want, got))
    assert a.keys() == b.keys() and len(a) > 30
    for key, values in a.items():
        assert b[key] == pytest.approx(values, abs=1e-12), key


def test_a_gap_raises_in_one_task(spark):
    series = make(spark)[0].where("t <> 7")
    with pytest.raises(Exception, match="must be dense"):
        plan.prepare(series, settings())
