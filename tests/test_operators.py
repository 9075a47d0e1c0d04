"""Literal frames and hand-computed values."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spark_analog.operators import clean, evaluate, events, ledger, memory, scale, score


def rows(df, *cols):
    return [tuple(r) for r in df.select(*cols).collect()]


def test_smoothing_restarts_at_segments(spark):
    df = spark.createDataFrame(
        [("e", "r", s, t, v) for t, (s, v) in enumerate(zip(
            [0, 0, 0, 1, 1, 1], [1.0, 2.0, 3.0, None, None, 9.0]))],
        "entity string, role string, segment int, t bigint, score double")
    got = rows(score.causal_smooth(df, [3]).orderBy("t"), "smooth_3")
    assert [g[0] for g in got] == [1.0, 1.5, 2.0, None, None, 9.0]


def test_forward_fill_starts_with_the_median(spark):
    df = spark.createDataFrame([("e", "c", t, v) for t, v in enumerate(
        [None, None, 5.0, None, 7.0])], "entity string, channel string, t bigint, value double")
    med = spark.createDataFrame([("e", "c", 4.0)], "entity string, channel string, median double")
    assert [r[0] for r in rows(clean.causal_fill(df, med).orderBy("t"), "value")] == [4, 4, 5, 5, 7]


@pytest.mark.parametrize("codes,attack", [
    (["-1", "1"], {"-1"}), (["0", "1"], {"1"}), (["-1", "0"], {"-1"}), (["0", "3"], {"3"}),
    (["0", "1", "-1"], {"1", "-1"}), (["Normal", "A ttack"], {"A ttack"}),
    ([" no attack ", "Anomalous"], {"Anomalous"})])
def test_label_spellings(spark, codes, attack):
    df = spark.createDataFrame([(c,) for c in codes * 3], "l string")
    got = {r["l"]: r["label"] for r in clean.normalise_labels(df, "l").collect()}
    assert got == {c: int(c in attack) for c in codes}


def test_unknown_label_is_an_error(spark):
    df = spark.createDataFrame([("Normal",), ("maybe",)], "l string")
    with pytest.raises(Exception, match="unknown label"):
        clean.normalise_labels(df, "l").collect()
    kept = clean.normalise_labels(df, "l", strict=False).collect()
    assert {r["l"]: r["label"] for r in kept} == {"Normal": 0, "maybe": None}


def test_columns_by_name_or_position(spark):
    a = spark.createDataFrame([(1, 2)], " ` P-1 ` int, `Q2` int")
    b = spark.createDataFrame([(3, 4)], "`q 2` int, `p1` int")
    assert rows(clean.align_columns(a, b), *[f"`{c}`" for c in a.columns]) == [(4, 3)]
    c = spark.createDataFrame([(5, 6)], "x int, y int")
    assert clean.align_columns(a, c).columns == a.columns
    with pytest.raises(ValueError):
        clean.align_columns(a, spark.createDataFrame([(1,)], "x int"))
    assert clean.label_column(["Time", "Normal/Attack", "p"]) == "Normal/Attack"
    assert clean.label_column(["Time", "test_label"]) == "test_label"
    assert clean.time_columns(["Timestamp (min)", "Unnamed: 0", "p1"]) == [
        "Timestamp (min)", "Unnamed: 0"]


def test_scaler_inverse_and_constant_channel(spark):
    df = spark.createDataFrame(
        [("e", c, t, float(v)) for c in ("x", "k") for t, v in enumerate(
            [1, 5, 2, 8, 3] if c == "x" else [4] * 5)],
        "entity string, channel string, t bigint, value double")
    fit = scale.robust_fit(df, most=5)
    assert {r["channel"]: (r["center"], r["scale"]) for r in fit.collect()} == {
        "x": (3.0, 3.0), "k": (4.0, 1.0)}
    back = scale.robust_transform(scale.robust_transform(df, fit), fit, inverse=True)
    assert sorted(rows(back, "channel", "t", "value")) == sorted(rows(df, "channel", "t", "value"))


def test_blocks_merge_a_short_tail(spark):
    df = spark.range(450).select(F.lit("e").alias("entity"), F.col("id").alias("t"))
    r = scale.roles(df, 0, 40, 19, 200)
    seg = {tuple(x) for x in rows(r.where("role in ('score','test')"), "segment", "start", "length",
                                  "role")}
    assert seg == {(0, 0, 200, "score"), (1, 200, 250, "test")}
    assert scale.validation_period(0.2) == 5


def test_uniform_slots(spark):
    pos = spark.range(10).select(F.col("id").alias("p"), memory.uniform_slot(
        F.col("id"), F.lit(10), F.lit(4)).alias("s")).where("s is not null").orderBy("p")
    assert rows(pos, "p", "s") == [(1, 0), (3, 1), (6, 2), (8, 3)]
    for n in (1, 2, 3, 5, 17, 97, 640, 1000):
        for m in (1, 2, 3, 4, 8, 32, 96):
            want = sorted({int(np.floor((i + 0.5) * n / m)) for i in range(m)}) if m < n else list(
                range(n))
            got = spark.range(n).where(memory.uniform_slot(
                F.col("id"), F.lit(n), F.lit(m)).isNotNull()).orderBy("id").collect()
            assert [r[0] for r in got] == want


def brute_ap(y, s):
    out, tp_prev = 0.0, 0
    for th in sorted(set(s), reverse=True):
        tp = sum(a for a, b in zip(y, s) if b >= th)
        seen = sum(b >= th for b in s)
        out += (tp - tp_prev) / sum(y) * tp / seen
        tp_prev = tp
    return out


def test_metrics_with_ties(spark):
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 200)
    s = np.round(rng.normal(size=200) + y, 1)
    df = spark.createDataFrame(pd.DataFrame({"k": "g", "label": y, "score": s}))
    one = df.withColumn("k", F.lit("ones")).withColumn("label", F.lit(1))
    got = {r["k"]: r for r in evaluate.summary(df.unionByName(one), ["k"]).collect()}
    pairs = [(a > b) + (a == b) / 2 for a in s[y == 1] for b in s[y == 0]]
    assert got["g"]["auprc"] == pytest.approx(brute_ap(list(y), list(s)))
    assert got["g"]["auroc"] == pytest.approx(np.mean(pairs))
    assert got["ones"]["single_class"] and got["ones"]["auprc"] is None
    flipped = evaluate.average_precision(df.withColumn("score", -F.col("score")), ["k"]).first()
    assert flipped["auroc"] == pytest.approx(1 - got["g"]["auroc"])


def test_events_are_runs_clipped_to_segments(spark):
    df = spark.createDataFrame([("e", 0, 0, 5, t, l) for t, l in enumerate([0, 1, 1, 0, 1])],
                               "entity string, segment bigint, start bigint, length bigint, "
                               "t bigint, label int")
    got = rows(events.enumerate_events(df, 1).orderBy("event_start"), "event_start", "event_stop",
               "interval_start", "interval_stop")
    assert got == [(1, 3, 0, 4), (4, 5, 3, 5)]


def test_constructed_success_and_failure(spark):
    label = np.zeros(1000, int)
    for a, b in ((190, 220), (590, 625), (820, 840)):
        label[a:b] = 1
    rng = np.random.default_rng(0)
    native = rng.random(1000) + 0.3 * label
    fused = native.copy()
    fused[190:220] += 2
    fused[590:625] -= 2
    df = spark.createDataFrame(pd.DataFrame({
        "entity": "e", "segment": 0, "start": 0, "length": 1000, "t": np.arange(1000),
        "label": label, "a": native, "b": fused}))
    ev = events.enumerate_events(df, 80)
    eff = events.event_effects(ev, df, "a", "b")
    ex = {r["selected_as"]: r["event_start"] for r in events.event_extremes(eff).collect()}
    assert ex == {"success": 190, "failure": 590}


def test_holm_and_exact_signed_ranks(spark):
    t = spark.createDataFrame([("a", "b", .01), ("a", "c", .04), ("b", "c", .03)],
                              "left string, right string, p double")
    got = {(r["left"], r["right"]): r["p_holm"] for r in ledger.holm(t).collect()}
    assert got == {("a", "b"): pytest.approx(.03), ("b", "c"): pytest.approx(.06),
                   ("a", "c"): pytest.approx(.06)}
    assert ledger.signed_rank_p(5, 0.0, [1, 2, 3, 4, 5]) == pytest.approx(0.0625)
    assert ledger.signed_rank_p(0, 0.0, []) == 1.0
    assert ledger.chi2_sf(3.841458820694124, 1) == pytest.approx(0.05)
    assert ledger.chi2_sf(9.487729036781154, 4) == pytest.approx(0.05)
    assert ledger.chi2_sf(7.814727903251179, 3) == pytest.approx(0.05)


def test_published_bank_size(spark):
    bank = spark.range(256 * 25).select(
        F.lit("e").alias("entity"), F.array_repeat(F.lit(0.0), 21).alias("feat"),
        F.array_repeat(F.lit(0.0), 8).alias("delta"))
    scales = spark.range(25).select(F.lit("e").alias("entity"),
                                    F.array_repeat(F.lit(0.0), 21).alias("center"))
    assert rows(memory.footprint(bank, scales), "bytes") == [(798_000,)]


def test_blend_needs_a_real_gain(spark):
    df = spark.createDataFrame([("e", 0.0, .5), ("e", .5, .5 + 1e-13), ("e", 1.0, .4),
                                ("f", 0.0, .1), ("f", .5, .2), ("f", 1.0, .2)],
                               "entity string, blend double, objective double")
    assert sorted(rows(score.select_blend(df), "entity", "selected")) == [("e", 0.0), ("f", .5)]


def test_grid_integrity_reports_violations(spark):
    base = [("id", k, m, {64: 202800, 128: 401200, 256: 798000, 512: 1591600}[m])
            for k in (1, 3, 5, 10) for m in (64, 128, 256, 512)]
    schema = "benchmark_id string, k int, m int, payload int"
    assert ledger.grid_integrity(spark.createDataFrame(base, schema)).count() == 0
    broken = [r for r in base if r[1:3] != (1, 64)] + [("id", 7, 64, 202800), ("id", 3, 128, 9)]
    got = {(r["k"], r["m"], r["violation"]) for r in ledger.grid_integrity(
        spark.createDataFrame(broken, schema)).collect()}
    assert got == {(1, 64, "missing"), (7, 64, "foreign"), (3, 128, "repeated"),
                   (None, 128, "payload_varies")}
