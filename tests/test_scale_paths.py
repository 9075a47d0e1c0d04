"""The paths for huge groups give the same result as the plain ones, also with a hot key."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spark_analog.operators import clean, ordered, score, windows


def hot_frame(spark, n=6000, seed=0, ties=False):
    rng = np.random.default_rng(seed)
    key = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    v = rng.lognormal(3, 4, n) * rng.choice([-1, 1], n)
    if ties:
        v = np.where(rng.random(n) < 0.35, 1.5, np.round(v))
    return spark.createDataFrame(pd.DataFrame({"key": key, "v": v, "one": 1}))


@pytest.mark.parametrize("ties", [False, True])
def test_bracketed_quantiles_equal_percentile(spark, ties):
    df = hot_frame(spark, ties=ties)
    probs, out = [0.75, 0.25, 0.5], ["c", "a", "b"]
    direct = {r["key"]: (r["a"], r["b"], r["c"]) for r in ordered.quantiles(
        df, ["key"], "v", probs, out, most=1).collect()}
    kept = df.select("key", F.col("v").alias("__v"))
    for below in (0, 3000, 10 ** 6):
        sketched = ordered._bracketed_quantiles(kept, ["key"], probs, out, margin=5e-3,
                                                exact_below=below)
        got = {r["key"]: (r["a"], r["b"], r["c"]) for r in sketched.collect()}
        assert got.keys() == direct.keys()
        for k in got:
            assert got[k] == pytest.approx(direct[k], rel=1e-12, abs=1e-12)
    pdf = df.toPandas()
    for k, g in pdf.groupby("key"):
        assert direct[k] == pytest.approx(tuple(np.percentile(g["v"], [25, 50, 75])))


@pytest.mark.parametrize("descending", [False, True])
def test_running_sums_by_value_in_pieces(spark, descending):
    df = hot_frame(spark, ties=True).groupBy("key", "v").agg(F.sum("one").alias("c"))
    plain = ordered.running_by_value(df, ["key"], "v", {"cum": "c"}, descending=descending)
    cut = ordered.running_by_value(df, ["key"], "v", {"cum": "c"}, rows=20, descending=descending)
    order = ["key", "v"]
    a = plain.select("key", "v", "cum").toPandas().sort_values(order, ignore_index=True)
    b = cut.select("key", "v", "cum").toPandas().sort_values(order, ignore_index=True)
    pd.testing.assert_frame_equal(a, b)


def test_time_rank_over_many_pieces(spark):
    t = pd.DataFrame({"key": ["x"] * 500 + ["y"] * 20,
                      "t": list(range(3, 1503, 3)) + list(range(20))})
    got = ordered.time_rank(spark.createDataFrame(t), ["key"], "t", "pos", span=64).toPandas()
    for _, g in got.groupby("key"):
        assert list(g.sort_values("t")["pos"]) == list(range(len(g)))


def series(spark, n=300, gap=0.6, seed=2, entities=("e0", "e1"), channels=("x", "y")):
    rng = np.random.default_rng(seed)
    rows = []
    for e in entities:
        for c in channels:
            v = rng.normal(size=n).cumsum()
            v[rng.random(n) < gap] = np.nan
            rows.append(pd.DataFrame({"entity": e, "channel": c, "t": np.arange(n), "value": v}))
    pdf = pd.concat(rows).sample(frac=1, random_state=1)
    df = spark.createDataFrame(pdf)
    return df.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def test_causal_fill_does_not_depend_on_the_block(spark):
    s = series(spark, gap=0.95)
    med = clean.channel_medians(s, most=1)
    results = [clean.causal_fill(s, med, block=b).toPandas().sort_values(
        ["entity", "channel", "t"], ignore_index=True)[["entity", "channel", "t", "value"]]
        for b in (3, 50, 65_536)]
    pd.testing.assert_frame_equal(results[0], results[1])
    pd.testing.assert_frame_equal(results[0], results[2])
    pdf = s.toPandas().sort_values("t")
    m = {(r["entity"], r["channel"]): r["median"] for r in med.collect()}
    for k, g in pdf.groupby(["entity", "channel"]):
        want = g["value"].ffill().fillna(m[k]).to_numpy()
        r = results[0]
        got = r[(r["entity"] == k[0]) & (r["channel"] == k[1])]["value"].to_numpy()
        assert np.allclose(got, want)


def test_smoothing_does_not_depend_on_the_block(spark):
    s = series(spark, channels=("x",), gap=0.3).select(
        "entity", F.lit("r").alias("role"), F.lit(0).alias("segment"), "t",
        F.col("value").alias("score"))
    frames = [score.causal_smooth(s, [1, 4, 9], block=b).toPandas().sort_values(
        ["entity", "t"], ignore_index=True) for b in (2, 16, 65_536)]
    for f in frames[1:]:
        pd.testing.assert_frame_equal(frames[0][["entity", "t", "smooth_1", "smooth_4", "smooth_9"]],
                                      f[["entity", "t", "smooth_1", "smooth_4", "smooth_9"]])


@pytest.mark.parametrize("stride,cap", [(1, None), (5, None), (1, 11), (3, 7)])
def test_windows_do_not_depend_on_the_block(spark, stride, cap):
    s = series(spark, n=101, gap=0.0).withColumn("role", F.lit("all")).withColumn(
        "segment", F.lit(0).cast("bigint")).withColumn("start", F.lit(0).cast("bigint")).withColumn(
        "length", F.lit(101).cast("bigint"))
    seen = []
    for b in (3, 7, 64, 4096):
        w = windows.windows(windows.blocks(s, 10, 3, block=b), 10, 3, stride, cap, seed=5)
        f = w.toPandas().sort_values(["entity", "channel", "w"], ignore_index=True)
        seen.append(f)
    for f in seen[1:]:
        pd.testing.assert_frame_equal(seen[0], f)
    one = seen[0][(seen[0]["entity"] == "e0") & (seen[0]["channel"] == "x")]
    starts = list(one["w"] - 10)
    legal = sorted(set(range(0, 89, stride)) | {88})
    if cap is None:
        assert starts == legal
    else:
        edges = [i * len(legal) // cap for i in range(cap + 1)]
        assert len(starts) == cap
        assert all(s in legal[edges[i]:edges[i + 1]] for i, s in enumerate(starts))
    values = s.where("entity = 'e0' and channel = 'x'").toPandas().sort_values("t")["value"]
    for _, r in one.iterrows():
        assert np.array_equal(r["ctx"], values[r["w"] - 10:r["w"]])
        assert np.array_equal(r["fut"], values[r["w"]:r["w"] + 3])


def test_calibration_in_pieces_and_with_missing_values(spark):
    rng = np.random.default_rng(4)
    ref = pd.DataFrame({"entity": "e", "channel": "c", "x": np.round(rng.gamma(2, 1, 400), 2)})
    cur = pd.DataFrame({"entity": "e", "channel": ["c"] * 50 + ["new"] * 3,
                        "x": np.round(rng.gamma(2, 2, 53), 2), "id": range(53)})
    r, q = spark.createDataFrame(ref), spark.createDataFrame(cur)
    q = q.withColumn("x", F.when(F.col("id") != 7, F.col("x")))
    srt = np.sort(ref["x"])
    for rows in (500_000, 25):
        got = score.calibrate(q, r, "x", "s", True, rows=rows).toPandas().set_index("id")["s"]
        for i, row in cur.iterrows():
            if row["channel"] == "new":
                assert got[i] == 0.0
                continue
            x = srt[len(srt) // 2] if i == 7 else row["x"]
            cdf = np.clip((np.searchsorted(srt, x, side="right") + 0.5) / 401, 1e-5, 1 - 1e-5)
            assert got[i] == pytest.approx(-np.log1p(-cdf))


def ranked_frames(spark):
    """A reference with a value of 60 % of its rows, and values 90 % of which are equal."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.lognormal(0, 4, 700), -rng.lognormal(0, 4, 300), np.full(1500, 3.5), [0.0, -0.0, 1e300]])
    ref = pd.DataFrame({"k": "a", "x": x})
    ref = pd.concat([ref, pd.DataFrame({"k": "b", "x": rng.integers(0, 5, 60).astype(float)}),
                     pd.DataFrame({"k": "c", "x": [7.0]})])
    few = np.concatenate([rng.choice(x, 200), rng.lognormal(0, 4, 200), [-1e300, 1e301, 3.5, 0.0]])
    cur = pd.concat([pd.DataFrame({"k": "a", "x": np.concatenate([np.full(3600, 0.123), few])}),
                     pd.DataFrame({"k": "b", "x": np.arange(-1, 7).astype(float)}),
                     pd.DataFrame({"k": "c", "x": [6.0, 7.0, 8.0]}), pd.DataFrame({"k": "none", "x": [1.0, 2.0]})])
    cur["id"], cur["more"] = range(len(cur)), "m"
    q = spark.createDataFrame(cur).repartition(6).withColumn("list", F.array("id"))
    q = q.withColumn("x", F.when(F.col("id") % 97 != 5, F.col("x")))
    return ref, q, spark.createDataFrame(ref).repartition(5)


@pytest.mark.parametrize("rows", [1, 40, 500, 10_000])
def test_ranks_among_a_reference_equal_a_binary_search(spark, rows):
    ref, q, r = ranked_frames(spark)
    out = ordered.ranks_among(q, r, ["k"], "x", "rank", "size", rows)
    assert out.columns == ["k", "x", "id", "more", "list", "rank", "size"]
    got = out.collect()
    assert sorted(g["id"] for g in got) == list(range(q.count()))
    by = {k: np.sort(g["x"]) for k, g in ref.groupby("k")}
    for g in got:
        if g["k"] == "none":
            assert g["size"] is None
            continue
        have = by[g["k"]]
        x = have[len(have) // 2] if g["x"] is None else g["x"]
        assert (g["rank"], g["size"]) == (np.searchsorted(have, x, side="right"), len(have)), g


def test_ranks_without_rows(spark):
    _, q, r = ranked_frames(spark)
    assert ordered.ranks_among(q.limit(0), r, ["k"], "x", "rank", "size").count() == 0
    bare = ordered.ranks_among(q, r.limit(0), ["k"], "x", "rank", "size")
    assert bare.where("size is not null").count() == 0 and bare.count() == q.count()
    gone = ordered.ranks_among(q, r.withColumn("x", F.lit(None).cast("double")), ["k"], "x", "rank", "size")
    assert gone.where("size is not null").count() == 0 and gone.count() == q.count()


def test_equal_values_are_dealt_evenly_and_no_value_is_a_join_key(spark):
    _, q, r = ranked_frames(spark)
    dealt, _, _ = ordered._dealt(q, r, ["k"], "x", 100)
    sizes = [c["count"] for c in dealt.groupBy("k", "__p", "__salt").count().collect()]
    assert max(sizes) < 400 and len(sizes) > 36
    assert dealt.where("__ref = 1").count() < 2 * (q.count() + r.count())
    plan = ordered.ranks_among(q, r, ["k"], "x", "rank", "size", 100)._jdf.queryExecution().optimizedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line]
    assert joins and not any("__x" in line for line in joins)


@pytest.mark.parametrize("shape", ["skewed", "even", "two"])
def test_pieces_are_cut_at_ranks(spark, shape):
    n = 20_000
    rng = np.random.default_rng(3)
    x = {"skewed": 1 + rng.random(n) ** 40 * 0.05, "even": rng.random(n), "two": np.arange(n) % 2 * 1.0}[shape]
    x = np.unique(x)
    df = spark.createDataFrame(pd.DataFrame({"k": "a", "v": x}))
    sizes = [c["count"] for c in ordered.value_pieces(df, ["k"], "v", 500).groupBy("__piece").count().collect()]
    assert sum(sizes) == len(x) and max(sizes) < 700
