import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spark_analog.operators import forecast, fuse, retrieve, windows

CAND = "array<struct<rank:int,src_w:bigint,distance:double,future:array<double>>>"


def frame(spark):
    rows = [("a", [1.0, 1.0], [(1, 5, 1.0, [2.0, 3.0]), (2, 6, 1.0, [4.0, 5.0])]),
            ("b", [1.0, 1.0], []), ("c", [0.0, 0.0], [(1, 9, 0.2, [9.0, 9.0]),
                                                      (2, 8, 5.0, [1.0, 1.0])])]
    return spark.createDataFrame(rows, f"id string, native array<double>, candidates {CAND}")


@pytest.mark.parametrize("mode", ["nearest", "uniform", "idw", "softmax", "sparse", "select"])
def test_weights_sum_to_one_or_are_empty(spark, mode):
    got = frame(spark).select("id", retrieve.candidate_weights(mode, 0.15, 2).alias("w")).collect()
    for r in got:
        assert (len(r["w"]) == 0) if r["id"] == "b" else sum(r["w"]) == pytest.approx(1.0)
    w = {r["id"]: r["w"] for r in got}
    if mode in ("softmax", "uniform", "select"):
        assert w["a"] == pytest.approx([0.5, 0.5])
    if mode == "sparse":
        assert w["c"] == [1.0, 0.0]


def test_fusion_without_references_is_native(spark):
    got = {r["id"]: r for r in fuse.fusion(frame(spark), 2).collect()}
    assert got["b"]["yhat"] == [1.0, 1.0] and got["b"]["gate"] == 0.0
    assert got["a"]["yhat"] == pytest.approx([1.0 + 0.1 * 2.0, 1.0 + 0.1 * 3.0])
    open_ = {r["id"]: r for r in fuse.fusion(frame(spark), 2, gamma=1.0, mode="nearest").collect()}
    assert open_["c"]["yhat"] == [9.0, 9.0]


def newton(x, q, w, penalty=1.0):
    mean, sd = x.mean(0), x.std(0)
    z = np.column_stack([(x - mean) / np.where(sd > 0, sd, 1), np.ones(len(x))])
    b, ridge = np.zeros(z.shape[1]), np.diag([penalty] * x.shape[1] + [0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ b))
        b -= np.linalg.solve((z * (w * p * (1 - p))[:, None]).T @ z + ridge,
                             z.T @ (w * (p - q)) + ridge @ b)
    return b


@pytest.mark.parametrize("balanced", [True, False])
def test_logistic_gate_per_entity(spark, balanced):
    rng = np.random.default_rng(0)
    parts = []
    for e in range(3):
        x = rng.normal(size=(200, 2)) * [1, 5] + e
        q = (rng.random(200) < 1 / (1 + np.exp(-(x[:, 0] - 1)))).astype(float)
        if not balanced:
            q = np.clip(q * 0.8 + 0.1, 0, 1)
        parts.append(pd.DataFrame({"entity": f"e{e}", "f": x[:, 0], "g": x[:, 1], "q": q}))
    parts.append(pd.DataFrame({"entity": "one", "f": [1.0, 2.0], "g": [0.0, 1.0], "q": [1.0, 1.0]}))
    pdf = pd.concat(parts if balanced else parts[:3])
    got = {r["entity"]: r for r in fuse.fit_logistic(
        spark.createDataFrame(pdf), ["f", "g"], "q", balanced=balanced).collect()}
    for e, g in pdf.groupby("entity"):
        if e == "one":
            assert got[e]["constant"] == 1.0
            continue
        q = g["q"].to_numpy()
        n1 = q.sum()
        w = np.where(q > .5, len(q) / (2 * n1), len(q) / (2 * (len(q) - n1))) if balanced else 1.0
        want = newton(g[["f", "g"]].to_numpy(), q, w * np.ones(len(q)))
        assert [*got[e]["coef"], got[e]["intercept"]] == pytest.approx(list(want), abs=1e-6)


def steps(spark, n=200, gaps=0):
    rng = np.random.default_rng(1)
    out = []
    for e in ("e0", "e1"):
        for c in ("x", "y"):
            v = np.sin(np.arange(n) / 5) + 0.1 * rng.normal(size=n)
            out.append(pd.DataFrame({"entity": e, "role": "base", "segment": 0, "channel": c,
                                     "t": np.arange(n), "value": v, "start": 0, "length": n}))
    return spark.createDataFrame(pd.concat(out))


def test_linear_forecaster_equals_ridge_on_all_windows(spark):
    L, H = 12, 3
    s = steps(spark)
    weights = []
    for b in (16, 4096):
        model = forecast.linear_forecaster(windows.blocks(s, L, H, block=b), L, H)
        weights.append({r["entity"]: np.array(r["weights"]).reshape(L + 1, H)
                        for r in model.collect()})
    pdf = s.toPandas()
    for e, g in pdf.groupby("entity"):
        zs, ys = [], []
        for _, c in g.groupby("channel"):
            v = c.sort_values("t")["value"].to_numpy()
            for a in range(len(v) - L - H + 1):
                x, y = v[a:a + L], v[a + L:a + L + H]
                sp = np.sqrt(x.var() + 1e-5)
                zs.append([*((x - x.mean()) / sp), 1.0])
                ys.append((y - x.mean()) / sp)
        z, y = np.array(zs), np.array(ys)
        pen = np.eye(L + 1)
        pen[-1, -1] = 1e-9
        want = np.linalg.solve(z.T @ z + pen, z.T @ y)
        for w in weights:
            assert np.allclose(w[e], want, atol=1e-6)


def test_user_forecast_must_be_finite_and_shaped(spark):
    b = windows.blocks(steps(spark, 40), 5, 2)
    ok = windows.scan(b, 5, 2, forecast=lambda x: np.repeat(x[:, -1:], 2, axis=1))
    assert ok.where(F.col("yhat")[0] != F.col("last")).count() == 0
    for bad in (lambda x: x[:, :1], lambda x: np.full((len(x), 2), np.nan)):
        with pytest.raises(Exception, match="finite and shaped"):
            windows.scan(b, 5, 2, forecast=bad).collect()
