"""Memory, retrieval and detection against plain NumPy on a small fixture."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from spark_analog.functions import kernels
from spark_analog.operators import evaluate, memory, retrieve, scale, windows
from spark_analog.plans import ablation, compare, detect as plan

L, H, N, STOP = 12, 3, 420, 280


def make(spark, seed=0):
    rng = np.random.default_rng(seed)
    rows, marks = [], []
    for e in ("e0", "e1"):
        t = np.arange(N)
        label = np.zeros(N, int)
        for a in range(STOP + 5, N - 4, 17):
            label[a:a + 2] = 1
        marks.append(pd.DataFrame({"entity": e, "t": t, "label": label}))
        for i, c in enumerate(("x", "y", "z")):
            v = np.sin(t / (4 + i)) + 0.05 * rng.normal(size=N)
            v = v + 4.0 * label * (i != 2)
            v[rng.random(N) < 0.03] = np.nan
            rows.append(pd.DataFrame({"entity": e, "t": t, "channel": c, "value": v}))
    s = spark.createDataFrame(pd.concat(rows).sample(frac=1, random_state=0))
    s = s.withColumn("value", F.when(~F.isnan("value"), F.col("value")))
    return s, spark.createDataFrame(pd.concat(marks))


def settings(**kw):
    base = dict(context=L, horizon=H, train_stop=STOP, size=20, k=3, label_block=20,
                axes=dict(top_q=(0.4, 1.0), memory=(0.0, 0.5), agreement=(0.0, 0.5),
                          smoothing=(1, 3)))
    return plan.Settings(**{**base, **kw})


@pytest.fixture(scope="module")
def blocked(spark):
    return plan.prepare(make(spark)[0], settings())


def memory_series(blocked):
    """(entity, channel) -> values of the memory role, from the blocks."""
    rows = blocked.where("role = 'memory'").select(
        "entity", "channel", F.posexplode("values").alias("i", "v")).toPandas()
    return {k: g.sort_values("i")["v"].to_numpy() for k, g in rows.groupby(["entity", "channel"])}


def boundary(feat, size):
    q1, c, q3 = np.percentile(feat, [25, 50, 75], axis=0)
    sc = np.where(q3 - q1 < 1e-6, 1.0, q3 - q1)
    z = (feat - c) / sc
    n = len(z)
    wanted = min(size, n)
    edge = min(max(1, round(0.2 * wanted)), n - 1)
    core_n = max(wanted - edge, 1)
    m = min(n, 4 * core_n)
    pool = np.floor((np.arange(m) + 0.5) * n / m).astype(int) if m < n else np.arange(n)
    core = pool[kernels.farthest(z[pool], core_n)]
    rest = np.setdiff1d(np.arange(n), core)
    r = np.round((z[rest] ** 2).sum(1), 9)
    top = rest[np.argsort(r, kind="stable")[-edge:]]
    return np.sort(np.concatenate([core, top])), c, sc, z


def test_boundary_memory_and_retrieval_equal_numpy(spark, blocked):
    s = settings()
    series = memory_series(blocked)
    feats = windows.scan(blocked.where("role = 'memory'"), L, H, features=True)
    bank, scales = memory.build_bank(feats, s.size, "boundary", most=STOP)
    got = {k: g.sort_values("slot") for k, g in bank.toPandas().groupby(["entity", "channel"])}
    want = {}
    for key, v in series.items():
        both = np.lib.stride_tricks.sliding_window_view(v, L + H)
        chosen, c, sc, z = boundary(kernels.features(both[:, :L]), s.size)
        assert list(got[key]["src_w"] - L) == list(chosen)
        delta = both[chosen, L:] - both[chosen, L - 1][:, None]
        assert np.allclose(np.array(got[key]["delta"].tolist()), delta)
        want[key] = (z[chosen], delta, chosen + L, c, sc)
    packed = memory.pack_bank(bank, scales)
    test = blocked.where("role = 'test'")
    full = retrieve.summarise(windows.scan(test, L, H, bank=packed, k=3, contexts=True), H)
    pdf = full.toPandas()
    assert len(pdf) > 100
    for _, r in pdf.iterrows():
        zb, delta, src, c, sc = want[(r["entity"], r["channel"])]
        q = (kernels.features(np.array(r["ctx"])[None])[0] - c) / sc
        d = np.round(np.sqrt(((zb - q) ** 2).mean(1)), 9)
        order = np.lexsort((src, d))[:3]
        assert [x["src_w"] for x in r["candidates"]] == list(src[order])
        w = np.exp(-(d[order] - d[order].min()) / 0.15)
        w /= w.sum()
        fut = delta[order] + r["ctx"][-1]
        mean = w @ fut
        assert np.allclose(r["analog"], mean)
        assert r["distance"] == pytest.approx(w @ d[order])
        assert np.allclose(r["divergence"], np.sqrt(w @ (fut - mean) ** 2), atol=1e-6)


def test_global_memory_uses_all_channels(spark, blocked):
    feats = windows.scan(blocked.where("role = 'memory'"), L, H, features=True)
    series = memory_series(blocked)
    both = {k: np.lib.stride_tricks.sliding_window_view(v, L + H) for k, v in series.items()}
    for selection in ("uniform", "farthest", "boundary"):
        bank, scales = memory.build_global_bank(feats, 20, selection, most=STOP)
        pdf = bank.toPandas()
        want = {}
        for e in ("e0", "e1"):
            raw = np.hstack([kernels.features(both[(e, c)][:, :L]) for c in "xyz"])
            chosen, c, sc, z = boundary(raw, 20)
            if selection != "boundary":
                m = 20 if selection == "uniform" else 80
                chosen = np.floor((np.arange(m) + 0.5) * len(z) / m).astype(int)
            if selection == "farthest":
                chosen = np.sort(chosen[kernels.farthest(z[chosen], 20)])
            want[e] = (z[chosen], chosen + L, c, sc)
            for i, c in enumerate("xyz"):
                g = pdf[(pdf["entity"] == e) & (pdf["channel"] == c)].sort_values("slot")
                assert list(g["src_w"] - L) == list(chosen), (selection, e, c)
                assert np.allclose(np.array(g["feat"].tolist()), z[chosen][:, 21 * i:21 * i + 21])
                v = both[(e, c)][chosen]
                assert np.allclose(np.array(g["delta"].tolist()), v[:, L:] - v[:, L - 1:L])
    seen = windows.scan_joint(blocked.where("role = 'test'"), L, H, memory.pack_bank(bank, scales), 3).toPandas()
    raw = windows.scan(blocked.where("role = 'test'"), L, H, features=True).toPandas()
    raw = {(r["entity"], r["channel"], r["w"]): r["feat"] for _, r in raw.iterrows()}
    assert len(seen) == len(raw) > 100
    for _, r in seen.iterrows():
        zb, src, c, sc = want[r["entity"]]
        q = (np.hstack([raw[(r["entity"], x, r["w"])] for x in "xyz"]) - c) / sc
        d = np.round(np.sqrt(((zb - q) ** 2).mean(1)), 9)
        order = np.lexsort((src, d))[:3]
        assert [x["src_w"] for x in r["candidates"]] == list(src[order])
        assert np.allclose([x["distance"] for x in r["candidates"]], d[order], atol=1e-8)


def test_detection_finds_planted_anomalies(spark):
    series, labels = make(spark)
    for cond, extra in (("native", {}), ("retrieval", {}), ("retrieval", {"mode": "global"}),
                        ("retrieval", {"learn_gate": True})):
        out = plan.detect(series, labels, settings(**extra), cond)
        m = evaluate.summary(out, ["entity"]).collect()
        assert len(m) == 2
        for r in m:
            assert r["n_total"] == 100 and r["n_dropped"] > 0
            assert r["auroc"] > 0.8, (cond, extra)


def test_block_size_changes_nothing(spark):
    series, labels = make(spark)
    frames = []
    for b in (16, 4096):
        out = plan.detect(series, labels, settings(block=b))
        frames.append(out.toPandas().sort_values(["entity", "t"], ignore_index=True))
    a, b = frames
    assert list(a["t"]) == list(b["t"])
    assert np.allclose(a["score"].astype(float), b["score"].astype(float), equal_nan=True, atol=1e-7)


def test_separate_halves_equal_one_series(spark):
    series, labels = make(spark)
    late = F.col("t") >= STOP
    joined, marks = scale.join_halves(
        series.where(~late), series.where(late).withColumn("t", F.col("t") - STOP),
        labels.where(late).withColumn("t", F.col("t") - STOP))
    one = plan.detect(series, labels, settings()).toPandas().sort_values(
        ["entity", "t"], ignore_index=True)
    two = plan.detect(joined, marks, settings(train_stop=0)).toPandas().sort_values(
        ["entity", "t"], ignore_index=True)
    assert np.allclose(one["score"].astype(float), two["score"].astype(float), equal_nan=True,
                       atol=1e-9)


def test_a_hot_entity_gives_the_same_scores_as_alone(spark):
    series, labels = make(spark)
    alone = plan.detect(series.where("entity = 'e0'"), labels.where("entity = 'e0'"), settings())
    both = plan.detect(series, labels, settings()).where("entity = 'e0'")
    a = alone.toPandas().sort_values("t", ignore_index=True)
    b = both.toPandas().sort_values("t", ignore_index=True)
    assert np.allclose(a["score"].astype(float), b["score"].astype(float), equal_nan=True, atol=1e-9)


def test_comparison_and_ablation_cover_every_method(spark):
    series, labels = make(spark)
    got = compare.compare(series, labels, settings()).toPandas()
    assert got.groupby("entity")["method"].nunique().tolist() == [9, 9]
    assert (got[got["method"] == "native"]["memory_weight"] == 0).all()
    abl = ablation.components(series, labels, settings()).toPandas()
    assert abl.groupby("entity")["variant"].nunique().tolist() == [7, 7]
