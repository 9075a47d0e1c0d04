"""Native forecast and eight retrieval methods scored by one pass with ``method`` as a key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.operators import evaluate, forecast, fuse, retrieve
from spark_analog.operators.staging import attach, stage
from spark_analog.plans.detect import (
    Settings, build_memory, check, choose_and_apply, forecast_windows, label_points, prepare,
    scored_parts,
)

GROUP = ["entity", "method", "role", "segment", "channel"]
METHODS = ("native", "nearest", "uniform", "idw", "softmax", "sparse", "adaptive_gate",
           "prototypes", "nn_score")


def method_frames(blocked: DataFrame, s: Settings) -> DataFrame:
    """``forecasts`` of all methods: ``entity, method, role, ..., y, yhat, nearest``."""
    roles = ("adapt", "normal", "score", "test")
    model = forecast.linear_forecaster(blocked.where("role = 'base'"), s.context, s.horizon)
    seen = stage(forecast_windows(blocked, s, build_memory(blocked, s), model, roles))
    normal = F.col("role") == "normal"

    def with_tau(frame, mode):
        tau = fuse.choose_temperature(frame.where(normal), s.horizon, mode, s.k)
        return attach(frame, tau.select("entity", "temperature"), ["entity"]).withColumn(
            "yhat", fuse.candidate_forecast("native", s.horizon, mode, F.col("temperature"), s.k))

    named = {
        "native": seen.withColumn("yhat", F.col("native")),
        "nearest": seen.withColumn("yhat", fuse.candidate_forecast("native", s.horizon, "nearest")),
        "uniform": seen.withColumn("yhat", fuse.candidate_forecast("native", s.horizon, "uniform")),
        "idw": seen.withColumn("yhat", fuse.candidate_forecast("native", s.horizon, "idw")),
    }
    soft = stage(with_tau(seen, "softmax"))
    named["softmax"] = soft
    named["sparse"] = with_tau(seen, "sparse")
    mixed = soft.withColumn("analog", F.col("yhat"))
    gate = fuse.fit_logistic(fuse.gate_features(mixed.where("role = 'adapt'")),
                             fuse.GATE_FEATURES, "better")
    named["adaptive_gate"] = fuse.adaptive_mix(mixed.drop("yhat"), gate)
    proto = forecast_windows(blocked, s, build_memory(
        blocked, s, "base", min(64, s.size), "farthest"), model, roles)
    named["prototypes"] = with_tau(stage(proto), "softmax")
    named["nn_score"] = named["native"]
    keep = ["entity", "role", "segment", "channel", "w", "y", "yhat", "nearest", "divergence"]
    parts = [f.select(F.lit(m).alias("method"), *keep) for m, f in named.items()]
    return stage(reduce(DataFrame.unionByName, parts).where("role <> 'adapt'"))


def compare(series: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """One row per (entity, method): metrics, selected parameters, normal MAE.

    Agreement is not used here; only the native forecast is scored without the
    memory distance.
    """
    check(series, labels, s)
    frames = method_frames(prepare(series, s), s)
    results = []
    for use, who in ((False, F.col("method") == "native"), (True, F.col("method") != "native")):
        f = frames.where(who)
        keys = ["entity", "method"]
        parts = scored_parts(f, use, [*keys, "channel"], GROUP, use_agreement=False,
                             most=s.train_stop * s.horizon or None)
        points, params = choose_and_apply(parts, labels, s, use, False, keys, ["method"])
        names = ["native"] if not use else [m for m in METHODS if m != "native"]
        scored = label_points(points, labels, s, ["method"], {"method": names})
        metrics = evaluate.average_precision(scored, keys)
        results.append(metrics.join(params, keys))
    both = reduce(DataFrame.unionByName, results)
    loss = fuse.mae(frames.where("role = 'normal'"), ["entity", "method"])
    return both.join(loss.select("entity", "method", F.col("mae").alias("normal_mae")),
                     ["entity", "method"])
