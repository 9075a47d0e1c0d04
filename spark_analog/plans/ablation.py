"""Component switches and parameter sweeps over shared frames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.operators import evaluate, forecast, fuse, retrieve, score
from spark_analog.operators.staging import stage
from spark_analog.plans.detect import (
    Settings, build_memory, check, choose_and_apply, forecast_windows, global_windows, label_points,
    prepare, scored_parts,
)

GROUP = ["entity", "variant", "role", "segment", "channel"]


def variant_frames(series: DataFrame, s: Settings) -> DataFrame:
    """Fused forecasts of every variant; blocks, base model and neighbours are shared."""
    blocked = prepare(series, s)
    model = forecast.linear_forecaster(blocked.where("role = 'base'"), s.context, s.horizon)
    full = stage(forecast_windows(blocked, s, build_memory(blocked, s), model))
    core = forecast_windows(blocked, s, build_memory(blocked, s, selection="farthest"), model)
    whole = global_windows(blocked, s, model)

    def fuse_with(frame, mode="select", gamma=s.gamma):
        return fuse.fusion(frame, s.horizon, gamma, mode=mode, k=s.k)

    named = {
        "full": fuse_with(full),
        "no_boundary_samples": fuse_with(core),
        "no_channelwise_retrieval": fuse_with(whole),
        "no_candidate_selection": fuse_with(full, "uniform"),
        "no_continuous_gate": fuse_with(full, gamma=1.0),
        "no_memory_distance": fuse_with(full, "uniform"),
        "no_reference_divergence": fuse_with(full),
    }
    keep = ["entity", "role", "segment", "channel", "w", "y", "yhat", "nearest", "divergence"]
    return stage(reduce(DataFrame.unionByName, [
        f.select(F.lit(v).alias("variant"), *keep) for v, f in named.items()]))


VARIANTS = ("full", "no_boundary_samples", "no_channelwise_retrieval", "no_candidate_selection",
            "no_continuous_gate", "no_memory_distance", "no_reference_divergence")


def components(series: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """Metrics and selected parameters per (entity, variant). Entities that can't be served raise.

    Removing the distance also fixes its score weight at zero; removing the
    divergence does the same for agreement.
    """
    series = stage(series)
    check(series, labels, s)
    frames = variant_frames(series, s)
    keys = ["entity", "variant"]
    parts = scored_parts(frames, True, [*keys, "channel"], GROUP, most=s.train_stop * s.horizon or None)
    off = lambda c, v: F.when(F.col("variant") == v, F.lit(0.0)).otherwise(F.col(c)).alias(c)
    parts = parts.select(*[off("memory", "no_memory_distance") if c == "memory" else
                           off("agreement", "no_reference_divergence") if c == "agreement" else
                           F.col(c) for c in parts.columns])
    points, params = choose_and_apply(parts, labels, s, True, True, keys, ["variant"])
    scored = label_points(points, labels, s, ["variant"], {"variant": list(VARIANTS)})
    return evaluate.average_precision(scored, keys).join(params, keys)


def sensitivity_k(widest: DataFrame, horizon: int, ks, temperature: float = 0.15,
                  keys=("entity", "role")) -> DataFrame:
    """MAE of the analogue for several K from one search at the largest."""
    k = F.explode(F.array(*[F.lit(int(v)) for v in ks])).alias("k")
    cut = widest.select(*keys, "y", "candidates", k).withColumn(
        "candidates", F.filter("candidates", lambda c: c["rank"] <= F.col("k")))
    yhat = retrieve.analogue(retrieve.candidate_weights("softmax", temperature), horizon)
    return fuse.mae(cut.withColumn("yhat", yhat), [*keys, "k"])


def sensitivity_weight(parts: DataFrame, labels: DataFrame, weights, agreement: float = 0.25,
                       top_q: float = 0.4) -> DataFrame:
    """Metrics for several fixed memory weights."""
    w = F.explode(F.array(*[F.lit(float(v)) for v in weights])).alias("weight")
    rows = score.channel_lists(parts).select("entity", "t", "parts", w)
    points = rows.select("entity", "t", "weight", score.top_q_mean(
        score.combined(F.col("weight"), agreement), top_q, 9).alias("score"))
    return evaluate.average_precision(points.join(labels, ["entity", "t"]), ["entity", "weight"])
