"""Combining a base forecast with retrieved futures."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.defaults import (
    INITIAL_GATE, QUALITY_MARGIN, QUALITY_TEMPERATURE, TEMPERATURE_GRID,
)
from spark_analog.functions.columns import (
    array_diff_mean, array_mean, clip, log1p_clamped, sigmoid,
)
from spark_analog.functions import kernels
from spark_analog.operators import retrieve
from spark_analog.operators.retrieve import weighted
from spark_analog.operators.staging import attach, stage


def candidate_forecast(native, horizon: int, mode: str, temperature=0.15, k: int = 5,
                       candidates="candidates") -> Column:
    """Weighted futures; the native forecast where there is no reference."""
    return F.coalesce(weighted(mode, horizon, temperature, k, candidates)["mean"], F.col(native))


def absolute_error(yhat="yhat", y="y") -> Column:
    """Mean over finite steps of one window."""
    return array_diff_mean(yhat, y, lambda a, b: F.abs(a - b))


def mae(frame: DataFrame, keys=(), yhat="yhat", y="y") -> DataFrame:
    e = frame.select(*keys, F.explode(F.zip_with(yhat, y, lambda a, b: F.abs(a - b))).alias("e"))
    return e.groupBy(*keys).agg(F.avg("e").alias("mae"), F.count("e").alias("n"))


def choose_temperature(normal: DataFrame, horizon: int, mode: str = "softmax", k: int = 5,
                       keys=("entity",), grid=TEMPERATURE_GRID) -> DataFrame:
    """Temperature with the least MAE on normal validation, the smaller one on ties."""
    tau = F.explode(F.array(*[F.lit(float(g)) for g in grid])).alias("temperature")
    tried = normal.select(*keys, "y", "native", "candidates", tau).withColumn(
        "yhat", candidate_forecast("native", horizon, mode, F.col("temperature"), k))
    losses = mae(tried, [*keys, "temperature"])
    best = F.min(F.struct(F.round("mae", 9).alias("mae"), "temperature")).alias("b")
    return losses.groupBy(*keys).agg(best).select(
        *keys, F.col("b.temperature").alias("temperature"), F.col("b.mae").alias("mae"))


# --- gate ---------------------------------------------------------------------------------
GATE_FEATURES = ("log_nearest", "log_divergence", "disagreement")


def gate_features(frame: DataFrame) -> DataFrame:
    """Three signals and whether the analogue beat the native forecast.

    Needs ``nearest, divergence, analog, native, y``.
    """
    near = F.log1p(clip(F.coalesce("nearest", F.lit(1e6)), 0.0, 1e6))
    spread = F.log1p(clip(array_mean("divergence"), 0.0, 1e6))
    gap = array_diff_mean("analog", "native", lambda a, b: F.abs(a - b))
    better = F.round(absolute_error("analog"), 9) < F.round(absolute_error("native"), 9)
    return (frame.withColumn("log_nearest", near).withColumn("log_divergence", spread)
            .withColumn("disagreement", gap).withColumn("better", better.cast("int")))


def fit_logistic(rows: DataFrame, features, target: str, keys=("entity",),
                 balanced: bool = True, penalty: float = 1.0, tolerance: float = 1e-7,
                 give_up: int = 500) -> DataFrame:
    """One penalised logistic regression per key, for all keys at once.

    Standardised inputs, free intercept, ``penalty / 2 * |b|^2`` against the
    weighted sum of losses.  ``target`` may be soft (a probability).  Each
    Newton step is one aggregation of gradient and curvature sums per key, so
    nothing but one number per step reaches the driver.  Steps go on until the
    largest change of any key is below ``tolerance``; a fit that hasn't got there
    after ``give_up`` steps raises.  Output per key: ``mean, spread, coef``
    arrays, ``intercept``, ``constant`` (single class), ``steps`` taken.
    """
    keys, features = list(keys), list(features)
    kept = stage(rows.select(*keys, *features, F.col(target).cast("double").alias("__q")).dropna())
    stats = kept.groupBy(*keys).agg(
        F.array(*[F.avg(f) for f in features]).alias("mean"),
        F.array(*[F.stddev_pop(f) for f in features]).alias("spread"),
        F.count("*").alias("__n"), F.sum("__q").alias("__n1"))
    stats = stage(stats.withColumn("spread", F.transform(
        "spread", lambda s: F.when(s > 0, s).otherwise(F.lit(1.0)))))
    p = len(features) + 1
    weight = (F.when(F.col("__q") > 0.5, F.col("__n") / (2 * F.col("__n1"))).otherwise(
        F.col("__n") / (2 * (F.col("__n") - F.col("__n1")))) if balanced else F.lit(1.0))
    mixed = stats.where("__n1 > 0 and __n1 < __n") if balanced else stats
    z = kept.join(mixed, keys).select(
        *keys, "__q", weight.alias("__w"), F.array(
            *[(F.col(f) - F.col("mean")[i]) / F.col("spread")[i] for i, f in enumerate(features)],
            F.lit(1.0)).alias("__z"))
    beta = stage(mixed.select(*keys, F.array_repeat(F.lit(0.0), p).alias("__b")))
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    cols = [f"g{i}" for i in range(p)] + [f"h{i}_{j}" for i, j in pairs]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in beta.schema.fields
                        if f.name in keys] + ["__b array<double>", "__step double"])

    def step(batches):
        ridge = np.diag([penalty] * (p - 1) + [0.0])
        for pdf in batches:
            if not len(pdf):
                continue
            b = np.stack(pdf["__b"].to_numpy()).astype(float)
            g = pdf[[f"g{i}" for i in range(p)]].to_numpy() + b @ ridge
            h = np.empty((len(pdf), p, p))
            for i, j in pairs:
                h[:, i, j] = h[:, j, i] = pdf[f"h{i}_{j}"].to_numpy()
            d = np.linalg.solve(h + ridge + 1e-10 * np.eye(p), g[:, :, None])[:, :, 0]
            wide = np.abs(d).max(axis=1, keepdims=True)
            d *= np.minimum(1.0, 4.0 / np.maximum(1e-12, wide))
            yield pd.DataFrame({**{k: pdf[k] for k in keys}, "__b": list(b - d),
                                "__step": np.abs(d).max(axis=1)})

    steps = 0
    while True:
        eta = F.aggregate(F.zip_with("__z", "__b", lambda a, b: a * b), F.lit(0.0),
                          lambda a, x: a + x)
        fitted = z.join(beta, keys).withColumn("__p", sigmoid(eta))
        slope = F.col("__w") * (F.col("__p") - F.col("__q"))
        curve = F.col("__w") * F.col("__p") * (1 - F.col("__p"))
        sums = fitted.groupBy(*keys, "__b").agg(
            *[F.sum(slope * F.col("__z")[i]).alias(f"g{i}") for i in range(p)],
            *[F.sum(curve * F.col("__z")[i] * F.col("__z")[j]).alias(f"h{i}_{j}")
              for i, j in pairs])
        moved = stage(sums.select(*keys, "__b", *cols).mapInPandas(step, schema))
        beta = moved.select(*keys, "__b")
        largest = moved.agg(F.max("__step")).first()[0]
        steps += 1
        if largest is None or largest < tolerance:
            break
        if steps >= give_up:
            raise RuntimeError(f"no convergence in {steps} steps: largest change {largest}")
    constant = F.when(F.col("__b").isNull(), F.col("__n1") / F.col("__n"))
    return stage(stats.join(beta, keys, "left").select(
        *keys, "mean", "spread", F.slice("__b", 1, p - 1).alias("coef"),
        F.element_at("__b", p).alias("intercept"), constant.alias("constant"),
        F.lit(steps).alias("steps")))


def gate_probability(features) -> Column:
    z = F.lit(0.0)
    for i, f in enumerate(features):
        z = z + F.col("coef")[i] * (F.col(f) - F.col("mean")[i]) / F.col("spread")[i]
    return F.coalesce("constant", sigmoid(z + F.col("intercept")))


def adaptive_mix(frame: DataFrame, gate: DataFrame, keys=("entity",)) -> DataFrame:
    """``native + p (analog - native)`` with the learned probability ``gate``."""
    f = attach(gate_features(frame), gate, keys).withColumn(
        "gate", gate_probability(GATE_FEATURES))
    mixed = F.zip_with("native", "analog", lambda n, a: n + F.col("gate") * (a - n))
    return f.select(*frame.columns, "gate", mixed.alias("yhat"))


# --- selective fusion ---------------------------------------------------------------------
def fusion(frame: DataFrame, horizon: int, gamma=INITIAL_GATE, eta=0.0, mode: str = "select",
           temperature=0.15, k: int = 5) -> DataFrame:
    """Gated residual ``native + g (proposal - native)``; exactly native without references.

    Needs ``native, candidates``; adds ``fusion_weights, reference, proposal,
    gate, yhat``.
    """
    g = gamma if isinstance(gamma, Column) else F.lit(float(gamma))
    e = eta if isinstance(eta, Column) else F.lit(float(eta))
    valid = F.size("candidates") > 0
    out = frame.withColumn("__f", weighted(mode, horizon, temperature, k))
    out = out.select(*frame.columns, F.col("__f.weights").alias("fusion_weights"),
                     F.coalesce("__f.mean", "native").alias("reference"))
    out = out.withColumn("proposal", F.zip_with(
        "native", "reference", lambda n, r: n + (F.lit(1.0) - e) * (r - n)))
    out = out.withColumn("gate", F.when(valid, g).otherwise(F.lit(0.0)))
    return out.withColumn("yhat", F.when(valid, F.zip_with(
        "native", "proposal", lambda n, p: n + F.col("gate") * (p - n))).otherwise(
        F.col("native")))


def fused_signals(horizon: int, gamma: float, mode: str, k: int, summary_temperature: float, temperature: float = 0.15):
    """``fusion`` of a ``summarise``d window for ``windows.scan(then=...)``: new columns and how to make them.

    From the same task that found the neighbours, so their futures are neither written nor read again:
    ``nearest, divergence, gate, fused`` (the ``yhat`` of ``fusion``)."""
    doubles = T.ArrayType(T.DoubleType())
    fields = [T.StructField("nearest", T.DoubleType()), T.StructField("divergence", doubles),
              T.StructField("gate", T.DoubleType()), T.StructField("fused", doubles)]

    def run(candidates: pa.ListArray, native: np.ndarray) -> list[pa.Array]:
        near = retrieve._Neighbours(candidates, horizon)
        some, every = near.size > 0, np.ones(len(near.size), bool)
        _, _, _, low, spread = retrieve._summary(near, summary_temperature)
        weights = near.weights(mode, np.full(len(some), float(temperature)), k)
        reference = np.where(some[:, None], near.mean(weights), native)
        proposal = native + (reference - native)
        fused = np.where(some[:, None], native + float(gamma) * (proposal - native), native)
        return [pa.array(low, mask=~some), retrieve._steps(kernels.rounded(spread), every),
                pa.array(np.where(some, float(gamma), 0.0)), retrieve._steps(fused, every)]

    return fields, run


def fusion_signals(frame: DataFrame) -> DataFrame:
    """Per candidate: log distance and disagreement; per window: nearest and mean divergence."""
    per = F.transform("candidates", lambda c: F.struct(
        c["rank"].alias("rank"), log1p_clamped(c["distance"], 1e12).alias("log_distance"),
        array_diff_mean(c["future"], F.col("native"), lambda a, b: F.abs(a - b)).alias(
            "disagreement")))
    near = F.coalesce(F.array_min(F.transform(
        "candidates", lambda c: log1p_clamped(c["distance"], 1e12))), F.lit(0.0))
    spread = array_mean(F.transform("divergence", lambda d: log1p_clamped(d, 1e12)))
    return (frame.withColumn("signals", per).withColumn("nearest_log", near)
            .withColumn("divergence_log", spread))


def blend(reference, adapted, amount) -> Column:
    return F.zip_with(reference, adapted, lambda r, a: r + amount * (a - r))


# --- losses and soft targets -----------------------------------------------------------------
def loss_term(error: Column, kind: str = "huber", delta: float = 1.0) -> Column:
    if kind == "mse":
        return error * error
    size = F.abs(error)
    return F.when(size <= delta, F.lit(0.5) * error * error).otherwise(
        F.lit(delta) * (size - F.lit(0.5 * delta)))


def window_loss(yhat, y, kind: str = "huber", delta: float = 1.0) -> Column:
    return array_diff_mean(yhat, y, lambda a, b: loss_term(a - b, kind, delta))


def forecast_loss(frame: DataFrame, keys=("entity",), kind: str = "huber", delta: float = 1.0,
                  yhat="yhat") -> DataFrame:
    """Mean loss over finite targets."""
    e = frame.select(*keys, F.explode(F.zip_with(yhat, "y", lambda a, b: a - b)).alias("e"))
    return e.groupBy(*keys).agg(F.avg(loss_term(F.col("e"), kind, delta)).alias("loss"),
                                F.count("e").alias("n"))


def _soft(margin: Column, quality_margin: float, temperature: float) -> Column:
    return sigmoid((clip(margin, -1.0, 1.0) - F.lit(quality_margin)) / F.lit(temperature))


def quality_targets(frame: DataFrame, kind: str = "huber", delta: float = 1.0,
                    margin: float = QUALITY_MARGIN, temperature: float = QUALITY_TEMPERATURE
                    ) -> DataFrame:
    """Soft targets: is the best reference, is the open proposal better than native?

    Needs ``native, candidates, proposal, y``; adds ``reference_quality, gate_target``.
    """
    known = F.forall("y", lambda v: v.isNotNull())
    valid = (F.size("candidates") > 0) & known
    bypass = window_loss("native", "y", kind, delta)
    best = F.array_min(F.transform("candidates", lambda c: window_loss(
        c["future"], F.col("y"), kind, delta)))
    full = window_loss("proposal", "y", kind, delta)

    def target(other):
        m = (bypass - other) / F.greatest(bypass + other, F.lit(1e-6))
        return F.when(valid, _soft(m, margin, temperature)).otherwise(F.lit(0.0))

    return frame.withColumn("reference_quality", target(best)).withColumn(
        "gate_target", target(full))
