"""From forecast errors and retrieval signals to calibrated point scores."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.defaults import (
    AGREEMENT_GRID, CDF_CLIP, DOUBLE_EPS, FALLBACK_PARAMETERS, FLOAT32_MAX, MAD_CONSISTENCY,
    MEMORY_GRID, SMOOTHING_GRID, TAIL_CAP, TOP_Q_GRID,
)
from spark_analog.functions import kernels
from spark_analog.functions.columns import at_least, axis_values, clip, col, let
from spark_analog.operators.ordered import DIRECT_ROWS, PIECE_ROWS, quantiles, ranks_among
from spark_analog.operators.staging import attach, stage

WINDOW = ("entity", "role", "segment", "channel", "w")
CHANNEL = ("entity", "channel")
POINT = ("entity", "role", "segment", "t")


# --- residuals ----------------------------------------------------------------------------
def magnitude(error: Column, kind: str = "absolute") -> Column:
    return F.abs(error) if kind == "absolute" else error * error


def residual_steps(frame: DataFrame, keep=WINDOW, extra=(), kind: str = "absolute",
                   offset: int = 0, yhat: str = "yhat") -> DataFrame:
    """One row per forecast step: ``t = w + offset + h``, ``r`` and the step arrays in ``extra``."""
    zipped = F.arrays_zip(yhat, "y", *extra)
    s = frame.select(*keep, F.posexplode(zipped).alias("h", "__s"))
    return s.select(*keep, "h", (F.col("w") + offset + F.col("h")).alias("t"),
                    magnitude(F.col(f"__s.{yhat}") - F.col("__s.y"), kind).alias("r"),
                    *[F.col(f"__s.{e}").alias(e) for e in extra])


def mad_stats(residuals: DataFrame, keys=CHANNEL, value: str = "r", floor: float = 1e-6,
              most: int | None = None) -> DataFrame:
    """Median and 1.4826 MAD per channel; mean absolute deviation, then ``floor``, if zero."""
    centre = stage(quantiles(residuals, keys, value, [0.5], ["center"], most=most))
    away = residuals.join(centre, list(keys)).select(
        *keys, "center", F.abs(F.col(value) - F.col("center")).alias("__d"))
    mad = quantiles(away, keys, "__d", [0.5], ["__mad"], most=most)
    mean = away.groupBy(*keys, "center").agg(F.avg("__d").alias("__mean"))
    m = F.lit(MAD_CONSISTENCY) * F.col("__mad")
    scale = F.when(m > floor, m).when(F.col("__mean") > floor, F.col("__mean")).otherwise(floor)
    return mean.join(mad, list(keys)).select(*keys, "center", scale.alias("scale"))


def z_score(r="r", clip_negative: bool = True) -> Column:
    z = (col(r) - F.col("center")) / (F.col("scale") + F.lit(DOUBLE_EPS))
    return at_least(z, 0.0) if clip_negative else z


def with_confidence(z: Column, confidence, mode: str = "none", floor: float = 0.1) -> Column:
    c = clip(confidence, 0.0, 1.0)
    return {"none": z, "uncertainty": z * (F.lit(2.0) - c),
            "inverse": z / clip(c, floor, 1.0), "gate": z * c}[mode]


def with_agreement(z: Column, agreement, weight: float) -> Column:
    return z * (F.lit(1.0) + F.lit(float(weight)) * clip(agreement, 0.0, 1.0))


def with_terms(z: Column, memory=None, memory_weight: float = 0.0, divergence=None,
               divergence_weight: float = 0.0) -> Column:
    if memory is not None and memory_weight:
        z = z + F.lit(float(memory_weight)) * col(memory)
    if divergence is not None and divergence_weight:
        z = z + F.lit(float(divergence_weight)) * col(divergence)
    return z


def overlap_add(steps: DataFrame, values, keys=("entity", "role", "segment", "channel")
                ) -> DataFrame:
    """Average of all windows that forecast a point; ``n`` finite contributions.

    Map-side partial sums absorb most of the H-fold overlap, because the windows
    of a block come out of one task.
    """
    first = values[0]
    return steps.groupBy(*keys, "t").agg(
        *[F.avg(v).alias(v) for v in values], F.count(first).alias("n"))


# --- calibration --------------------------------------------------------------------------
def calibrate(values: DataFrame, reference: DataFrame, value: str, out: str, tail: bool,
              keys=CHANNEL, rows: int = PIECE_ROWS) -> DataFrame:
    """Empirical distribution of ``reference`` applied to ``values``.

    ``cdf = (#ref <= x + 0.5) / (n + 1)`` clipped; tail score ``-log(1 - cdf)``
    or agreement ``1 - cdf``.  A missing value takes the upper median; without a reference the
    score is 0 and the agreement 0.5.
    """
    ranked = ranks_among(values, reference, keys, value, "__rank", "__size", rows)
    cdf = clip((F.col("__rank") + F.lit(0.5)) / (F.col("__size") + F.lit(1.0)), CDF_CLIP, 1.0 - CDF_CLIP)
    score = clip(-F.log1p(-cdf), 0.0, TAIL_CAP) if tail else F.lit(1.0) - cdf
    empty = F.lit(0.0 if tail else 0.5)
    return ranked.select(*values.columns, F.coalesce(score, empty).alias(out))


# --- components and combination ---------------------------------------------------------------
def signal_steps(frame: DataFrame, normal: DataFrame | None, keys=CHANNEL,
                 group=("entity", "role", "segment", "channel")) -> DataFrame:
    """Forecast steps with calibrated signals: ``r, memory, agreement``.

    ``normal`` (windows of normal validation) calibrates the nearest distance
    and the divergence; without it both signals are zero.  A window without a
    neighbour is farther than any reference.
    """
    if normal is None:
        steps = residual_steps(frame, [*group, "w"])
        return steps.withColumn("memory", F.lit(0.0)).withColumn("agreement", F.lit(0.0))
    far = F.coalesce("nearest", F.lit(FLOAT32_MAX))
    windows = calibrate(frame.withColumn("nearest", far), normal.withColumn("nearest", far),
                        "nearest", "memory", True, keys)
    steps = residual_steps(windows, [*group, "w", "memory"], ["divergence"])
    spread = normal.select(*keys, F.explode("divergence").alias("divergence"))
    return calibrate(steps, spread, "divergence", "agreement", False, keys)


def components(steps: DataFrame, stats: DataFrame, keys=CHANNEL,
               group=("entity", "role", "segment", "channel")) -> DataFrame:
    """Residual, memory and agreement parts per point and channel."""
    z = attach(steps, stats, keys).withColumn("residual", z_score())
    z = z.withColumn("agreement", F.col("residual") * clip("agreement", 0.0, 1.0))
    return overlap_add(z, ["residual", "memory", "agreement"], group)


#: Steps of a key whose windows meet in one task.
SPAN = 65_536


def point_components(frame: DataFrame, normal: DataFrame | None, stats: DataFrame, keys=CHANNEL,
                     group=("entity", "role", "segment", "channel"), use_agreement: bool = True,
                     most: int | None = None, span: int = SPAN) -> DataFrame:
    """``components`` of the ``signal_steps`` of some windows; agreement may be left at 0.

    Where ``most`` bounds the normal steps of a key to what fits a task, they meet there with the key's
    windows of ``span`` steps: both are calibrated as arrays and averaged per point, and no row per
    forecast step is sorted, joined or shuffled.  A window that reaches into the next steps is in both tasks."""
    if most is None or most > DIRECT_ROWS:
        steps = signal_steps(frame, normal, keys, group)
        if not use_agreement:
            steps = steps.withColumn("agreement", F.lit(0.0))
        return components(steps, stats, keys, group)
    keys, group = list(keys), list(group)
    signals = normal is not None
    taken = ["nearest", "divergence"] if signals else []
    spread = [F.col("divergence")] if signals else []
    last = F.col("w") + F.greatest(*[F.size(c) for c in (F.col("yhat"), F.col("y"), *spread)]) - 1
    late = attach(frame.select(
        *group, "w", "yhat", "y", *taken,
        F.explode(F.sequence(F.floor(F.col("w") / span), F.floor(last / span))).alias("__b")), stats, keys)
    rows = late.withColumn("__ref", F.lit(False))
    if signals:
        slots = stage(late.select(*keys, "__b").distinct())
        rows = rows.unionByName(normal.select(*keys, *taken).join(slots, keys).withColumn("__ref", F.lit(True)),
                                allowMissingColumns=True)
    rest = [c for c in group if c not in keys]
    schema = T.StructType([rows.schema[c] for c in group] + [T.StructField("t", T.LongType())] + [
        T.StructField(c, T.DoubleType()) for c in ("residual", "memory", "agreement")] + [
        T.StructField("n", T.LongType())])

    def run(key, table):
        ref = table.column("__ref").to_numpy()
        own, block = table.filter(pa.array(~ref)), key[-1].as_py()
        wide, there = _side_by_side([own.column(c) for c in ("yhat", "y", *taken[1:])])
        center, scale = (own.column(c).to_numpy() for c in ("center", "scale"))
        z = (np.abs(wide[0] - wide[1]) - center[:, None]) / (scale + DOUBLE_EPS)[:, None]
        residual = np.where(np.isnan(z), np.nan, np.maximum(z, 0.0))
        memory = agreement = np.zeros(residual.shape)
        if signals:
            normal = table.filter(pa.array(ref))
            far = [_real(t.column("nearest"), FLOAT32_MAX) for t in (own, normal)]
            memory = np.broadcast_to(_calibrated(*far, True)[:, None], residual.shape)
            if use_agreement:
                agreement = _calibrated(wide[2], _real(normal.column("divergence").combine_chunks().flatten(), np.nan), False)
        agreement = residual * np.clip(agreement, 0.0, 1.0)
        t = own.column("w").to_numpy()[:, None] + np.arange(residual.shape[1])
        there &= t // span == block
        codes = np.zeros(own.num_rows, np.int64)
        for c in rest:
            found = own.column(c).combine_chunks().dictionary_encode()
            codes = codes * (len(found.dictionary) + 1) + found.indices.fill_null(len(found.dictionary)).to_numpy()
        code, at = np.broadcast_to(codes[:, None], t.shape)[there], t[there]
        points, first = kernels.places(code, at)
        means = [kernels.means_at(points, values[there], len(first)) for values in (residual, memory, agreement)]
        rows_of = own.take(pa.array(np.nonzero(there)[0][first]))
        lead = [pa.array([key[keys.index(c)].as_py()] * len(first), key[keys.index(c)].type) if c in keys
                else rows_of.column(c).combine_chunks() for c in group]
        return pa.Table.from_arrays([*lead, pa.array(at[first].astype(np.int64)),
                                     *(pa.array(mean, from_pandas=True) for mean, _ in means), pa.array(means[0][1])],
                                    names=schema.names)

    return rows.groupBy(*keys, "__b").applyInArrow(run, schema)


def _real(column, missing: float) -> np.ndarray:
    values = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    values = values.astype(np.float64)
    return np.where(np.isnan(values), missing, values)


def _side_by_side(columns) -> tuple[list[np.ndarray], np.ndarray]:
    """Lists as one matrix each, NaN where missing, and the places that ``arrays_zip`` has: up to the longest list,
    none where one is NULL."""
    arrays = [c.combine_chunks() for c in columns]
    sizes = np.array([_real(a.value_lengths(), -1.0) for a in arrays]).astype(np.int64).reshape(len(arrays), -1)
    most = int(sizes.max(initial=0))
    out = []
    for a, size in zip(arrays, sizes):
        m = np.full((len(a), most), np.nan)
        m[np.arange(most) < size[:, None]] = _real(a.flatten(), np.nan)
        out.append(m)
    longest = np.where((sizes < 0).any(axis=0), 0, sizes.max(axis=0, initial=0))
    return out, np.arange(most) < longest[:, None]


def _calibrated(values: np.ndarray, reference: np.ndarray, tail: bool) -> np.ndarray:
    """As ``calibrate``, with NaN for a missing value."""
    ordered = np.sort(reference[~np.isnan(reference)])
    n = len(ordered)
    if not n:
        return np.full(values.shape, 0.0 if tail else 0.5)
    known = np.where(np.isnan(values), ordered[n // 2], values)  # the upper median
    cdf = np.clip((np.searchsorted(ordered, known, "right") + 0.5) / (n + 1.0), CDF_CLIP, 1.0 - CDF_CLIP)
    return np.clip(-np.log1p(-cdf), 0.0, TAIL_CAP) if tail else 1.0 - cdf


def channel_lists(parts: DataFrame, group=POINT) -> DataFrame:
    """All channels of a point in one row; bounded by the number of channels."""
    return parts.groupBy(*group).agg(F.collect_list(
        F.struct("residual", "memory", "agreement")).alias("parts"))


def combined(memory_weight, agreement_weight, parts="parts") -> Column:
    m, a = [w if isinstance(w, Column) else F.lit(float(w))
            for w in (memory_weight, agreement_weight)]
    return F.transform(parts, lambda p: p["residual"] + m * p["memory"] + a * p["agreement"])


def top_q_mean(scores: Column, q, digits: int | None = None) -> Column:
    """Mean of the ``max(1, ceil(q C))`` largest finite channel scores (``q`` int: that many)."""
    c = F.size(scores)
    k = F.lit(q) if isinstance(q, int) else F.ceil((q if isinstance(q, Column) else F.lit(q)) * c)
    k = F.greatest(F.lit(1), F.least(k, c)).cast("int")
    return _top_mean(F.sort_array(F.filter(scores, lambda x: x.isNotNull()), asc=False), k, digits)


def _top_mean(ordered: Column, k: Column, digits: int | None) -> Column:
    """Mean of the first ``k`` of a descending array without NULLs."""
    mean = let(F.slice(ordered, 1, k), lambda top: F.aggregate(
        top, F.lit(0.0), lambda a, x: a + x) / F.nullif(F.size(top), F.lit(0)))
    return mean if digits is None else F.round(mean, digits)


def causal_smooth(points: DataFrame, widths, keys=("entity", "role", "segment"),
                  value: str = "score", time: str = "t", block: int = 65_536) -> DataFrame:
    """Moving averages over the last ``width`` steps, finite values only: ``smooth_<width>``.

    A segment is cut into time blocks that also receive the ``width - 1`` steps
    before them, so a long segment is never sorted by one task.
    """
    reach = max(widths) - 1
    spread = points.withColumn("__b", F.explode(F.sequence(
        F.floor(F.col(time) / block), F.floor((F.col(time) + reach) / block))))
    over = Window.partitionBy(*keys, "__b").orderBy(time)
    cols = [F.col(value).alias(f"smooth_{w}") if w <= 1 else
            F.avg(value).over(over.rangeBetween(-(w - 1), 0)).alias(f"smooth_{w}")
            for w in widths]
    done = spread.select("*", *cols).where(F.col("__b") == F.floor(F.col(time) / block))
    return done.drop("__b")


def apply_parameters(parts: DataFrame, parameters: DataFrame, keys=("entity",), group=POINT,
                     widths=SMOOTHING_GRID) -> DataFrame:
    """Point scores with per-key parameters ``top_q, memory_weight, agreement_weight, smoothing``."""
    rows = attach(channel_lists(parts, group), parameters, keys)
    raw = rows.select(*group, "smoothing", top_q_mean(
        combined(F.col("memory_weight"), F.col("agreement_weight")), F.col("top_q")).alias("score"))
    segment = [g for g in group if g != "t"]
    smooth = causal_smooth(raw, widths, segment)
    picked = F.coalesce(*[F.when(F.col("smoothing") == w, F.col(f"smooth_{w}")) for w in widths])
    return smooth.select(*group, picked.alias("score"))


# --- selection ----------------------------------------------------------------------------
def grid_parameters(grid_id: Column, top_q=TOP_Q_GRID, memory=MEMORY_GRID,
                    agreement=AGREEMENT_GRID, smoothing=SMOOTHING_GRID) -> list[Column]:
    """Parameters of a grid point in loop order."""
    return axis_values(grid_id, top_q=[float(q) for q in top_q],
                       memory_weight=[float(m) for m in memory],
                       agreement_weight=[float(a) for a in agreement],
                       smoothing=[int(s) for s in smoothing])


def select_parameters(scored: DataFrame, keys=("entity",), use_retrieval: bool = True, digits: int = 9,
                      **axes) -> DataFrame:
    """Best grid point per key, the first in loop order on ties; fixed values without classes.

    ``scored``: objective of every grid point, as ``grid_search.grid_objectives`` gives it."""
    keys = list(keys)
    best = F.max(F.when(F.col("objective").isNotNull(), F.struct(
        F.round("objective", digits).alias("objective"), (-F.col("grid_id")).alias("neg")))).alias("b")
    fall = FALLBACK_PARAMETERS
    w = 1.0 if use_retrieval else 0.0
    fixed = {"top_q": fall["top_q"], "memory_weight": fall["memory_weight"] * w,
             "agreement_weight": fall["agreement_weight"] * w, "smoothing": fall["smoothing"]}
    chosen = scored.groupBy(*keys).agg(best).select(
        *keys, (-F.col("b.neg")).alias("grid_id"), F.col("b.objective").alias("objective"))
    params = chosen.select("*", *grid_parameters(F.coalesce("grid_id", F.lit(0)), **axes))
    return params.select(*keys, "grid_id", *[
        F.when(F.col("grid_id").isNull(), F.lit(v)).otherwise(F.col(n)).alias(n)
        for n, v in fixed.items()], "objective")


def select_blend(objective_rows: DataFrame, keys=("entity",), amount: str = "blend",
                 objective: str = "objective") -> DataFrame:
    """Ordered fold: a larger blend must gain more than 1e-12 over the best so far."""
    seq = F.array_sort(F.collect_list(F.struct(F.col(amount).alias("a"), F.coalesce(
        F.col(objective), F.lit(float("-inf"))).alias("o"))))
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(float("-inf")).alias("o"))
    best = F.aggregate(seq, start, lambda acc, x: F.when(
        acc["a"].isNull() | (x["o"] > acc["o"] + F.lit(1e-12)), x).otherwise(acc))
    return objective_rows.groupBy(*keys).agg(best.alias("b")).select(
        *keys, F.col("b.a").alias("selected"), F.when(
            F.col("b.o") > F.lit(float("-inf")), F.col("b.o")).alias("objective"))
