"""What the nearest normal windows say: weights, analogue futures, distances, spread.

Inputs carry ``candidates ARRAY<STRUCT<rank, src_w, distance, future>>`` of at
most K entries, so everything here is a projection without a shuffle.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spark_analog.defaults import MEMORY_TEMPERATURE
from spark_analog.functions import kernels
from spark_analog.operators.staging import attach


def distances(candidates="candidates") -> Column:
    return F.transform(candidates, lambda c: c["distance"])


class _Neighbours:
    """The candidates of many windows side by side, ``[windows, most]`` with ``there`` where one is."""

    def __init__(self, candidates: pa.ListArray, horizon: int | None = None):
        self.missing = candidates.is_null().to_numpy(zero_copy_only=False)
        self.size = np.where(self.missing, 0, candidates.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        n, most = len(self.size), int(self.size.max(initial=0))
        self.there = np.arange(most) < self.size[:, None]
        flat = candidates.flatten()
        self.distance = self._wide(flat.field("distance"), np.nan)
        self.rank = self._wide(flat.field("rank"), 0)
        if horizon is not None:
            future = flat.field("future").flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            self.future = np.zeros((n, most, horizon))
            self.future[self.there] = future.reshape(-1, horizon)

    def _wide(self, flat: pa.Array, fill) -> np.ndarray:
        out = np.full(self.there.shape, fill, dtype=np.float64)
        out[self.there] = flat.to_numpy(zero_copy_only=False)
        return out

    def fold(self, values: np.ndarray) -> np.ndarray:
        """Sums over the candidates, the first one first."""
        total = np.zeros(values.shape[:1] + values.shape[2:])
        full = self.there.all(axis=0)
        for j in range(values.shape[1]):
            if full[j]:
                total += values[:, j]
            else:
                here = self.there[:, j]
                total[here] += values[here, j]
        return total

    def low(self) -> np.ndarray:
        return np.where(self.there, self.distance, np.inf).min(axis=1, initial=np.inf)

    def normalised(self, weights: np.ndarray) -> np.ndarray:
        total = self.fold(weights)[:, None]
        return np.where(total > 0, weights / np.where(total > 0, total, 1.0), 0.0)

    def weights(self, mode: str, tau, k: int) -> np.ndarray:
        if mode == "nearest":
            return (self.rank == 1).astype(np.float64)
        if mode == "uniform":
            return np.broadcast_to(1.0 / np.maximum(self.size, 1)[:, None], self.there.shape)
        d = np.where(self.there, self.distance, 0.0)
        low = np.where(self.size > 0, self.low(), 0.0)[:, None]
        if mode == "idw":
            return self.normalised(1.0 / (1e-4 + d / np.maximum(low, 1e-3)))
        if mode == "select":
            return self.normalised(1.0 / (1.0 + d))
        soft = self.normalised(np.exp(-(d - low) / np.maximum(tau, 1e-6)[:, None]))
        return soft if mode == "softmax" else self.normalised(np.where(soft >= 0.5 / k, soft, 0.0))

    def mean(self, weights: np.ndarray) -> np.ndarray:
        return self.fold(weights[:, :, None] * self.future)

    def spread(self, weights: np.ndarray, centre: np.ndarray) -> np.ndarray:
        away = self.future - centre[:, None, :]
        return np.sqrt(np.fmax(self.fold(weights[:, :, None] * away * away), 0.0))

    def lists(self, weights: np.ndarray) -> pa.Array:
        offsets = np.concatenate([[0], np.cumsum(self.size)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(weights[self.there], from_pandas=True),
                                        mask=pa.array(self.missing))


def _steps(matrix: np.ndarray, kept: np.ndarray) -> pa.Array:
    """One list per window, NULL where not ``kept``."""
    n, horizon = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * horizon),
                                    pa.array(matrix.reshape(-1), from_pandas=True), mask=pa.array(~kept))


MODES = ("nearest", "uniform", "idw", "select", "softmax", "sparse")
DOUBLES = T.ArrayType(T.DoubleType())


def _real(column: pa.Array) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False).astype(np.float64)


def candidate_weights(mode: str = "softmax", temperature=MEMORY_TEMPERATURE, k: int = 5,
                      candidates="candidates") -> Column:
    """Weights of the kept neighbours, summing to 1; an empty array without any.

    nearest, uniform, idw, softmax, sparse (softmax below 0.5 / K cut, then
    renormalised), select (proportional to 1 / (1 + d)).
    """
    if mode not in MODES:
        raise ValueError(f"unknown weighting {mode!r}")

    @F.arrow_udf(returnType=DOUBLES)
    def run(found: pa.Array, tau: pa.Array) -> pa.Array:
        near = _Neighbours(found)
        return near.lists(near.weights(mode, _real(tau), k))

    tau = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return run(candidates, tau.cast("double"))


WEIGHTED = T.StructType([T.StructField("weights", DOUBLES), T.StructField("mean", DOUBLES)])


def weighted(mode: str, horizon: int, temperature=MEMORY_TEMPERATURE, k: int = 5, candidates="candidates") -> Column:
    """``weights`` and the weighted ``mean`` future (NULL without neighbours) from one pass."""
    if mode not in MODES:
        raise ValueError(f"unknown weighting {mode!r}")

    @F.arrow_udf(returnType=WEIGHTED)
    def run(found: pa.Array, tau: pa.Array) -> pa.Array:
        near = _Neighbours(found, horizon)
        weights = near.weights(mode, _real(tau), k)
        return pa.StructArray.from_arrays(
            [near.lists(weights), _steps(near.mean(weights), near.size > 0)], names=WEIGHTED.names)

    tau = temperature if isinstance(temperature, Column) else F.lit(float(temperature))
    return run(candidates, tau.cast("double"))


def analogue(weights, horizon: int, candidates="candidates") -> Column:
    """Weighted mean future; NULL without neighbours."""
    @F.arrow_udf(returnType=DOUBLES)
    def run(found: pa.Array, given: pa.Array) -> pa.Array:
        near = _Neighbours(found, horizon)
        return _steps(near.mean(near._wide(given.flatten(), 0.0)), near.size > 0)

    return run(candidates, weights)


def flat(last, horizon: int) -> Column:
    return F.array_repeat(F.coalesce(F.col(last) if isinstance(last, str) else last,
                                     F.lit(0.0)), horizon).cast("array<double>")


def nearest_distance(candidates="candidates") -> Column:
    return F.array_min(distances(candidates))


SUMMARY = T.StructType([
    T.StructField("weights", DOUBLES), T.StructField("mean", DOUBLES), T.StructField("distance", T.DoubleType()),
    T.StructField("nearest", T.DoubleType()), T.StructField("spread", DOUBLES)])


def _summary(near: _Neighbours, temperature: float):
    """Weights, mean future, weighted and least distance, spread of the futures; of each window."""
    weights = near.weights("softmax", np.full(len(near.size), float(temperature)), 1)
    mean = near.mean(weights)
    soft = near.fold(weights * np.where(near.there, near.distance, 0.0))
    return weights, mean, soft, near.low(), near.spread(weights, mean)


def summarise(retrieved: DataFrame, horizon: int, temperature: float = MEMORY_TEMPERATURE
              ) -> DataFrame:
    """Add ``weights, analog, distance, nearest, divergence``.

    ``divergence``: weighted standard deviation of the candidates per step, rounded like the
    distances, so that equal spreads stay equal in rankings.  Without a neighbour: flat
    continuation, NULL distance, zero divergence.  All of it comes from one pass over the candidates.
    """
    @F.arrow_udf(returnType=SUMMARY)
    def run(found: pa.Array) -> pa.Array:
        near = _Neighbours(found, horizon)
        some = near.size > 0
        weights, mean, soft, low, spread = _summary(near, temperature)
        return pa.StructArray.from_arrays(
            [near.lists(weights), _steps(mean, some), pa.array(soft, mask=~some), pa.array(low, mask=~some),
             _steps(spread, np.ones(len(some), bool))], names=SUMMARY.names)

    w = retrieved.withColumn("__s", run("candidates"))
    return w.select(
        *retrieved.columns, F.col("__s.weights").alias("weights"),
        F.coalesce("__s.mean", flat("last", horizon)).alias("analog"),
        F.col("__s.distance").alias("distance"), F.col("__s.nearest").alias("nearest"),
        F.transform("__s.spread", lambda v: F.round(v, kernels.DISTANCE_DIGITS)).alias("divergence"))


def explode_candidates(retrieved: DataFrame, keys) -> DataFrame:
    """One row per (window, rank)."""
    c = retrieved.select(*keys, F.explode("candidates").alias("c"))
    return c.select(*keys, "c.rank", "c.src_w", "c.distance", "c.future")


def knn(queries: DataFrame, bank: DataFrame, k: int, group=("entity", "channel"),
        radius: int | None = None, block: int = 4096) -> DataFrame:
    """Exact top-K of vector rows ``(group, qid, w, feat)`` against a packed bank.

    Queries are packed into bounded blocks by ``(group, hash)``, so a hot group
    spreads over many tasks; the packed bank (one row per group, at most M
    slots) is equi-joined by its measured size.
    """
    group = list(group)
    counts = queries.groupBy(*group).agg(F.ceil(F.count("*") / block).alias("__salts"))
    salted = attach(queries, counts, group).withColumn(
        "__salt", F.pmod(F.xxhash64("qid", "w"), F.col("__salts")))
    packed = salted.groupBy(*group, "__salt").agg(F.sort_array(F.collect_list(
        F.struct("qid", "w", "feat"))).alias("__q"))
    rows = packed.select(*group, F.col("__q.qid").alias("q_id"), F.col("__q.w").alias("q_w"),
                         F.flatten("__q.feat").alias("q_feat")).join(bank, group)
    schema = T.StructType([rows.schema[c] for c in group] + [
        T.StructField("qid", T.LongType()), T.StructField("w", T.LongType()),
        T.StructField("rank", T.IntegerType()), T.StructField("src_w", T.LongType()),
        T.StructField("distance", T.DoubleType())])
    arrow_schema = to_arrow_schema(schema)

    def vector(cell):
        return cell.values.to_numpy(zero_copy_only=False)

    def kernel(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = {c: batch.column(c)[r] for c in batch.schema.names}
                qid, qw, src = vector(row["q_id"]), vector(row["q_w"]), vector(row["bank_w"])
                q = vector(row["q_feat"]).reshape(len(qid), -1)
                m = vector(row["bank_feat"]).reshape(len(src), -1)
                q = (q - vector(row["center"])) / vector(row["scale"])
                dist, idx = kernels.nearest(q, m, k, qw, src, radius)
                kept = np.isfinite(dist)
                at = np.repeat(np.arange(len(qid)), kept.sum(axis=1))
                rank = np.cumsum(kept, axis=1)[kept].astype(np.int32)
                lead = [batch.column(c).take(pa.array(np.full(len(at), r))) for c in group]
                yield pa.RecordBatch.from_arrays(
                    lead + [pa.array(qid[at]), pa.array(qw[at]), pa.array(rank),
                            pa.array(src[idx[kept]]), pa.array(dist[kept])],
                    schema=arrow_schema)

    return rows.mapInArrow(kernel, schema)
