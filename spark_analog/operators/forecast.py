"""Base forecasts: flat continuation, a user callable, a shared linear map."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_analog.functions import kernels
from spark_analog.operators.retrieve import flat
from spark_analog.operators.staging import stage
from spark_analog.operators.windows import CHUNK, legal_starts


def naive(horizon: int, last="last") -> Column:
    return flat(last, horizon)


def linear_forecaster(blocked: DataFrame, context: int, horizon: int, ridge: float = 1.0,
                      cap: int | None = None, seed: int = 0) -> DataFrame:
    """Direct multi-step ridge regression per entity, shared by its channels.

    Context and future are normalised by the context's mean and spread.  Tasks
    add up Gram matrices over many blocks before anything is shuffled; sums per
    cell are combined by Spark and each entity's (L + 1)-square system is solved
    in its own task.  Output: ``entity, weights`` (row-major ``[L + 1, H]``).
    """
    p, wide = context + 1, context + 1 + horizon
    rows = blocked.withColumn("__starts", legal_starts(context, horizon, 1, cap, seed)).where(
        F.size("__starts") > 0).select("entity", "block", "block_size", "values", "__starts")

    def gram(batches):
        sums: dict = {}

        def drain():
            if sums:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(sums), pa.string()), pa.array([g.tobytes() for g in sums.values()], pa.binary())],
                    names=["entity", "gram"])
            sums.clear()

        for batch in batches:
            for r in range(batch.num_rows):
                entity = batch.column("entity")[r].as_py()
                values = batch.column("values")[r].values.to_numpy(
                    zero_copy_only=False).astype(float)
                origin = (batch.column("block")[r].as_py() * batch.column("block_size")[r].as_py())
                starts = batch.column("__starts")[r].values.to_numpy(zero_copy_only=False)
                for a in range(0, len(starts), CHUNK):
                    x, y = kernels.window_views(values, context, horizon,
                                                starts[a:a + CHUNK] - origin)
                    ok = np.isfinite(x).all(axis=1) & np.isfinite(y).all(axis=1)
                    x, y = x[ok], y[ok]
                    mean = x.mean(axis=1, keepdims=True)
                    spread = np.sqrt(x.var(axis=1, keepdims=True) + 1e-5)
                    z = np.column_stack([(x - mean) / spread, np.ones(len(x)),
                                         (y - mean) / spread])
                    part = z[:, :p].T @ z
                    sums[entity] = sums[entity] + part if entity in sums else part
                if len(sums) >= 64:
                    yield from drain()
        yield from drain()

    def solve(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = np.zeros(p * wide)
        for batch in batches:
            for cell in batch.column("gram"):
                g += np.frombuffer(cell.as_buffer())
        g = g.reshape(p, wide)
        penalty = ridge * np.eye(p)
        penalty[-1, -1] = 1e-9
        w = np.linalg.solve(g[:, :p] + penalty, g[:, p:])
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.string()), pa.array([w.reshape(-1)], pa.list_(pa.float64()))],
            names=["entity", "weights"])

    return stage(rows.mapInArrow(gram, "entity string, gram binary").groupBy("entity").applyInArrow(
        solve, "entity string, weights array<double>"))
