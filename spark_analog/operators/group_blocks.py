"""From a raw series to its blocks inside one task, where a whole series is known to fit.

The same steps as ``clean.causal_fill``, ``scale.robust_fit`` and ``robust_transform``, ``scale.roles`` and
``windows.blocks``, on arrays: a step is shuffled once instead of once per operator.  Longer series
take the operators themselves.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.defaults import SCALE_FLOOR
from spark_analog.functions import kernels
from spark_analog.operators import scale
from spark_analog.operators.staging import attach
from spark_analog.operators.windows import BLOCK, KEYS


def bounds(stop: int) -> tuple[int, int, int, int]:
    """Ends of the base fit, base, memory and adapt parts of ``stop`` training steps (``scale.roles``)."""
    ends, at = [], 0
    for share in scale.FOUR_WAY[:3]:
        at += math.floor(stop * share)
        ends.append(at)
    return math.floor(ends[0] * (1.0 - scale.BASE_VALIDATION_FRACTION)), *ends


def segments(stop: int, n: int, context: int, horizon: int, block: int, fraction: float = 0.2,
             memory_source: str = "base_memory") -> list[tuple[str, int, int, int]]:
    """(role, segment, start, length) of ``scale.roles`` for a series of ``n`` steps."""
    fit, base, memory, adapt = bounds(stop)
    first = 0 if memory_source == "base_memory" else base
    out = [("base", 0, 0, fit), ("base_val", 0, fit, base - fit), ("memory", 0, first, memory - first),
           ("adapt", 0, memory, adapt - memory), ("normal", 0, adapt, stop - adapt)]
    size, rest = scale.block_size(context, horizon, block), n - stop
    if rest > 0:
        tail, last = rest % size, (rest - 1) // size
        if 0 < tail < context + horizon + 1 and rest > size:
            last = rest // size - 1
        period = scale.validation_period(fraction)
        for i in range(last + 1):
            end = rest if i == last else (i + 1) * size
            out.append(("score" if i % period == 0 else "test", i, stop + i * size, end - i * size))
    return out


def _filled(t: np.ndarray, value: np.ndarray, known: np.ndarray, stop: int) -> tuple[np.ndarray, np.ndarray]:
    """Last known value of the same half, else the training median; and where there is one."""
    train = t < stop
    half = np.searchsorted(t, stop)
    at = np.where(known, np.arange(len(t)), -1)
    at = np.concatenate([np.maximum.accumulate(at[:half]), np.maximum.accumulate(at[half:])])
    seen, out = at >= 0, value[np.maximum(at, 0)]
    if (known & train).any():
        median = kernels.percentiles(value[known & train], (0.5,))[0]
        return np.where(seen, out, median), np.ones(len(t), bool)
    return out, seen


def _runs(batches):
    """The steps of each entity and channel in a batch as one row, ``t`` and ``value`` as lists."""
    for batch in batches:
        code = np.zeros(batch.num_rows, np.int64)
        for c in ("entity", "channel"):
            found = batch.column(c).dictionary_encode()
            code = code * len(found.dictionary) + found.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        first = np.flatnonzero(np.diff(code[order], prepend=-1))
        offsets = pa.array(np.append(first, len(order)).astype(np.int32))
        lead = pa.array(order[first])
        yield pa.RecordBatch.from_arrays(
            [batch.column(c).take(lead) for c in ("entity", "channel")] + [
                pa.ListArray.from_arrays(offsets, batch.column(c).take(pa.array(order))) for c in ("t", "value")],
            names=["entity", "channel", "t", "value"])


def prepared_blocks(series: DataFrame, lengths: DataFrame, stop: int, context: int, horizon: int, label_block: int,
                    fraction: float = 0.2, memory_source: str = "base_memory", block: int = BLOCK) -> DataFrame:
    """Filled, scaled steps with roles as blocks: ``windows.blocks`` of the whole chain; ``lengths``: steps per entity.

    All steps of an entity and channel meet in one task; they travel as lists."""
    steps = series.select("entity", "channel", F.col("t").cast("bigint").alias("t"),
                          F.col("value").cast("double").alias("value")).dropna(subset=["entity", "channel", "t"])
    listed = T.StructType([steps.schema["entity"], steps.schema["channel"], T.StructField("t", T.ArrayType(T.LongType())),
                           T.StructField("value", T.ArrayType(T.DoubleType()))])
    rows = attach(steps.mapInArrow(_runs, listed), lengths, ["entity"])
    kinds = dict(entity=rows.schema["entity"].dataType, channel=rows.schema["channel"].dataType, role=T.StringType(),
                 segment=T.LongType(), start=T.LongType(), length=T.LongType(), block=T.LongType(),
                 block_size=T.IntegerType(), values=T.ArrayType(T.DoubleType()))
    schema = T.StructType([T.StructField(c, kinds[c]) for c in (*KEYS, "start", "length", "block", "block_size", "values")])
    reach = context + horizon - 1

    def cut(t, value, there, n):
        """One row per segment and block."""
        for role, segment, start, length in segments(stop, n, context, horizon, label_block, fraction, memory_source):
            a, b = np.searchsorted(t, (start, start + length))
            for k in range((t[b - 1] - start) // block + 1 if b > a else 0):
                i, j = a + np.searchsorted(t[a:b], (start + k * block, start + (k + 1) * block + reach))
                if i == j:
                    continue
                if t[j - 1] - t[i] + 1 != j - i:
                    raise ValueError("time steps of a segment must be dense")
                yield role, segment, start, length, k, pa.array(value[i:j], mask=~there[i:j])

    def run(key, table):
        t, value = (table.column(c).combine_chunks().flatten() for c in ("t", "value"))
        t, known, value = (x.to_numpy(zero_copy_only=False) for x in (t, value.is_valid(), value))
        order = np.lexsort((value, t))
        t, value, known = t[order], value[order], known[order]
        value, there = _filled(t, value, known, stop)
        train = there & (t < stop)
        found = []
        if train.any():
            q1, center, q3 = kernels.percentiles(value[train], (0.25, 0.5, 0.75))
            value = (value - center) / (1.0 if q3 - q1 < SCALE_FLOOR else q3 - q1)
            found = list(cut(t, value, there, table.column("n")[0].as_py()))
        cols = dict(zip(("role", "segment", "start", "length", "block"), zip(*(f[:5] for f in found)))) if found else {}
        values = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], np.cumsum([len(f[5]) for f in found])]).astype(np.int32)),
            pa.concat_arrays([f[5] for f in found]) if found else pa.array([], pa.float64()))
        named = dict(zip(("entity", "channel"), key))
        size = len(found)
        made = {"values": values, "block_size": pa.array([block] * size, pa.int32())}
        for c in schema.names:
            if c in named:
                made[c] = pa.array([named[c].as_py()] * size, named[c].type)
            elif c not in made:
                made[c] = pa.array(list(cols.get(c, ())), pa.string() if c == "role" else pa.int64())
        return pa.Table.from_arrays([made[c] for c in schema.names], names=schema.names)

    return rows.groupBy("entity", "channel").applyInArrow(run, schema)
