"""Points and intervals: how many are open at a point, and which points each holds.

Borders and points are swept together in time blocks; what is open at the edge of a block is carried
over from the borders before it. No interval is spelled out step by step, so its length doesn't matter.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.operators.ordered import running_sums

SPAN = 65_536
MEMBER_SPAN = 4_096


def open_intervals(points: DataFrame, intervals: DataFrame, keys, time: str = "t", start: str = "start",
                   stop: str = "stop", out: str = "open", span: int = SPAN) -> DataFrame:
    """Add ``out``: the number of intervals, both ends included, that hold the point.

    An interval is two rows, whatever its length. One without an end, or that ends before it starts,
    holds nothing. ``points`` is read twice, so stage it where it is dear.
    """
    keys = list(keys)
    used = intervals.where(F.col(start) <= F.col(stop))
    step = F.explode(F.array(
        F.struct(F.col(start).cast("bigint").alias("at"), F.lit(1).cast("bigint").alias("step")),
        F.struct((F.col(stop) + 1).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("step"))))
    borders = used.select(*keys, step.alias("__b")).select(
        *keys, F.col("__b.at").alias(time), F.col("__b.step").alias("__step"), F.lit(True).alias("__border"))
    own = points.withColumn("__step", F.lit(0).cast("bigint")).withColumn("__border", F.lit(False))
    stream = own.unionByName(borders, allowMissingColumns=True).withColumn(
        "__piece", F.floor(F.col(time) / span))
    swept = running_sums(stream, keys, ["__piece"], [time], {out: "__step"})
    return swept.where(~F.col("__border")).select(*points.columns, out)


def members(intervals: DataFrame, points: DataFrame, keys, time: str = "t", start: str = "start",
            stop: str = "stop", span: int = MEMBER_SPAN) -> DataFrame:
    """One row per interval ``[start, stop)`` and point in it: all columns of both.

    Both meet in time blocks, where sorted points are looked up by the two ends; an interval travels
    once per block that it touches, a point once.
    """
    keys = list(keys)
    first, last = F.floor(F.col(start) / span), F.floor((F.col(stop) - 1) / span)
    cut = intervals.where(F.col(start) < F.col(stop)).withColumn(
        "__piece", F.explode(F.sequence(first, last)))
    cut = cut.select(*[F.col(c).alias(c) for c in cut.columns])
    dealt = points.select(*[F.col(c).alias(c) for c in points.columns],  # own columns, if both come from one frame
                          F.floor(F.col(time) / span).alias("__piece"))
    rest = [c for c in points.columns if c not in keys]

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        t = right.column(time).to_numpy()
        order = np.argsort(t, kind="stable")
        low = np.searchsorted(t[order], left.column(start).to_numpy())
        size = np.maximum(np.searchsorted(t[order], left.column(stop).to_numpy()) - low, 0)
        at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        a = left.take(pa.array(np.repeat(np.arange(len(low)), size)))
        b = right.take(pa.array(order[at]))
        return pa.table([a.column(c) for c in intervals_columns] + [b.column(c) for c in rest],
                        names=intervals_columns + rest)

    intervals_columns = intervals.columns
    fields = [intervals.schema[c] for c in intervals_columns] + [points.schema[c] for c in rest]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields)
    return cut.groupBy(*keys, "__piece").cogroup(dealt.groupBy(*keys, "__piece")).applyInArrow(meet, schema)
