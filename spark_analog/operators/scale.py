"""Robust scaling and chronological splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.defaults import BASE_VALIDATION_FRACTION, FOUR_WAY, SCALE_FLOOR
from spark_analog.operators.ordered import quantiles
from spark_analog.operators.staging import attach, stage


def robust_fit(train: DataFrame, keys=("entity", "channel"), value: str = "value",
               floor: float = SCALE_FLOOR, most: int | None = None) -> DataFrame:
    q = quantiles(train, keys, value, [0.25, 0.5, 0.75], ["q1", "center", "q3"], most=most)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*keys, "center",
                    F.when(iqr < floor, F.lit(1.0)).otherwise(iqr).alias("scale"))


def robust_transform(df: DataFrame, stats: DataFrame, keys=("entity", "channel"),
                     value: str = "value", inverse: bool = False) -> DataFrame:
    scaled = (F.col(value) * F.col("scale") + F.col("center") if inverse
              else (F.col(value) - F.col("center")) / F.col("scale"))
    return attach(df, stats, keys).select(
        *[scaled.alias(value) if c == value else F.col(c) for c in df.columns])


def lengths(df: DataFrame, key: str = "entity", time: str = "t") -> DataFrame:
    """Steps per entity; ``t`` is dense from 0, so the largest one tells."""
    return df.groupBy(key).agg((F.max(time) + 1).alias("n"))


def join_halves(train: DataFrame, test: DataFrame, labels: DataFrame, key: str = "entity"
                ) -> tuple[DataFrame, DataFrame]:
    """Separate training and test tables as one series with a ``train_stop`` per entity.

    Test time and its labels continue after the entity's own training length.
    """
    n = stage(lengths(train, key).withColumnRenamed("n", "train_stop"))

    def later(df):
        return df.join(n, key).withColumn("t", F.col("t") + F.col("train_stop"))

    return train.join(n, key).unionByName(later(test)), later(labels)


def split_three(n, t, base: float = 0.60, adapt: float = 0.20, val: float | None = None
                ) -> Column:
    """base / adapt / val by position; a sum below 1 leaves the tail NULL."""
    whole = val is None or base + adapt + val >= 1.0 - 1e-12
    a = F.floor(n * F.lit(float(base)))
    b = a + F.floor(n * F.lit(float(adapt)))
    c = n if whole else b + F.floor(n * F.lit(float(val)))
    return F.when(t < a, "base").when(t < b, "adapt").when(t < c, "val")


def four_way_bounds(n) -> list[tuple[str, Column, Column]]:
    """(name, start, stop) of base / memory / adapt / normal; the last takes the rest."""
    a = F.floor(n * F.lit(FOUR_WAY[0]))
    b = a + F.floor(n * F.lit(FOUR_WAY[1]))
    c = b + F.floor(n * F.lit(FOUR_WAY[2]))
    return [("base", F.lit(0).cast("bigint"), a), ("memory", a, b), ("adapt", b, c),
            ("normal", c, n)]


def split_four(n, t) -> Column:
    _, (_, m0, m1), (_, _, a1), _ = four_way_bounds(n)
    return F.when(t < m0, "base").when(t < m1, "memory").when(t < a1, "adapt").otherwise("normal")


def base_fit_stop(n) -> Column:
    """End of the inner fit part of base; the rest of base validates."""
    base = four_way_bounds(n)[0][2]
    return F.floor(base * F.lit(1.0 - BASE_VALIDATION_FRACTION))


def block_size(context: int, horizon: int, wanted: int) -> int:
    return max(wanted, context + horizon + 1)


def labelled_block(t, n, context: int, horizon: int, wanted: int) -> Column:
    """Block index by position; a tail too short for one window joins its predecessor."""
    size = block_size(context, horizon, wanted)
    tail = F.pmod(n, F.lit(size))
    short_tail = (tail > 0) & (tail < context + horizon + 1) & (n > size)
    last_full = F.floor(n / size) - 1
    block = F.floor(t / size)
    return F.when(short_tail, F.least(block, last_full)).otherwise(block)


def validation_period(fraction: float = 0.2) -> int:
    return max(2, int(round(1.0 / fraction)))


def roles(series: DataFrame, train_stop: int | Column, context: int, horizon: int,
          block: int, fraction: float = 0.2, memory_source: str = "base_memory",
          n_all: DataFrame | None = None) -> DataFrame:
    """Which step serves what: one row per (step, role).

    ``start`` and ``length`` of the contiguous segment are known in closed form,
    so later operators need no window to find a segment's border.  Training
    steps serve ``base`` (fit), ``base_val``, ``memory``, ``adapt``, ``normal``;
    later steps are interleaved blocks of ``score`` (labelled validation) and
    ``test``.
    """
    sized = attach(series, lengths(series) if n_all is None else n_all, ["entity"])
    n = F.lit(train_stop).cast("bigint") if isinstance(train_stop, int) else train_stop
    t = F.col("t")
    (_, _, b1), (_, m0, m1), (_, a0, a1), (_, v0, v1) = four_way_bounds(n)
    fit = base_fit_stop(n)
    mem0 = F.lit(0).cast("bigint") if memory_source == "base_memory" else m0
    rest = F.col("n") - n
    u = t - n
    idx = labelled_block(u, rest, context, horizon, block)
    size = block_size(context, horizon, block)
    nblocks = labelled_block(rest - 1, rest, context, horizon, block) + 1
    stop = F.when(idx == nblocks - 1, rest).otherwise((idx + 1) * size)
    zero = F.lit(0).cast("bigint")

    def part(name, segment, start, length):
        return F.struct(
            F.lit(name).alias("role") if isinstance(name, str) else name.alias("role"),
            segment.cast("bigint").alias("segment"), start.cast("bigint").alias("start"),
            length.cast("bigint").alias("length"))

    period = validation_period(fraction)
    late = F.when(idx % period == 0, F.lit("score")).otherwise(F.lit("test"))
    base, val = part("base", zero, zero, fit), part("base_val", zero, fit, b1 - fit)
    mem = part("memory", zero, mem0, m1 - mem0)
    early = [mem] if memory_source == "base_memory" else []
    choices = (F.when(t >= n, F.array(part(late, idx, n + idx * size, stop - idx * size)))
               .when(t < fit, F.array(base, *early)).when(t < b1, F.array(val, *early))
               .when(t < m1, F.array(mem)).when(t < a1, F.array(part("adapt", zero, a0, a1 - a0)))
               .otherwise(F.array(part("normal", zero, v0, v1 - v0))))
    return (sized.withColumn("__r", F.explode(choices))
            .select(*series.columns, "__r.role", "__r.segment", "__r.start", "__r.length"))


def segment_offsets(segments: DataFrame, keys=("entity",), segment: str = "segment",
                    length: str = "length") -> DataFrame:
    """Re-based coordinate when segments are laid end to end (one row per segment)."""
    before = Window.partitionBy(*keys).orderBy(segment).rowsBetween(
        Window.unboundedPreceding, -1)
    return segments.withColumn(
        "offset", F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint"))


def split_checks(per_entity: DataFrame, context: int, horizon: int) -> DataFrame:
    """Entities whose training part is too short for a window in every block.

    Input: ``entity, n`` training steps.
    """
    n = F.col("n")
    need = context + horizon
    parts = [(name, stop - start) for name, start, stop in four_way_bounds(n)]
    fit = base_fit_stop(n)
    parts += [("base_fit", fit), ("base_validation", parts[0][1] - fit)]
    sized = per_entity.select("entity", F.explode(F.array(*[
        F.struct(F.lit(name).alias("part"), size.cast("bigint").alias("size"))
        for name, size in parts])).alias("p")).select("entity", "p.part", "p.size")
    return sized.withColumn("long_enough", F.col("size") >= need)
