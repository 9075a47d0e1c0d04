"""Places of rows in a total order per key, without a sort of one key in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.operators.staging import stage


def deal(rows: DataFrame, key: str, order: list[Column | str]) -> tuple[DataFrame, DataFrame]:
    """Rows in ranges of the global order, and where each key's rows start in each range.

    The first frame has the columns of ``rows`` and ``run`` (the range) and ``at`` (the place in
    all ranges); it is staged, so the places hold. The second has ``key``, ``run``, ``first``
    (smallest ``at`` of the key there), ``skip`` (rows of the key in earlier ranges) and ``n``
    (all rows of the key): one row per range and key. Nulls come first; rows that tie in ``order``
    get places in no fixed order.
    """
    rows = stage(rows)  # ranges are drawn from a first scan, which needn't read what made the rows
    ranges = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [F.col(key).asc_nulls_first(), *[c if isinstance(c, Column) else F.col(c).asc_nulls_first() for c in order]]
    at = F.monotonically_increasing_id()
    dealt = stage(rows.repartitionByRange(ranges, *by).sortWithinPartitions(*by)
                  .withColumn("at", at).withColumn("run", F.shiftright("at", 33)))
    counts = dealt.groupBy(key, "run").agg(F.count("*").alias("rows"), F.min("at").alias("first"))
    per = Window.partitionBy(key)
    before = per.orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(key, "run", "first", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("skip"),
                           F.sum("rows").over(per).alias("n"))
    return dealt, stage(starts)


def place(dealt: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """The rows with ``rank`` (from 0) instead of ``at`` and ``run``, and what ``starts`` tells of their key."""
    more = [c for c in starts.columns if c not in (key, "run", "first", "skip")]
    told = starts.select(F.col(key).alias("_key"), F.col("run").alias("_run"), "first", "skip", *more)
    met = dealt.join(told, dealt[key].eqNullSafe(told["_key"]) & (dealt["run"] == told["_run"]))
    kept = [c for c in dealt.columns if c not in ("at", "run")]
    return met.select(*[dealt[c] for c in kept], (F.col("at") - F.col("first") + F.col("skip")).alias("rank"), *more)
