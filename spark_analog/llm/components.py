"""Connected components of a table of links, by large-star and small-star rounds.

Every round hangs the larger neighbours of each node on the smallest one it
knows. The links are written to the shared folder after each round, so lineage
stays short; only two numbers per round reach the driver. A node with a large
part of all links is no group in one task: minima are aggregated before the
shuffle, and Spark splits the skewed side of the join that hands them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.operators.staging import stage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, component): every id that has a link to another, and the smallest id it reaches.

    Links without direction; rows with a null or with two equal ids say nothing;
    repeated links count once; an empty table gives no rows."""
    first = links.select(F.col(a).alias("a"), F.col(b).alias("b")).filter("a <> b")
    now = stage(_down(first))
    before = None
    while (state := _state(now)) != before:
        before = state
        now = stage(_small_star(_large_star(now)))
    return now.select(F.col("a").alias("id"), F.col("b").alias("component"))


def _down(links: DataFrame) -> DataFrame:
    return links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _state(links: DataFrame) -> tuple:
    row = links.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
    return tuple(row)


def _large_star(links: DataFrame) -> DataFrame:
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.join(low, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b").distinct()


def _small_star(links: DataFrame) -> DataFrame:
    """``links`` all point down (a > b)."""
    low = links.groupBy("a").agg(F.min("b").alias("m"))
    moved = links.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    return moved.unionByName(low.select("a", F.col("m").alias("b"))).distinct()
