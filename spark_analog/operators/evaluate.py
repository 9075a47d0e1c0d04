"""Point-wise metrics for any number of groups at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.operators.ordered import PIECE_ROWS, running_by_value
from spark_analog.operators.staging import stage


def curves(scored: DataFrame, keys, label: str = "label", score: str = "score",
           most: int | None = None) -> DataFrame:
    """Ranked points: ``pos, cnt`` at a score, ``tp, seen`` from the top down to it.

    ``most`` is a known bound on the points of a group.  Where it fits a task the
    points are ranked directly (one shuffle); otherwise they are first reduced to
    one row per distinct score and groups are measured and cut if needed.
    """
    kept = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).select(
        *keys, F.col(score).alias("s"), (F.col(label) > 0).cast("bigint").alias("pos"))
    if most is not None and most <= PIECE_ROWS:
        order = Window.partitionBy(*keys).orderBy(F.desc("s"))
        upto = order.rangeBetween(Window.unboundedPreceding, Window.currentRow)
        return kept.select(*keys, "pos", F.lit(1).alias("cnt"), F.sum("pos").over(upto).alias("tp"),
                           F.count("*").over(upto).alias("seen"),
                           F.rank().over(order).alias("first"))
    hist = kept.groupBy(*keys, "s").agg(F.sum("pos").alias("pos"), F.count("*").alias("cnt"))
    run = running_by_value(stage(hist), keys, "s", {"tp": "pos", "seen": "cnt"}, descending=True)
    return run.withColumn("first", F.col("seen") - F.col("cnt") + 1)


def average_precision(scored: DataFrame, keys, label: str = "label", score: str = "score",
                      most: int | None = None) -> DataFrame:
    """``auprc`` and ``auroc`` per group; NULL with a single class."""
    c = curves(scored, keys, label, score, most)
    p, n = F.sum("pos"), F.sum("cnt")
    both = (p > 0) & (p < n)
    ap = F.sum(F.col("pos") * F.col("tp") / F.col("seen")) / p
    ranks = F.sum(F.col("pos") * (F.col("first") + F.col("seen"))) / 2.0
    roc = (p * (n + 1) - ranks - p * (p + 1) / 2.0) / (p * (n - p))
    return c.groupBy(*keys).agg(
        F.when(both, ap).alias("auprc"), F.when(both, roc).alias("auroc"),
        n.alias("n_evaluated"), p.alias("positives"))


def summary(scored: DataFrame, keys, label: str = "label", score: str = "score",
            most: int | None = None) -> DataFrame:
    """Counts and metrics; points without a score are dropped and counted."""
    keep = F.col(score).isNotNull() & F.col(label).isNotNull()
    totals = scored.groupBy(*keys).agg(
        F.count("*").alias("n_total"), F.count_if(keep).alias("n_evaluated"),
        F.count_if(~keep).alias("n_dropped"),
        F.count_if(keep & (F.col(label) > 0)).alias("positives"))
    metrics = average_precision(scored, keys, label, score, most).select(*keys, "auprc", "auroc")
    t = totals.join(metrics, list(keys), "left")
    return t.select(
        *keys, "n_total", "n_evaluated", "n_dropped", "positives",
        (F.col("n_evaluated") - F.col("positives")).alias("negatives"),
        (F.col("positives") / F.nullif("n_evaluated", F.lit(0))).alias("positive_rate"),
        ((F.col("positives") == 0) | (F.col("positives") == F.col("n_evaluated"))).alias(
            "single_class"), "auprc", "auroc")
