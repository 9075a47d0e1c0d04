"""What must hold before detection: offenders are named, never dropped."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_analog.operators import scale


def guards(series: DataFrame, labels: DataFrame, stop: Column, context: int, horizon: int,
           label_block: int, label_fraction: float = 0.2) -> DataFrame:
    """``entity, reason`` of every entity that detection can't serve.

    ``stop`` is the end of training, from columns of ``series``.  Reasons: a
    channel without a value in training, or in one half only; a training part
    too short for a window in each of its blocks; later steps too few for a
    validation and a test block; labels that don't match the steps.
    """
    cells = (series.withColumn("__stop", stop.cast("bigint")).groupBy("entity", "channel").agg(
        F.max("t").alias("last"), F.max("__stop").alias("stop"),
        F.count_if((F.col("t") < F.col("__stop")) & F.col("value").isNotNull()).alias("values"),
        F.count_if(F.col("t") < F.col("__stop")).alias("early"),
        F.count_if(F.col("t") >= F.col("__stop")).alias("late")))
    marks = labels.groupBy("entity").agg(F.count("*").alias("marks"), F.max("t").alias("last_mark"))
    whole = (cells.groupBy("entity").agg(
        (F.max("last") + 1).alias("n"), F.max("stop").alias("stop"),
        F.bool_or(F.col("values") == 0).alias("empty"),
        F.bool_or((F.col("early") == 0) | (F.col("late") == 0)).alias("uneven"))
        .join(marks, "entity", "left"))
    need = context + horizon
    parts = [b - a for _, a, b in scale.four_way_bounds(F.col("stop"))]
    fit = scale.base_fit_stop(F.col("stop"))
    short = reduce(lambda a, b: a | b, [p < need for p in [*parts, fit, parts[0] - fit]])
    rest = F.col("n") - F.col("stop")
    blocks = scale.labelled_block(rest - 1, rest, context, horizon, label_block) + 1
    # the first block validates, the next ones up to the period test
    no_test = (rest < need) | (blocks < 2)
    wrong = F.coalesce((F.col("marks") < rest) | (F.col("last_mark") + 1 != F.col("n")), F.lit(True))
    checks = [("channel without training value", F.col("empty")),
              ("channel in one half only", F.col("uneven")),
              ("training too short", short), ("no test block", no_test),
              ("labels do not match steps", wrong)]
    found = F.filter(F.array(*[F.when(test, F.lit(name)) for name, test in checks]), lambda r: r.isNotNull())
    return whole.select("entity", F.explode(found).alias("reason"))


def require(offenders: DataFrame) -> None:
    """Raise with the first offenders, by name, if there is any."""
    rows = offenders.orderBy("entity", "reason").limit(20).collect()
    if rows:
        raise ValueError("series that can't be served: " + "; ".join(
            f"{r.entity}: {r.reason}" for r in rows))
