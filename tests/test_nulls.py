from pyspark.sql import functions as F

from spark_analog.functions.columns import at_least, clip, finite
from spark_analog.operators import score


def test_missing_stays_missing(spark):
    df = spark.createDataFrame([(None,), (float("nan"),), (-3.0,), (5.0,)], "v double")
    got = df.select(finite("v").alias("v")).select(
        clip("v", 0.0, 1.0).alias("c"), at_least("v", 0.0).alias("a")).collect()
    assert [tuple(r) for r in got] == [(None, None), (None, None), (0.0, 0.0), (1.0, 5.0)]


def test_a_missing_target_does_not_count_as_zero_error(spark):
    df = spark.createDataFrame(
        [("e", "r", 0, "c", 10, [1.0, 1.0], [3.0, None])],
        "entity string, role string, segment bigint, channel string, w bigint, "
        "yhat array<double>, y array<double>")
    steps = score.residual_steps(df).withColumn("center", F.lit(0.0)).withColumn(
        "scale", F.lit(1.0)).withColumn("z", score.z_score())
    got = {r["t"]: (r["z"] and round(r["z"], 9), r["n"]) for r in score.overlap_add(steps, ["z"]).collect()}
    assert got == {10: (2.0, 1), 11: (None, 0)}
