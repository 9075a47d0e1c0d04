"""The flagship: detection end to end."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.functions.columns import rounded
from spark_analog.operators import scale
from spark_analog.operators.staging import stage
from spark_analog.plans.detect import Settings, detect as run_detect
from spark_analog.queries import fixtures as fx
from spark_analog.plans.guards import guards
from spark_analog.queries.registry import query, sql


def settings(**changes) -> Settings:
    return Settings(**{**dict(context=fx.L, horizon=fx.H, train_stop=fx.TRAIN, size=fx.M, k=fx.K,
                              label_block=fx.BLOCK), **changes})


@query("detect")
def detect(spark, sf):
    out = run_detect(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf), settings())
    return out.select("entity", "segment", "t", rounded("score").alias("score"), "label")


@query("detect_daily")
def detect_daily(spark, sf):
    """Longer series: seven years of days per supplier cohort."""
    s = settings(train_stop=1750, size=64, k=5, label_block=75)
    out = run_detect(fx.series_daily(spark, sf), fx.labels_daily(spark, sf), s)
    return out.select("entity", "segment", "t", rounded("score").alias("score"), "label")


@query("detect_learned_gate")
def detect_learned_gate(spark, sf):
    """The fusion gate of every entity learned on its adaptation windows."""
    out = run_detect(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf),
                     settings(learn_gate=True))
    return out.select("entity", "segment", "t", rounded("score").alias("score"), "label")


@query("detect_uneven")
def detect_uneven(spark, sf):
    """Training and test in separate tables, training lengths that differ by entity."""
    series, labels = fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf)
    stop = F.when(F.col("entity") == "e0", 440).otherwise(fx.TRAIN)
    late = F.col("t") >= stop
    joined, marks = scale.join_halves(
        series.where(~late), series.where(late).withColumn("t", F.col("t") - stop),
        labels.where(late).withColumn("t", F.col("t") - stop))
    out = run_detect(stage(joined), stage(marks), settings(train_stop=0))
    return out.select("entity", "segment", "t", rounded("score").alias("score"), "label")


@query("detect_native")
def detect_native(spark, sf):
    out = run_detect(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf), settings(),
                     "native")
    return out.select("entity", "segment", "t", rounded("score").alias("score"), "label")


GUARD_STOP, GUARD_BLOCK, GUARD_L, GUARD_H = 160, 75, 20, 4


@query("detect_guards", sql("", f"""
  with seen as (
    select 's' || l_suppkey::varchar as entity, l_returnflag || l_linestatus as channel,
           date_diff('day', timestamp '1995-01-01', l_shipdate)::bigint as t,
           l_extendedprice as price from lineitem),
  cells as (
    select entity, channel, max(t) as last, count(*) filter (t < {GUARD_STOP}) as early,
           count(*) filter (t >= {GUARD_STOP}) as late from seen group by 1, 2),
  whole as (
    select entity, max(last) + 1 as n, bool_or(early = 0) as empty,
           bool_or(early = 0 or late = 0) as uneven from cells group by 1),
  marks as (select entity, count(*) as marks, max(t) as last_mark from
            (select distinct entity, t from seen where price < 90000) group by 1),
  sized as (select *, n - {GUARD_STOP} as rest from whole left join marks using (entity)),
  blocks as (
    select *, case when rest % {GUARD_BLOCK} between 1 and {GUARD_L + GUARD_H} and rest > {GUARD_BLOCK}
                   then floor(rest / {GUARD_BLOCK}) else ceil(rest / {GUARD_BLOCK}) end as nblocks
    from sized)
  select entity, 'channel without training value' as reason from blocks where empty
  union all select entity, 'channel in one half only' from blocks where uneven
  union all select entity, 'training too short' from blocks where floor({GUARD_STOP} * 0.1) < {GUARD_L + GUARD_H}
  union all select entity, 'no test block' from blocks where rest < {GUARD_L + GUARD_H} or nblocks < 2
  union all select entity, 'labels do not match steps' from blocks
            where coalesce(marks < rest or last_mark + 1 <> n, true)"""))
def detect_guards(spark, sf):
    """Suppliers on their own are too sparse for detection; every reason is listed."""
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', l_shipdate)")
    seen = fx.table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), "l_suppkey").alias("entity"), day.cast("bigint").alias("t"),
        F.concat("l_returnflag", "l_linestatus").alias("channel"),
        F.col("l_quantity").cast("double").alias("value"), F.col("l_extendedprice").alias("price"))
    marks = seen.where("price < 90000").select("entity", "t").distinct()
    return guards(seen, marks, F.lit(GUARD_STOP), GUARD_L, GUARD_H, GUARD_BLOCK)
