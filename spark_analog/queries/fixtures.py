"""Series, labels, vectors and ledgers derived from the given tables.

Entities are cohorts of neighbouring users (75) or suppliers (12), so their
number grows with the data while every series keeps its length.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spark_analog.functions.columns import rounded
from spark_analog.operators.clean import densify
from spark_analog.queries.registry import part, table

TRAIN = 480
L, H, M, K, BLOCK = 24, 4, 32, 3, 40


def observed_hourly(spark: SparkSession, sf: str) -> DataFrame:
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    return table(spark, sf, "events").select(
        F.concat(F.lit("e"), F.expr("user_id div 75")).alias("entity"),
        hour.cast("bigint").alias("t"), F.col("event_type").alias("channel"), "value")


def length(seen: DataFrame) -> int:
    """Steps from 0 to the last one observed."""
    return int(seen.agg(F.max("t")).first()[0] or 0) + 1


def hours(spark: SparkSession, sf: str) -> int:
    return length(observed_hourly(spark, sf))


def series_hourly(spark: SparkSession, sf: str) -> DataFrame:
    seen = observed_hourly(spark, sf)
    return densify(seen, 0, length(seen), rounded(F.avg("value")))


def labels_hourly(spark: SparkSession, sf: str) -> DataFrame:
    seen = observed_hourly(spark, sf).select("entity", "t", "value")
    empty = seen.select("entity").distinct().select(
        "entity", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                       F.lit(hours(spark, sf) - 1).cast("bigint"))).alias("t"),
        F.lit(None).cast("double").alias("value"))
    return seen.unionByName(empty).groupBy("entity", "t").agg(
        (F.coalesce(F.max("value"), F.lit(0.0)) > 250).cast("int").alias("label"))


def series_daily(spark: SparkSession, sf: str) -> DataFrame:
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', l_shipdate)")
    seen = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.expr("l_suppkey div 12")).alias("entity"),
        day.cast("bigint").alias("t"),
        F.concat("l_returnflag", "l_linestatus").alias("channel"),
        F.col("l_quantity").alias("value"))
    return densify(seen, 0, length(seen), rounded(F.avg("value")))


def labels_daily(spark: SparkSession, sf: str) -> DataFrame:
    """A day is anomalous when one of its items is unusually expensive."""
    day = F.expr("timestampdiff(DAY, TIMESTAMP_NTZ'1995-01-01 00:00:00', l_shipdate)")
    seen = table(spark, sf, "lineitem").select(
        F.concat(F.lit("s"), F.expr("l_suppkey div 12")).alias("entity"),
        day.cast("bigint").alias("t"), F.col("l_extendedprice").alias("price"))
    empty = seen.select("entity").distinct().select(
        "entity", F.explode(F.sequence(F.lit(0).cast("bigint"),
                                       F.lit(length(seen) - 1).cast("bigint"))).alias("t"),
        F.lit(None).cast("double").alias("price"))
    return seen.unionByName(empty).groupBy("entity", "t").agg(
        (F.coalesce(F.max("price"), F.lit(0.0)) > 98000).cast("int").alias("label"))


def score_points(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars")
    return docs.join(table(spark, sf, "labels").select("doc_id", "toxic"), "doc_id").select(
        F.col("doc_id").alias("t"), F.col("lang").alias("entity"),
        F.col("toxic").cast("int").alias("label"), F.col("n_chars").cast("double").alias("score"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(
        "vec_id", "label", F.col("embedding").cast("array<double>").alias("feat"))


def ledger(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation")
    r = table(spark, sf, "region")
    per = (o.join(c, F.col("o_custkey") == F.col("c_custkey"))
           .groupBy("c_nationkey", "o_orderpriority",
                    (1 + F.col("o_orderkey") % 2).cast("int").alias("seed"))
           .agg(rounded(F.avg("o_totalprice") / 1000000).alias("auprc"),
                F.count("*").alias("n")))
    return (per.join(n, F.col("c_nationkey") == F.col("n_nationkey"))
            .join(r, F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("r_name").alias("family"), F.col("n_name").alias("dataset"),
                    F.col("o_orderpriority").alias("method"), "seed",
                    F.lit("ok").alias("status"), "auprc", "n"))


part("observed", "", """
  select 'e' || (user_id // 75)::varchar as entity,
         date_diff('hour', timestamp '2024-01-01', ts)::bigint as t,
         event_type as channel, value from events""")
part("series", "observed", f"""
  select g.entity, g.t, g.channel, o.value from (
    select e.entity, r.t::bigint as t, e.channel
    from (select distinct entity, channel from observed) e, (select unnest(range(max(t) + 1)) from observed) r(t)) g
  left join (select entity, t, channel, round(avg(value) + 1.3e-9, 6) as value
             from observed group by 1, 2, 3) o using (entity, t, channel)""")
part("labels_h", "observed", f"""
  select g.entity, g.t, (coalesce(o.mx, 0) > 250)::int as label from (
    select e.entity, r.t::bigint as t
    from (select distinct entity from observed) e, (select unnest(range(max(t) + 1)) from observed) r(t)) g
  left join (select entity, t, max(value) as mx from observed group by 1, 2) o using (entity, t)""")
part("observed_d", "", f"""
  select 's' || (l_suppkey // 12)::varchar as entity,
         date_diff('day', timestamp '1995-01-01', l_shipdate)::bigint as t,
         l_returnflag || l_linestatus as channel, l_quantity as value from lineitem""")
part("daily", "observed_d", f"""
  select g.entity, g.t, g.channel, o.value from (
    select e.entity, r.t::bigint as t, e.channel
    from (select distinct entity, channel from observed_d) e, (select unnest(range(max(t) + 1)) from observed_d) r(t)) g
  left join (select entity, t, channel, round(avg(value) + 1.3e-9, 6) as value
             from observed_d group by 1, 2, 3) o using (entity, t, channel)""")
part("score_points", "", """
  select d.doc_id as t, d.lang as entity, l.toxic::int as label, d.n_chars::double as score
  from documents d join labels l using (doc_id)""")
part("ledger", "", """
  select r_name as family, n_name as dataset, o_orderpriority as method,
         (1 + o_orderkey % 2)::int as seed, 'ok' as status,
         round(avg(o_totalprice) / 1000000 + 1.3e-9, 6) as auprc, count(*)::bigint as n
  from orders join customer on o_custkey = c_custkey
       join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
  group by 1, 2, 3, 4""")
