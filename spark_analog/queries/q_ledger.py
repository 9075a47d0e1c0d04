"""Ledgers, rank statistics, files."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F

from spark_analog.functions.columns import rounded
from spark_analog.operators import clean, ledger
from spark_analog.operators.staging import stage, staging_folder
from spark_analog.queries import fixtures as fx
from spark_analog.queries.registry import memo, part, query, sql, table
from spark_analog.sources import files

# --- a raw ledger: one record per order, the key repeats ---------------------------------------------
LEDGER_SQL = """
  select o_custkey as configuration, o_orderpriority as condition, o_orderkey as seq,
         o_orderdate as happened, case when o_orderstatus = 'F' then 'error' else 'ok' end as status,
         o_totalprice as price from orders"""
part("raw", "", LEDGER_SQL)
KEY = ["configuration", "condition"]


def raw_ledger(spark, sf):
    return table(spark, sf, "orders").select(
        F.col("o_custkey").alias("configuration"), F.col("o_orderpriority").alias("condition"),
        F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("happened"),
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"),
        F.col("o_totalprice").alias("price"))


@query("ledger_latest", sql("raw", """
  select configuration, condition, seq, status, price from (
    select *, row_number() over (partition by configuration, condition
                                 order by happened desc, seq desc) as rn from raw) where rn = 1"""))
def ledger_latest(spark, sf):
    return ledger.latest(raw_ledger(spark, sf), KEY, ["happened", "seq"]).select(
        *KEY, "seq", "status", "price")


@query("ledger_duplicates", sql("raw", """
  select configuration, condition, count(*)::bigint as n from raw where status = 'ok'
  group by 1, 2 having count(*) > 1"""))
def ledger_duplicates(spark, sf):
    return ledger.duplicates(raw_ledger(spark, sf).where("status = 'ok'"), KEY)


NESTED = ("configuration bigint, condition string, seq bigint, status string, "
          "metrics struct<auprc:double,positives:bigint>, "
          "score struct<selected:struct<top_q:double>>, error struct<type:string>")


def nested(spark, sf, *more):
    raw = raw_ledger(spark, sf)
    ok = F.col("status") == "ok"
    return raw.select(
        *KEY, "seq", "status", *more,
        F.when(ok, F.struct((F.col("price") / 1e6).alias("auprc"),
                            (F.col("seq") % 100).alias("positives"))).alias("metrics"),
        F.when(ok, F.struct(F.struct((F.col("configuration") % 5 / 5.0).alias("top_q")).alias(
            "selected"))).alias("score"),
        F.when(~ok, F.struct(F.lit("failed").alias("type"))).alias("error"))


FLAT = {"configuration": "configuration", "condition": "condition", "seq": "seq",
        "status": "status", "auprc": "metrics.auprc", "positives": "metrics.positives",
        "top_q": "score.selected.top_q", "error_type": "error.type"}
FLAT_SQL = """
  select configuration, condition, seq, status,
         case when status = 'ok' then round(price / 1e6 + 1.3e-9, 6) + 0.0 end as auprc,
         case when status = 'ok' then seq % 100 end as positives,
         case when status = 'ok' then round(configuration % 5 / 5.0::double + 1.3e-9, 6) + 0.0 end as top_q,
         case when status <> 'ok' then 'failed' end as error_type from raw"""


def flat(rows):
    f = ledger.flatten(rows, FLAT)
    return f.withColumn("auprc", rounded("auprc")).withColumn("top_q", rounded("top_q"))


@query("ledger_flat", sql("raw", FLAT_SQL))
def ledger_flat(spark, sf):
    return flat(nested(spark, sf))


@query("ledger_read", sql("raw", FLAT_SQL + " where price <= 400000"))
def ledger_read(spark, sf):
    """Written as JSON lines, the dear ones torn in the middle, then read back."""
    text = F.to_json(F.struct(*nested(spark, sf).columns))
    torn = F.when(F.col("price") > 400000, F.substring(text, 1, 25)).otherwise(text)
    path = f"{staging_folder(spark)}/ledger-{uuid.uuid4().hex}"
    nested(spark, sf, "price").select(torn.alias("value")).write.text(path)
    return flat(files.read_ledger(spark, path, NESTED)[0])


@query("sink_roundtrip", sql("raw", """
  select configuration, condition, seq, case when price > 300000 then null else price end as price
  from raw"""))
def sink_roundtrip(spark, sf):
    rows = raw_ledger(spark, sf).select(*KEY, "seq", F.when(
        F.col("price") > 300000, F.lit(float("nan"))).otherwise(F.col("price")).alias("price"))
    base = f"{staging_folder(spark)}/sink-{uuid.uuid4().hex}"
    urgent = F.col("condition") == "1-URGENT"
    for where in (urgent, ~urgent):
        files.append_rows(rows.where(where), f"{base}/json", "json")
    files.append_rows(spark.read.schema(rows.schema).json(f"{base}/json"), f"{base}/csv", "csv")
    files.append_rows(spark.read.schema(rows.schema).option("header", True).csv(f"{base}/csv"),
                      f"{base}/parquet")
    return spark.read.parquet(f"{base}/parquet")


# --- means ------------------------------------------------------------------------------------------
part("ok_rows", "ledger", "select * replace (case when n % 31 <> 0 then 'ok' else 'error' end as status)"
     " from ledger")
part("fs", "ok_rows", """
  select family, method, seed, avg(auprc) as auprc, count(distinct dataset)::bigint as members
  from ok_rows where status = 'ok' group by 1, 2, 3""")
part("fsc", "fs ledger", """
  select fs.*, expected, members = expected as complete from fs join (
    select family, count(distinct dataset)::bigint as expected from ledger group by 1)
  using (family)""")


@memo
def rows(spark, sf):
    return stage(fx.ledger(spark, sf).withColumn(
        "status", F.when(F.col("n") % 31 != 0, "ok").otherwise("error")))


def per_family(spark, sf):
    return ledger.family_seed(rows(spark, sf))


def with_complete(spark, sf):
    expected = rows(spark, sf).groupBy("family").agg(F.countDistinct("dataset").alias("expected"))
    return ledger.family_complete(per_family(spark, sf), expected)


@query("family_seed", sql("fs", """
  select family, method, seed, round(auprc + 1.3e-9, 6) + 0.0 as auprc, members from fs"""))
def family_seed(spark, sf):
    return per_family(spark, sf).withColumn("auprc", rounded("auprc"))


@query("family_complete", sql("fsc", """
  select family, method, seed, members, expected, complete from fsc"""))
def family_complete(spark, sf):
    return with_complete(spark, sf).drop("auprc")


@query("macro_rows", sql("fsc", """
  select 'MACRO' as family, method, seed, round(avg(auprc) + 1.3e-9, 6) + 0.0 as auprc from fsc
  where complete group by method, seed
  having count(distinct family) = (select count(distinct family) from fsc)"""))
def macro_rows(spark, sf):
    per = with_complete(spark, sf)
    n = per.select("family").distinct().count()
    return ledger.macro_rows(per, n).withColumn("auprc", rounded("auprc"))


part("ms", "fs", """
  select family, method, avg(auprc) as mean, coalesce(stddev_samp(auprc), 0) as std,
         count(*)::bigint as n, string_agg(seed::varchar, ';' order by seed) as seeds
  from fs group by 1, 2""")


def means(spark, sf):
    return ledger.mean_std(per_family(spark, sf))


@query("mean_std", sql("ms", """
  select family, method, round(mean + 1.3e-9, 6) + 0.0 as mean, round(std + 1.3e-9, 6) + 0.0 as std, n, seeds
  from ms"""))
def mean_std(spark, sf):
    return means(spark, sf).withColumn("mean", rounded("mean")).withColumn("std", rounded("std"))


@query("component_effect", sql("ms", """
  select a.family, a.method as removed, least(a.n, f.n) as seed_count,
         round(f.mean + 1.3e-9, 6) + 0.0 as full_mean, round(a.mean + 1.3e-9, 6) + 0.0 as ablated_mean,
         round(f.mean - a.mean, 12) + 0.0 as gain,
         round(100 * (f.mean / nullif(a.mean, 0) - 1) + 1.3e-9, 6) + 0.0 as relative_percent
  from ms a join ms f on f.family = a.family and f.method = '1-URGENT'
  where a.method <> '1-URGENT'"""))
def component_effect(spark, sf):
    e = ledger.component_effect(means(spark, sf), "1-URGENT")
    return e.select("family", "removed", "seed_count", (F.round("gain", 12) + 0.0).alias("gain"), *[
        rounded(c).alias(c) for c in ("full_mean", "ablated_mean", "relative_percent")])


@query("design_balance", sql("ok_rows", """
  , ok as (select * from ok_rows where status = 'ok')
  select d.family, d.dataset, m.method, s.seed
  from (select distinct family, dataset from ok) d, (select distinct method from ok) m,
       (select distinct seed from ok) s
  where not exists (select 1 from ok where ok.family = d.family and ok.dataset = d.dataset
                    and ok.method = m.method and ok.seed = s.seed)"""))
def design_balance(spark, sf):
    return ledger.design_balance(rows(spark, sf))


# --- ranks --------------------------------------------------------------------------------------------
part("cells", "ledger", """
  select family, method, avg(a) as value from (
    select family, method, seed, avg(auprc) as a from ledger group by 1, 2, 3) group by 1, 2""")
part("rk", "cells", """
  select *, rank() over (partition by family order by round(value, 9) desc)
            + (count(*) over (partition by family, round(value, 9)) - 1) / 2.0::double as rank
  from cells""")
part("ar", "rk", "select method, avg(rank) as avg_rank, count(*)::bigint as n from rk group by 1")


def cells(spark, sf):
    ok = rows(spark, sf).withColumn("status", F.lit("ok"))
    return ledger.complete_table(ledger.family_seed(ok))


def ranks(spark, sf):
    return ledger.average_rank(ledger.block_ranks(cells(spark, sf)))


@query("method_pivot", sql("cells", """
  select family, round(max(value) filter (method = '1-URGENT') + 1.3e-9, 6) + 0.0 as urgent,
         round(max(value) filter (method = '2-HIGH') + 1.3e-9, 6) + 0.0 as high,
         round(max(value) filter (method = '3-MEDIUM') + 1.3e-9, 6) + 0.0 as medium,
         round(max(value) filter (method = '4-NOT SPECIFIED') + 1.3e-9, 6) + 0.0 as unspecified,
         round(max(value) filter (method = '5-LOW') + 1.3e-9, 6) + 0.0 as low
  from cells group by 1"""))
def method_pivot(spark, sf):
    names = {"1-URGENT": "urgent", "2-HIGH": "high", "3-MEDIUM": "medium",
             "4-NOT SPECIFIED": "unspecified", "5-LOW": "low"}
    p = ledger.pivot_methods(cells(spark, sf), names)
    return p.select("family", *[rounded(f"`{m}`").alias(n) for m, n in names.items()])


@query("average_rank", sql("ar", """
  select method, round(avg_rank + 1.3e-9, 6) + 0.0 as avg_rank, n from ar"""))
def average_rank(spark, sf):
    return ranks(spark, sf).withColumn("avg_rank", rounded("avg_rank"))


@query("friedman", sql("rk", """
  , s as (select count(distinct family)::double as n, count(distinct method)::double as k from rk),
  t as (select sum(c * c * c - c)::double as ties from (
          select count(*) as c from rk group by family, rank)),
  q as (select sum(r * r) as ss from (select sum(rank) as r from rk group by method)),
  x as (select n, k, (12 / (k * n * (k + 1)) * ss - 3 * n * (k + 1))
               / (1 - ties / (k * (k * k - 1) * n)) as stat from s, t, q)
  -- the tail of chi-square with four degrees of freedom, for the ledger's five methods
  select n::bigint as n, k::bigint as k, round(stat + 1.3e-9, 6) + 0.0 as statistic,
         round(exp(-stat / 2) * (1 + stat / 2) + 1.3e-9, 6) + 0.0 as p from x"""))
def friedman(spark, sf):
    f = ledger.friedman(ledger.block_ranks(cells(spark, sf)))
    return f.select("n", "k", rounded("statistic").alias("statistic"), rounded("p").alias("p"))


part("pairs", "cells", """
  select a.method as "left", b.method as "right", round(a.value - b.value, 9) as d
  from cells a join cells b using (family) where a.method < b.method""")
part("wr", "pairs", """
  select *, row_number() over (partition by "left", "right" order by abs(d), d)::int - 1 as i,
         count(*) over (partition by "left", "right")::bigint as n
  from (select *, rank() over (partition by "left", "right" order by abs(d))
               + (count(*) over (partition by "left", "right", abs(d)) - 1) / 2.0::double as r
        from pairs where d <> 0)""")
# p over all signs of the few families of the ledger
part("wx", "wr", """
  select "left", "right", n, w, least(1.0, 2.0 * count(*) filter (s <= w) / (1 << n::int))::double as p
  from (select z."left", z."right", z.n, z.w, m.mask,
               coalesce(sum(y.r) filter (((m.mask >> y.i) & 1) = 1), 0) as s
        from (select "left", "right", n, least(sum(case when d > 0 then r else 0 end),
                                               sum(case when d < 0 then r else 0 end)) as w
              from wr group by 1, 2, 3) z
        join (select unnest(range(1024))::int as mask) m on m.mask < (1 << z.n::int)
        join wr y on y."left" = z."left" and y."right" = z."right"
        group by 1, 2, 3, 4, 5)
  group by 1, 2, 3, 4""")


@query("wilcoxon", sql("wx", """
  select "left", "right", n, round(w + 1.3e-9, 6) + 0.0 as w, round(p + 1.3e-9, 6) + 0.0 as p
  from wx"""))
def wilcoxon(spark, sf):
    return ledger.wilcoxon(cells(spark, sf)).select(
        "left", "right", "n", rounded("w").alias("w"), rounded("p").alias("p"))


@query("holm", sql("wx", """
  , s as (select *, row_number() over (order by p, "left", "right") as i, count(*) over () as m from wx)
  select "left", "right", round(max(least(1.0::double, p * (m - i + 1))) over (order by i) + 1.3e-9, 6) + 0.0
         as p_holm from s"""))
def holm(spark, sf):
    return ledger.holm(ledger.wilcoxon(cells(spark, sf))).select("left", "right", rounded("p_holm").alias("p_holm"))


CD_SQL = """(select case count(*) when 2 then 1.960 when 3 then 2.343 when 4 then 2.569
    when 5 then 2.728 end::double * sqrt(count(*) * (count(*) + 1) / (6.0::double * max(n)))
  from ar)"""


@query("nemenyi", sql("ar", f"""
  select a.method as "left", b.method as "right",
         round(abs(a.avg_rank - b.avg_rank) + 1.3e-9, 6) + 0.0 as rank_difference,
         round({CD_SQL} + 1.3e-9, 6) + 0.0 as critical_difference,
         abs(a.avg_rank - b.avg_rank) > {CD_SQL} as exceeds
  from ar a join ar b on a.method < b.method"""))
def nemenyi(spark, sf):
    n = ledger.nemenyi(ranks(spark, sf))
    return n.withColumn("rank_difference", rounded("rank_difference")).withColumn(
        "critical_difference", rounded("critical_difference"))


@query("cd_groups", sql("ar", f"""
  , o as (select *, row_number() over (order by avg_rank, method)::int as pos from ar),
  r as (select a.pos as first, max(b.pos) as last from o a join o b on b.pos >= a.pos
          and b.avg_rank - a.avg_rank <= {CD_SQL} group by 1)
  select first, last from r where last > first and not exists (
    select 1 from r w where w.first < r.first and w.last >= r.last)"""))
def cd_groups(spark, sf):
    return ledger.cd_groups(ranks(spark, sf))


# --- plans, status, measurements ----------------------------------------------------------------------
@query("variant_plan", sql("ledger", """
  , lv as (select distinct 'k:' || method as analysis,
                  case when method in ('1-URGENT', '2-HIGH') then 5 else 3 end as k from ledger),
  e as (select distinct dataset, family from ledger),
  b(backbone) as (values ('base_a'), ('base_b'))
  select sha256('{"dataset":"' || dataset || '","backbone":"' || backbone || '","s":{"k":' || k
                || ',"m":256}}') as execution_id, family, dataset, backbone,
         string_agg(analysis, '|' order by analysis) as analyses, k::int as k, 256::int as m
  from e, b, lv group by family, dataset, backbone, k"""))
def variant_plan(spark, sf):
    levels = rows(spark, sf).select(
        F.concat_ws(":", F.lit("k"), "method").alias("analysis"),
        F.struct(F.when(F.col("method") == "1-URGENT", 5).when(
            F.col("method") == "2-HIGH", 5).otherwise(3).alias("k"), F.lit(256).alias("m")).alias(
            "settings")).distinct()
    entities = rows(spark, sf).select("dataset", "family").distinct()
    plan = ledger.variant_plan(levels, entities, ["base_a", "base_b"])
    return plan.select("execution_id", "family", "dataset", "backbone",
                       F.array_join("analyses", "|").alias("analyses"), "settings.k", "settings.m")


@query("pending_runs", sql("raw", """
  select distinct configuration, condition from raw r where not exists (
    select 1 from raw d where d.configuration = r.configuration and d.condition = r.condition
      and d.status = 'ok')"""))
def pending_runs(spark, sf):
    raw = raw_ledger(spark, sf)
    return ledger.pending(raw.select(*KEY).distinct(), raw, KEY)


@query("job_status", sql("raw", """
  , p as (select c_custkey as configuration, 10::int as expected from customer)
  select p.configuration, p.expected, coalesce(recorded, 0)::bigint as recorded,
         coalesce(ok, 0)::bigint as ok, coalesce(error, 0)::bigint as error,
         coalesce(recorded, 0) = expected and coalesce(error, 0) = 0 as complete
  from p left join (select configuration, count(*) as recorded,
                           count(*) filter (status = 'ok') as ok,
                           count(*) filter (status <> 'ok') as error from raw group by 1)
    using (configuration)"""))
def job_status(spark, sf):
    planned = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("configuration"), F.lit(10).alias("expected"))
    return ledger.job_status(planned, raw_ledger(spark, sf), ["configuration"])


part("meas", "", """
  select o_orderpriority || '-' || (o_custkey // 50)::varchar as benchmark_id,
         ([1, 3, 5, 10])[(o_orderkey % 4 + 1)::int]::int as k,
         ([64, 128, 256, 512])[(o_orderkey // 4 % 4 + 1)::int]::int as m,
         case o_orderkey // 4 % 4 when 0 then 202800 when 1 then 401200 when 2 then 798000
              else 1591600 end + case when o_orderkey % 97 = 0 then 8 else 0 end::int as payload
  from orders""")


@query("grid_integrity", sql("meas", """
  , have as (select benchmark_id, k, m, count(*) as n from meas group by 1, 2, 3),
  want as (select benchmark_id, k, m from (select distinct benchmark_id from meas),
             (select unnest([1, 3, 5, 10])::int as k), (select unnest([64, 128, 256, 512])::int as m)),
  pm as (select benchmark_id, m, count(distinct payload) as d, min(payload) as p from meas group by 1, 2)
  select benchmark_id, k, m, 'missing' as violation from want w where not exists (
    select 1 from have h where h.benchmark_id = w.benchmark_id and h.k = w.k and h.m = w.m)
  union all select benchmark_id, k, m, 'repeated' from have where n > 1
  union all select benchmark_id, null::int, m, 'payload_varies' from pm where d > 1
  union all select benchmark_id, null::int, m, 'payload_size' from pm where d = 1
    and p <> case m when 64 then 202800 when 128 then 401200 when 256 then 798000 else 1591600 end"""))
def grid_integrity(spark, sf):
    o = table(spark, sf, "orders")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]), i.cast("int") + 1)
    slot = F.expr("o_orderkey div 4") % 4
    m = o.select(
        F.concat_ws("-", "o_orderpriority", F.expr("o_custkey div 50")).alias("benchmark_id"),
        pick((1, 3, 5, 10), F.col("o_orderkey") % 4).alias("k"),
        pick((64, 128, 256, 512), slot).alias("m"),
        (pick((202800, 401200, 798000, 1591600), slot) + F.when(
            F.col("o_orderkey") % 97 == 0, 8).otherwise(0)).alias("payload"))
    return ledger.grid_integrity(m)


part("seconds", "", """
  select r_name as family, n_name as dataset, o_orderpriority as method,
         round(avg(o_totalprice) / 1000, 6) as base_seconds,
         round(count(*) * 0.5::double, 6) as adapt_seconds
  from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey
       join region on n_regionkey = r_regionkey group by 1, 2, 3""")


@query("time_rollup", sql("seconds", """
  , t as (select *, base_seconds + adapt_seconds as total from seconds),
  f as (select method, family, avg(total) as m from t group by 1, 2)
  select t.method, round(any_value(f.fm) + 1.3e-9, 4) + 0.0 as family_mean, any_value(f.fn)::bigint as families,
         round(quantile_cont(total, 0.5) + 1.3e-9, 4) + 0.0 as median, count(*)::bigint as entities
  from t join (select method, avg(m) as fm, count(*) as fn from f group by 1) f
    on f.method = t.method group by 1"""))
def time_rollup(spark, sf):
    o = table(spark, sf, "orders").join(table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    per = o.groupBy("c_nationkey", "o_orderpriority").agg(
        F.round(F.avg("o_totalprice") / 1000, 6).alias("base_seconds"),
        F.round(F.count("*") * 0.5, 6).cast("double").alias("adapt_seconds"))
    named = per.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("r_name").alias("family"), F.col("n_name").alias("dataset"),
        F.col("o_orderpriority").alias("method"), "base_seconds", "adapt_seconds")
    r = ledger.time_rollup(named)
    return r.withColumn("family_mean", rounded("family_mean", 4)).withColumn(
        "median", rounded("median", 4))


@query("latency_summary", sql("", """
  select l_returnflag as condition, round(quantile_cont(l_extendedprice, 0.5) + 1.3e-9, 6) + 0.0 as median_ms,
         round(quantile_cont(l_extendedprice, 0.95) + 1.3e-9, 6) + 0.0 as p95_ms,
         round(1000.0::double * 128 / quantile_cont(l_extendedprice, 0.5) + 1.3e-9, 6) + 0.0
           as windows_per_second
  from lineitem group by 1"""))
def latency_summary(spark, sf):
    samples = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("condition"), F.col("l_extendedprice").alias("ms"))
    s = ledger.latency_summary(samples, ["condition"], batch=128)
    return s.select("condition", *[rounded(c).alias(c) for c in (
        "median_ms", "p95_ms", "windows_per_second")])


# --- files: written from the series by Spark, read back by the sources --------------------------------
SERIES_SQL = sql("series", "select entity, t, channel, value from series where value is not null")
NAMES = ["click", "error", "purchase", "signup", "view"]


def out_path(spark, what):
    return f"{staging_folder(spark)}/{what}-{uuid.uuid4().hex}"


@query("src_csv_wide", SERIES_SQL)
def src_csv_wide(spark, sf):
    wide = clean.to_wide(fx.series_hourly(spark, sf), ["entity", "t"], NAMES)
    path = out_path(spark, "wide")
    wide.select("entity", F.col("t").alias("step"), F.lit("x").alias("Unnamed: 0"), *NAMES).write.option(
        "header", True).option("sep", ";").csv(path)
    raw = clean.drop_time_columns(files.read_wide_csv(spark, path))
    long = clean.to_long(raw.withColumnRenamed("step", "t"), ["entity", "t"])
    return long.where("value is not null").select(
        "entity", F.col("t").cast("bigint").alias("t"), "channel", "value")


@query("src_text_entities", SERIES_SQL)
def src_text_entities(spark, sf):
    wide = clean.to_wide(fx.series_hourly(spark, sf), ["entity", "t"], NAMES)
    path = out_path(spark, "text")
    (wide.repartition("entity").sortWithinPartitions("entity", "t")
     .select(F.col("entity").alias("machine"), *[F.coalesce(F.col(n).cast("string"), F.lit("nan"))
                                                 .alias(n) for n in NAMES])
     .write.partitionBy("machine").csv(path))
    long = files.read_headerless(spark, f"{path}/*/*.csv", len(NAMES), "machine=([^/]+)/")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]),
                        F.regexp_extract("channel", "([0-9]+)$", 1).cast("int") + 1)
    return long.where("value is not null").select("entity", "t", name.alias("channel"), "value")


@query("src_npy", SERIES_SQL)
def src_npy(spark, sf):
    """Arrays of ten days per file, as the bytes a file listing would deliver."""
    import io
    import numpy as np
    wide = clean.to_wide(fx.series_hourly(spark, sf), ["entity", "t"], NAMES)
    cut = wide.withColumn("part", F.expr("t div 240"))

    def dump(pdf):
        pdf = pdf.sort_values("t")
        buf = io.BytesIO()
        np.save(buf, pdf[NAMES].to_numpy(dtype=float))
        name = f"file:/npy/{pdf['entity'].iloc[0]}.{pdf['part'].iloc[0]}.npy"
        return pd.DataFrame({"path": [name], "content": [buf.getvalue()]})

    content = cut.groupBy("entity", "part").applyInPandas(dump, "path string, content binary")
    long = files.decode_npy(content, "/([^/]+)[.]npy$")
    name = F.element_at(F.array(*[F.lit(n) for n in NAMES]),
                        F.regexp_extract("channel", "([0-9]+)$", 1).cast("int") + 1)
    at = F.col("t") + 240 * F.split("entity", "[.]")[1].cast("bigint")
    return long.where("value is not null").select(
        F.split("entity", "[.]")[0].alias("entity"), at.alias("t"), name.alias("channel"), "value")


@query("src_discover", sql("series", """
  , roles as (select entity, 'train' as role from series
              union select entity, 'test' from series where t >= 480
              union select entity, 'test_label' from series where entity <> 'e1')
  select entity, count(distinct role)::bigint as roles, count(distinct role) = 3 as complete
  from roles group by 1"""))
def src_discover(spark, sf):
    path = out_path(spark, "tree")
    s = fx.series_hourly(spark, sf).withColumn("machine", F.col("entity"))
    late = F.col("t") >= fx.TRAIN
    for role, rows_ in (("train", s.where(~late)), ("test", s.where(late)),
                        ("test_label", s.where("entity <> 'e1'"))):
        rows_.select("machine", "value").write.partitionBy("machine").csv(f"{path}/{role}")
    return files.discover(spark, path, "/(train|test|test_label)/machine=([^/]+)/")
