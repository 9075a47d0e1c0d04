"""Sources on table data, cleaning, scaling, splits."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.functions.columns import rounded
from spark_analog.operators import clean, scale
from spark_analog.operators.staging import attach
from spark_analog.queries import fixtures as fx
from spark_analog.queries.registry import part, query, sql, table

SPLIT_SQL = f"case when t < {fx.TRAIN} then 'train' else 'test' end"


def by_half():
    return F.when(F.col("t") < fx.TRAIN, "train").otherwise("test")


def medians(series):
    return clean.channel_medians(series.where(f"t < {fx.TRAIN}"), most=fx.TRAIN)


def filled(spark, sf):
    series = fx.series_hourly(spark, sf)
    return clean.causal_fill(series.withColumn("split", by_half()), medians(series),
                             restart=["split"]).drop("split")


def scaler(series_filled):
    return scale.robust_fit(series_filled.where(f"t < {fx.TRAIN}"), most=fx.TRAIN)


def scaled(spark, sf):
    f = filled(spark, sf)
    return scale.robust_transform(f, scaler(f))


part("medians", "series", f"""
  select entity, channel, quantile_cont(value, 0.5) as median from series
  where t < {fx.TRAIN} group by 1, 2""")
part("filled", "series medians", f"""
  select s.entity, s.t, s.channel,
         coalesce(last_value(s.value ignore nulls) over (
           partition by s.entity, s.channel, {SPLIT_SQL} order by t
           rows between unbounded preceding and current row), m.median) as value
  from series s join medians m using (entity, channel)""")
part("scaler", "filled", f"""
  select entity, channel, center,
         case when q3 - q1 < 1e-6 then 1.0 else q3 - q1 end::double as scale from (
    select entity, channel, quantile_cont(value, 0.5) as center,
           quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3
    from filled where t < {fx.TRAIN} group by 1, 2)""")
part("scaled", "filled scaler", """
  select entity, t, channel, (value - center) / scale as value
  from filled join scaler using (entity, channel)""")


@query("name_normalise", sql("", """
  select p_name as raw, regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '', 'g') as normal,
         count(*)::bigint as n from part group by 1, 2
  union all
  select p_brand, regexp_replace(lower(trim(p_brand)), '[^a-z0-9]+', '', 'g'),
         count(*)::bigint from part group by 1, 2"""))
def name_normalise(spark, sf):
    p = table(spark, sf, "part")
    raw = p.select(F.explode(F.array("p_name", "p_brand")).alias("raw"))
    return raw.groupBy("raw").agg(F.count("*").alias("n")).select(
        "raw", clean.normal_name_column("raw").alias("normal"), "n")


NUMBER_TEXT_SQL = """case when event_id % 11 = 0 then 'n/a' when event_id % 13 = 0 then 'inf'
                     else ' 1,' || lpad(user_id::varchar, 4, '0') end"""


@query("numeric_coerce", sql("", f"""
  select user_id, count(*)::bigint as n, count(v)::bigint as numeric_n,
         sum(v)::double as total from (
    select user_id, case when isfinite(x) then x end as v from (
      select user_id, try_cast(replace(trim({NUMBER_TEXT_SQL}), ',', '') as double) as x
      from events)) group by 1"""))
def numeric_coerce(spark, sf):
    raw = F.when(F.col("event_id") % 11 == 0, F.lit("n/a")).when(
        F.col("event_id") % 13 == 0, F.lit("inf")).otherwise(
        F.concat(F.lit(" 1,"), F.lpad(F.col("user_id").cast("string"), 4, "0")))
    text = table(spark, sf, "events").select("user_id", raw.alias("text"))
    v = text.select("user_id", clean.number("text").alias("v"))
    return v.groupBy("user_id").agg(F.count("*").alias("n"), F.count("v").alias("numeric_n"),
                                    F.sum("v").alias("total"))


@query("label_normalise", sql("", """
  select doc_id, toxic as from_number,
         case when quality = 1 then 0 else 1 end as from_minus_one,
         case when toxic = 1 then 1 else 0 end as from_text from labels"""))
def label_normalise(spark, sf):
    l = table(spark, sf, "labels").select(
        "doc_id", F.col("toxic").alias("number"),
        F.when(F.col("quality") == 1, 1).otherwise(-1).alias("minus_one"),
        F.when(F.col("toxic") == 1, "A ttack").otherwise(" Normal").alias("text"))
    for c in ("number", "minus_one", "text"):
        l = clean.normalise_labels(l, c, f"from_{c}")
    return l.select("doc_id", "from_number", "from_minus_one", "from_text")


@query("label_or", sql("", """
  select user_id, date_diff('hour', timestamp '2024-01-01', ts)::bigint as t,
         max(case when value > 250 or event_type = 'error' then 1 else 0 end)::int as label
  from events group by 1, 2"""))
def label_or(spark, sf):
    hour = F.expr("timestampdiff(HOUR, TIMESTAMP_NTZ'2024-01-01 00:00:00', ts)")
    e = table(spark, sf, "events").select(
        "user_id", hour.cast("bigint").alias("t"), (F.col("value") > 250).cast("int").alias("a"),
        (F.col("event_type") == "error").cast("int").alias("b"))
    return e.groupBy("user_id", "t").agg(F.max(clean.any_label(["a", "b"])).alias("label"))


@query("label_intervals", sql("series", """
  , cells as (select distinct entity, t from series),
  manifest as (
    select entity, min(t) as s, max(t) as e from (
      select entity, t, t // 96 as g from series where value > 150) group by entity, g)
  select c.entity, c.t, max(case when m.s is null then 0 else 1 end)::int as label
  from cells c left join manifest m on c.entity = m.entity and c.t between m.s and m.e
  group by 1, 2"""))
def label_intervals(spark, sf):
    from spark_analog.sources.files import interval_labels
    series = fx.series_hourly(spark, sf)
    runs = series.where("value > 150").groupBy("entity", F.expr("t div 96").alias("g")).agg(
        F.min("t").alias("s"), F.max("t").alias("e"))
    manifest = runs.groupBy("entity").agg(F.to_json(
        F.collect_list(F.array("s", "e"))).alias("anomaly_sequences"))
    return interval_labels(series.select("entity", "t").distinct(), manifest)


@query("series_profile", sql("series labels_h", f"""
  , s as (select entity, {SPLIT_SQL} as split, count(distinct t)::bigint as points,
                 count(distinct channel)::bigint as channels,
                 count(*) filter (value is null)::bigint as missing
          from series group by 1, 2),
  l as (select entity, {SPLIT_SQL} as split, sum(label)::bigint as anomaly_points,
               round(avg(label) + 1.3e-9, 6) + 0.0 as anomaly_rate from labels_h group by 1, 2)
  select * from s left join l using (entity, split)"""))
def series_profile(spark, sf):
    p = clean.profile(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf), by_half())
    return p.withColumn("anomaly_rate", rounded("anomaly_rate"))


@query("train_median", sql("medians", "select entity, channel, round(median + 1.3e-9, 6) + 0.0 as median"
                                      " from medians"))
def train_median(spark, sf):
    return medians(fx.series_hourly(spark, sf)).withColumn("median", rounded("median"))


@query("causal_fill", sql("filled", "select entity, t, channel, round(value + 1.3e-9, 6) + 0.0 as value"
                                    " from filled"))
def causal_fill(spark, sf):
    return filled(spark, sf).withColumn("value", rounded("value"))


@query("canonical_series", sql("series", """
  select entity, t, max(value) filter (channel = 'click') as click,
         max(value) filter (channel = 'error') as error,
         max(value) filter (channel = 'purchase') as purchase,
         max(value) filter (channel = 'signup') as signup,
         max(value) filter (channel = 'view') as view
  from series group by 1, 2"""))
def canonical_series(spark, sf):
    names = ["click", "error", "purchase", "signup", "view"]
    wide = clean.to_wide(fx.series_hourly(spark, sf), ["entity", "t"], names)
    again = clean.to_long(wide, ["entity", "t"])
    return clean.to_wide(again, ["entity", "t"], names)


@query("crop", sql("series", """
  , b as (select entity, min(t) as a, max(t) as b from series group by 1)
  select 'head' as mode, s.* from series s join b using (entity) where t < a + 100
  union all
  select 'tail', s.* from series s join b using (entity) where t > b.b - 100"""))
def crop(spark, sf):
    s = fx.series_hourly(spark, sf)
    cut = [clean.crop(s, 100, m).withColumn("mode", F.lit(m)) for m in ("head", "tail")]
    return cut[0].unionByName(cut[1])


@query("series_checks", sql("series labels_h filled", f"""
  , p as (select entity, count(distinct t) as points from series group by 1),
  m as (select entity, count(distinct t) as marked from labels_h where label = 0 group by 1)
  select entity, 'channel_mismatch' as violation from (
    select entity, channel, count(distinct {SPLIT_SQL}) as n from series
    where not (channel = 'view' and t >= {fx.TRAIN}) group by 1, 2) where n < 2 group by 1
  union all
  select p.entity, 'label_length' from p left join m using (entity)
  where coalesce(marked, 0) <> points
  union all
  select distinct entity, 'unfilled' from filled where value is null"""))
def series_checks(spark, sf):
    broken = fx.series_hourly(spark, sf).where(f"not (channel = 'view' and t >= {fx.TRAIN})")
    short = fx.labels_hourly(spark, sf).where("label = 0")
    return clean.series_checks(broken, short, by_half(), filled(spark, sf))


@query("family_of", sql("", """
  select entity, case when starts_with(entity, 'SMD-') then 'SMD'
                      else split_part(entity, '@', 1) end as family from (
    select case when s_suppkey % 2 = 0 then 'SMD-machine-' || (s_nationkey + 1)::varchar || '-'
                     || s_suppkey::varchar
                else 'MSL@' || s_name end as entity from supplier)"""))
def family_of(spark, sf):
    s = table(spark, sf, "supplier")
    entity = F.when(F.col("s_suppkey") % 2 == 0, F.concat_ws(
        "-", F.lit("SMD"), F.lit("machine"), F.col("s_nationkey") + 1, "s_suppkey")).otherwise(
        F.concat(F.lit("MSL@"), "s_name"))
    return s.select(entity.alias("entity")).withColumn("family", clean.family_of("entity"))


@query("robust_fit", sql("scaler", """
  select entity, channel, round(center + 1.3e-9, 6) + 0.0 as center, round(scale + 1.3e-9, 6) + 0.0 as scale
  from scaler"""))
def robust_fit(spark, sf):
    return scaler(filled(spark, sf)).select(
        "entity", "channel", rounded("center").alias("center"), rounded("scale").alias("scale"))


@query("robust_transform", sql("scaled", """
  select entity, t, channel, round(value + 1.3e-9, 6) + 0.0 as value from scaled"""))
def robust_transform(spark, sf):
    return scaled(spark, sf).withColumn("value", rounded("value"))


@query("robust_inverse", sql("filled", """
  select entity, t, channel, round(value + 1.3e-9, 6) + 0.0 as value from filled"""))
def robust_inverse(spark, sf):
    f = filled(spark, sf)
    stats = scaler(f)
    there = scale.robust_transform(f, stats)
    return scale.robust_transform(there, stats, inverse=True).withColumn(
        "value", rounded("value"))


@query("split_three", sql("series", """
  , n as (select entity, max(t) + 1 as n from series group by 1)
  select entity, part, count(*)::bigint as cells, min(t) as first_t, max(t) as last_t from (
    select s.entity, s.t, case when t < floor(n * 0.6::double) then 'base'
      when t < floor(n * 0.6::double) + floor(n * 0.2::double) then 'adapt'
      when t < floor(n * 0.6::double) + floor(n * 0.2::double) + floor(n * 0.1::double)
        then 'val' end as part
    from series s join n using (entity)) group by 1, 2"""))
def split_three(spark, sf):
    s = fx.series_hourly(spark, sf)
    named = attach(s, scale.lengths(s), ["entity"]).withColumn(
        "part", scale.split_three(F.col("n"), F.col("t"), 0.6, 0.2, 0.1))
    return named.groupBy("entity", "part").agg(
        F.count("*").alias("cells"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


@query("split_four", sql("series", """
  , n as (select entity, max(t) + 1 as n from series group by 1),
  b as (select entity, n, floor(n * 0.7::double) as a,
               floor(n * 0.7::double) + floor(n * 0.1::double) as b,
               floor(n * 0.7::double) + 2 * floor(n * 0.1::double) as c from n)
  select entity, part, fit, count(*)::bigint as cells, min(t) as first_t, max(t) as last_t from (
    select s.entity, t, case when t < a then 'base' when t < b.b then 'memory'
             when t < c then 'adapt' else 'normal' end as part,
           t < floor(a * (1.0::double - 0.15::double)) as fit
    from series s join b using (entity)) group by 1, 2, 3"""))
def split_four(spark, sf):
    s = fx.series_hourly(spark, sf)
    n, t = F.col("n"), F.col("t")
    named = attach(s, scale.lengths(s), ["entity"]).select(
        "entity", "t", scale.split_four(n, t).alias("part"),
        (t < scale.base_fit_stop(n)).alias("fit"))
    return named.groupBy("entity", "part", "fit").agg(
        F.count("*").alias("cells"), F.min("t").alias("first_t"), F.max("t").alias("last_t"))


BLOCKS_SQL = f"""
  , u as (select distinct entity, t - {fx.TRAIN} as u from series where t >= {fx.TRAIN}),
  n as (select entity, max(u) + 1 as n from u group by 1),
  b as (select entity, u, case when n % {fx.BLOCK} > 0 and n % {fx.BLOCK} < {fx.L + fx.H + 1}
               and n > {fx.BLOCK}
          then least(u // {fx.BLOCK}, n // {fx.BLOCK} - 1) else u // {fx.BLOCK} end as segment
        from u join n using (entity)),
  segments as (select entity, segment::bigint as segment,
                      case when segment % 5 = 0 then 'score' else 'test' end as role,
                      (min(u) + {fx.TRAIN})::bigint as start, count(*)::bigint as length
               from b group by 1, 2, 3)"""


def segments(spark, sf):
    s = fx.series_hourly(spark, sf).select("entity", "t", "channel")
    r = scale.roles(s, fx.TRAIN, fx.L, fx.H, fx.BLOCK).where("role in ('score', 'test')")
    return r.groupBy("entity", "segment", "role", "start", "length").agg(
        F.countDistinct("t").alias("steps"))


@query("split_blocks", sql("series", BLOCKS_SQL + """
  select entity, segment, role, start, length, length as steps from segments"""))
def split_blocks(spark, sf):
    return segments(spark, sf)


@query("segment_offsets", sql("series", BLOCKS_SQL + """
  select entity, role, segment, length,
         coalesce(sum(length) over (partition by entity, role order by segment
           rows between unbounded preceding and 1 preceding), 0)::bigint as "offset"
  from segments"""))
def segment_offsets(spark, sf):
    return scale.segment_offsets(
        segments(spark, sf).select("entity", "role", "segment", "length"), ["entity", "role"])


@query("split_checks", sql("daily", f"""
  , n as (select entity, count(distinct t)::bigint as n from daily
          where value is not null group by 1),
  b as (select entity, n, floor(n * 0.7::double)::bigint as base,
               floor(n * 0.1::double)::bigint as tenth from n),
  p as (select entity, unnest(['base', 'memory', 'adapt', 'normal', 'base_fit',
                               'base_validation']) as part,
               unnest([base, tenth, tenth, n - base - 2 * tenth,
                       floor(base * (1.0::double - 0.15::double))::bigint,
                       base - floor(base * (1.0::double - 0.15::double))::bigint]) as size
        from b)
  select entity, part, size, size >= 192 + 8 as long_enough from p"""))
def split_checks(spark, sf):
    daily = fx.series_daily(spark, sf).where("value is not null")
    return scale.split_checks(daily.groupBy("entity").agg(
        F.countDistinct("t").alias("n")), 192, 8)
