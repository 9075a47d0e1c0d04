"""Events and experiment sweeps that need detection results."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.functions.columns import rounded
from spark_analog.operators import evaluate, events, fuse, memory, retrieve, scale, score
from spark_analog.operators.staging import stage
from spark_analog.plans import ablation
from spark_analog.queries import fixtures as fx
from spark_analog.queries.q_detect import settings
from spark_analog.queries.q_fusion import fused
from spark_analog.queries.q_score import ap_sql, fixed_points, parts
from spark_analog.queries.q_windows import KEYS, featured, retrieved, uniform_bank
from spark_analog.queries.registry import memo, part, query, sql

RADIUS = 12
L, H = fx.L, fx.H

part("lab", "labels_h", f"""
  select entity, (t - {fx.TRAIN}) // {fx.BLOCK} as segment, t, label,
         {fx.TRAIN} + (t - {fx.TRAIN}) // {fx.BLOCK} * {fx.BLOCK} as start from labels_h
  where t >= {fx.TRAIN} and (t - {fx.TRAIN}) // {fx.BLOCK} % 5 <> 0""")
part("events", "lab", f"""
  select entity, segment::bigint as segment, min(t) as event_start, max(t) + 1 as event_stop,
         greatest(any_value(start), min(t) - {RADIUS}) as interval_start,
         least(any_value(start) + {fx.BLOCK}, max(t) + 1 + {RADIUS}) as interval_stop
  from (select *, t - row_number() over (partition by entity, segment order by t) as island
        from lab where label > 0) group by entity, segment, island""")
part("residual_pts", "comp", """
  select entity, t, round(avg(residual), 9) as score from (
    select *, row_number() over (partition by entity, role, segment, t order by residual desc) as rn,
           count(*) over (partition by entity, role, segment, t) as c from comp
    where role = 'test')
  where rn <= greatest(1, ceil(0.4::double * c)) group by 1, 2""")
part("two", "lab residual_pts fixed", """
  select l.entity, l.segment, l.t, l.label, a.score as a, b.score as b
  from lab l left join residual_pts a using (entity, t)
  left join (select entity, t, score from fixed) b using (entity, t)""")
part("near_two", "events two", """
  select e.entity, e.segment, e.event_start, t.label, t.a, t.b from events e join two t
    on e.entity = t.entity and e.segment = t.segment
   and t.t >= e.interval_start and t.t < e.interval_stop""")
part("near_side", "near_two", """
  select entity, segment, event_start, 'a' as side, label, a as score from near_two
  where a is not null and b is not null
  union all select entity, segment, event_start, 'b', label, b from near_two
  where a is not null and b is not null""")
ap_sql("near_ap", "near_side", "entity, segment, event_start, side")
part("effects", "events near_two near_ap", """
  select e.*, n.positive_points, n.interval_points, x.a as first_auprc, x.b as second_auprc,
         x.b - x.a as effect
  from events e join (select entity, segment, event_start, sum(label)::bigint as positive_points,
                             count(*)::bigint as interval_points from near_two group by 1, 2, 3) n
    using (entity, segment, event_start)
  join (select entity, segment, event_start, max(auprc) filter (side = 'a') as a,
               max(auprc) filter (side = 'b') as b from near_ap where n_evaluated >= 2
        group by 1, 2, 3) x using (entity, segment, event_start)
  where x.a is not null and x.b is not null""")
part("extremes", "effects", """
  select entity, segment, event_start, 'success' as selected_as from (
    select *, row_number() over (partition by entity order by round(effect, 9) desc, segment,
                                 event_start) as rn from effects) where rn = 1""")
part("extremes2", "effects extremes", """
  select * from extremes union all
  select entity, segment, event_start, 'failure' from (
    select *, row_number() over (partition by entity order by round(effect, 9), segment,
                                 event_start) as rn
    from effects e where not exists (select 1 from extremes x where x.entity = e.entity
      and x.segment = e.segment and x.event_start = e.event_start)) where rn = 1""")


def labelled(spark, sf):
    return scale.roles(fx.labels_hourly(spark, sf), fx.TRAIN, L, H, fx.BLOCK).where(
        "role = 'test'")


def all_events(spark, sf):
    return events.enumerate_events(labelled(spark, sf), RADIUS)


@memo
def two_scores(spark, sf):
    rows = score.channel_lists(parts(spark, sf).where("role = 'test'"))
    a = rows.select("entity", "t", F.round(score.top_q_mean(
        score.combined(0.0, 0.0), 0.4), 9).alias("a"))
    b = fixed_points(spark, sf).select("entity", "t", F.round("score", 9).alias("b"))
    pts = labelled(spark, sf).select("entity", "segment", "t", "label")
    return stage(pts.join(a, ["entity", "t"], "left").join(b, ["entity", "t"], "left"))


@memo
def effects(spark, sf):
    return stage(events.event_effects(all_events(spark, sf), two_scores(spark, sf), "a", "b"))


@memo
def extremes(spark, sf):
    return stage(events.event_extremes(effects(spark, sf)))


EVENT_COLUMNS = ["entity", "segment", "event_start", "event_stop", "interval_start",
                 "interval_stop"]


@query("events_enumerate", sql("events", "select * from events"))
def events_enumerate(spark, sf):
    return all_events(spark, sf)


EFFECT_SQL = """entity, segment, event_start, event_stop, interval_start, interval_stop,
  interval_points, positive_points, round(first_auprc + 1.3e-9, 6) + 0.0 as first_auprc,
  round(second_auprc + 1.3e-9, 6) + 0.0 as second_auprc, round(effect + 1.3e-9, 6) + 0.0 as effect"""


def effect_columns(df, *more):
    return df.select(*EVENT_COLUMNS, "interval_points",
                     F.col("positive_points").cast("bigint").alias("positive_points"),
                     *[rounded(c).alias(c) for c in ("first_auprc", "second_auprc", "effect")],
                     *more)


@query("event_effect", sql("effects", f"select {EFFECT_SQL} from effects"))
def event_effect(spark, sf):
    return effect_columns(effects(spark, sf))


@query("event_extremes", sql("extremes2", "select * from extremes2"))
def event_extremes(spark, sf):
    return extremes(spark, sf)


@query("event_audit", sql("effects extremes2", f"""
  select {EFFECT_SQL}, selected_as from effects left join extremes2
    using (entity, segment, event_start)"""))
def event_audit(spark, sf):
    return effect_columns(events.event_audit(effects(spark, sf), extremes(spark, sf)),
                          "selected_as")


part("gains", "fused", """
  select entity, segment, w, channel,
         round(avg((native - y) ** 2) - avg((yhat - y) ** 2), 9) as gain
  from fused where role = 'test' group by 1, 2, 3, 4""")


@query("event_window", sql("events extremes2 gains", f"""
  , sel as (select e.*, selected_as from events e join extremes2
              using (entity, segment, event_start)),
  direct as (select s.entity, s.segment, s.event_start, s.event_stop, selected_as, g.w, g.channel,
                    g.gain
             from sel s join gains g on g.entity = s.entity and g.segment = s.segment
               and g.w < s.event_stop and g.w + {H} > s.event_start),
  bare as (select s.entity, s.segment, s.event_start, s.event_stop, selected_as, g.w, g.channel,
                  g.gain, row_number() over (partition by s.entity, s.segment, s.event_start,
                    selected_as, g.channel order by abs(g.w - s.event_start), g.w) as near
           from sel s join gains g on g.entity = s.entity
           where not exists (select 1 from direct d where d.entity = s.entity
             and d.segment = s.segment and d.event_start = s.event_start
             and d.selected_as = s.selected_as)),
  every as (select * from direct union all select * exclude (near) from bare where near = 1)
  select entity, segment, event_start, event_stop, selected_as, channel, w as forecast_start,
         w + {H} as forecast_stop, round(gain + 1.3e-9, 6) + 0.0 as gain from (
    select *, row_number() over (partition by entity, segment, event_start, selected_as
      order by case when selected_as = 'success' then -gain else gain end, w, channel) as rn
    from every) where rn = 1"""))
def event_window(spark, sf):
    return chosen_windows(spark, sf).withColumn("gain", rounded("gain"))


def chosen_windows(spark, sf):
    chosen = extremes(spark, sf).join(all_events(spark, sf), ["entity", "segment", "event_start"])
    return events.event_windows(chosen, fused(spark, sf).where("role = 'test'"), H)


@query("event_case")
def event_case(spark, sf):
    at = chosen_windows(spark, sf).join(
        all_events(spark, sf).drop("event_stop"), ["entity", "segment", "event_start"])
    ctx = featured(spark, sf).where("role = 'test'")
    bank, _ = uniform_bank(spark, sf)
    stored = memory.bank_contexts(bank, featured(spark, sf).where("role = 'memory'"))
    return events.event_cases(at, ctx, fused(spark, sf).where("role = 'test'"), stored)


@query("event_trace", sql("events extremes2 two", """
  select e.entity, e.segment, e.event_start, ((t.t - e.interval_start) // 16)::int as chunk, t.t,
         t.label::int as label, round(t.a + 1.3e-9, 6) + 0.0 as native_score,
         round(t.b + 1.3e-9, 6) + 0.0 as fused_score
  from events e join extremes2 using (entity, segment, event_start)
  join two t on t.entity = e.entity and t.segment = e.segment
    and t.t >= e.interval_start and t.t < e.interval_stop"""))
def event_trace(spark, sf):
    at = extremes(spark, sf).join(all_events(spark, sf), ["entity", "segment", "event_start"])
    points = two_scores(spark, sf).withColumnsRenamed({"a": "native_score", "b": "fused_score"})
    rows = events.event_traces(at, points, chunk=16).select(
        *events.EVENT, "chunk", F.explode("trace").alias("p"))
    return rows.select(*events.EVENT, "chunk", "p.t", "p.label", rounded("p.native_score").alias("native_score"),
                       rounded("p.fused_score").alias("fused_score"))


# --- sweeps --------------------------------------------------------------------------------------
@query("sensitivity_k", sql("scaled_feats bank", f"""
  , d as (select q.entity, q.role, q.segment, q.channel, q.w, q.last, q.fut, b.src_w, b.delta,
                 round(list_distance(q.feat, b.feat) / sqrt(21), 9) as distance
          from scaled_feats q join bank b using (entity, channel)
          where q.role in ('normal', 'score', 'test')),
  r as (select *, row_number() over (partition by entity, role, segment, channel, w
                                     order by distance, src_w) as rank from d),
  k as (select r.*, k, exp(-(distance - min(distance) over p) / 0.15) as e
        from r, (select unnest([1, 3, 5, 10])::int as k) where rank <= k
        window p as (partition by entity, role, segment, channel, w, k)),
  f as (select entity, role, segment, channel, w, k, h, any_value(fut[h + 1]) as y,
               sum(e * (last + delta[h + 1])) / sum(e) as yhat
        from k, (select unnest(range({H})) as h) group by 1, 2, 3, 4, 5, 6, 7)
  select entity, role, k, round(avg(abs(yhat - y)) + 1.3e-9, 6) + 0.0 as mae, count(*)::bigint as n
  from f group by 1, 2, 3"""))
def sensitivity_k(spark, sf):
    from spark_analog.operators import windows
    from spark_analog.queries.q_windows import QUERY_ROLES, blocked
    packed = memory.pack_bank(*uniform_bank(spark, sf))
    rows = blocked(spark, sf).where(F.col("role").isin(*QUERY_ROLES))
    widest = windows.scan(rows, L, H, bank=packed, k=10)
    return ablation.sensitivity_k(widest, H, (1, 3, 5, 10)).withColumn("mae", rounded("mae"))


part("sens", "comp labels_h", """
  select entity, weight, label, score from (
    select entity, t, weight, round(avg(v), 9) as score from (
      select *, row_number() over (partition by entity, role, segment, t, weight
                                   order by v desc) as rn,
             count(*) over (partition by entity, role, segment, t, weight) as c from (
        select c.*, weight, residual + weight * memory + 0.25 * agreement as v
        from comp c, (select unnest([0.0, 0.25, 1.0, 4.0])::double as weight)
        where role = 'test'))
    where rn <= greatest(1, ceil(0.4::double * c)) group by 1, 2, 3)
  join labels_h using (entity, t)""")
ap_sql("sens_ap", "sens", "entity, weight")


@query("sensitivity_weight", sql("sens_ap", """
  select entity, weight, round(auprc + 1.3e-9, 6) + 0.0 as auprc, round(auroc + 1.3e-9, 6) + 0.0 as auroc
  from sens_ap"""))
def sensitivity_weight(spark, sf):
    late = parts(spark, sf).where("role = 'test'")
    m = ablation.sensitivity_weight(late, fx.labels_hourly(spark, sf), (0.0, 0.25, 1.0, 4.0))
    return m.select("entity", "weight", rounded("auprc").alias("auprc"),
                    rounded("auroc").alias("auroc"))


@query("ablation_components")
def ablation_components(spark, sf):
    return ablation.components(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf),
                               settings())
