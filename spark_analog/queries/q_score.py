"""Scoring: residuals, calibration, components, selection, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.defaults import AGREEMENT_GRID, MEMORY_GRID, SMOOTHING_GRID, TOP_Q_GRID
from spark_analog.functions.columns import clip, rounded
from spark_analog.operators import evaluate, fuse, grid_search, score
from spark_analog.operators.staging import attach, stage
from spark_analog.queries import fixtures as fx
from spark_analog.queries.q_fusion import WKEY, fused
from spark_analog.queries.q_windows import KEYS, retrieved
from spark_analog.queries.registry import memo, part, query, sql

CH = ["entity", "channel"]
EPS = "2.220446049250313e-16::double"
AXES = dict(top_q=(0.2, 0.4, 1.0), memory=(0.0, 0.25, 1.0), agreement=(0.0, 0.25),
            smoothing=(1, 3))

part("resid", "fused", f"""
  select {WKEY}, h, w + h as t, abs(yhat - y) as r, divergence, nearest from fused""")
part("mad", "resid", """
  select entity, channel, center, case when m > 1e-6 then m when mean > 1e-6 then mean
           else 1e-6 end as scale from (
    select entity, channel, any_value(center) as center,
           1.4826 * quantile_cont(abs(r - center), 0.5) as m, avg(abs(r - center)) as mean
    from resid join (select entity, channel, quantile_cont(r, 0.5) as center from resid
                     where role = 'normal' group by 1, 2) using (entity, channel)
    where role = 'normal' group by 1, 2)""")
part("z", "resid mad", f"""
  select r.*, greatest((r - center) / (scale + {EPS}), 0) as z
  from resid r join mad using (entity, channel)""")


def calibrated(name, source, value, tail):
    """Reference rows (normal) and all others in one ordered pass per channel."""
    score_sql = ("least(-ln(1 - cdf), 12.0)" if tail else "1 - cdf")
    part(name, source, f"""
      select * exclude (cdf), {score_sql} as {name} from (
        select *, least(greatest((cum + 0.5) / (n + 1), 1e-5), 1 - 1e-5) as cdf from (
          select *, sum((role = 'normal')::int) over (partition by entity, channel order by {value}
                      range between unbounded preceding and current row) as cum,
                 sum((role = 'normal')::int) over (partition by entity, channel) as n
          from {source}))""")


part("near", "resid", f"select {WKEY}, any_value(nearest) as nearest from resid group by {WKEY}")
calibrated("memory", "near", "nearest", True)
calibrated("agreement", "resid", "divergence", False)
part("comp", "z memory agreement", f"""
  select z.entity, z.role, z.segment, z.channel, z.t, avg(z) as residual, avg(m.memory) as memory,
         avg(z * least(greatest(a.agreement, 0), 1)) as agreement, count(z)::bigint as n
  from z join memory m using ({WKEY}) join agreement a using ({WKEY}, h)
  where z.role <> 'normal' group by 1, 2, 3, 4, 5""")


@memo
def steps(spark, sf):
    return stage(score.residual_steps(fused(spark, sf), [*KEYS, "w", "nearest"], ["divergence"]))


@memo
def stats(spark, sf):
    return stage(score.mad_stats(steps(spark, sf).where("role = 'normal'")))


def z_steps(spark, sf):
    return attach(steps(spark, sf), stats(spark, sf), CH).withColumn("z", score.z_score())


@query("residuals", sql("resid fused", f"""
  select {WKEY}, h, t, round(r + 1.3e-9, 6) + 0.0 as absolute, round((yhat - y) ** 2 + 1.3e-9, 6) + 0.0 as squared
  from resid join fused using ({WKEY}, h)"""))
def residuals(spark, sf):
    f = fused(spark, sf)
    a = score.residual_steps(f).withColumnRenamed("r", "absolute")
    return a.select(*KEYS, "w", "h", "t", rounded("absolute").alias("absolute"),
                    rounded(score.magnitude(F.col("absolute"), "squared")).alias("squared"))


@query("mad_stats", sql("mad", """
  select entity, channel, round(center + 1.3e-9, 6) + 0.0 as center, round(scale + 1.3e-9, 6) + 0.0 as scale
  from mad"""))
def mad_stats(spark, sf):
    return stats(spark, sf).select("entity", "channel", rounded("center").alias("center"),
                                   rounded("scale").alias("scale"))


@query("residual_z", sql("resid mad", f"""
  select {WKEY}, h, round((r - center) / (scale + {EPS}) + 1.3e-9, 6) + 0.0 as z,
         round(greatest((r - center) / (scale + {EPS}), 0) + 1.3e-9, 6) + 0.0 as clipped
  from resid join mad using (entity, channel)"""))
def residual_z(spark, sf):
    return z_steps(spark, sf).select(*KEYS, "w", "h",
                                     rounded(score.z_score(clip_negative=False)).alias("z"),
                                     rounded("z").alias("clipped"))


CONFIDENCE = {"uncertainty": "z * (2 - c)", "inverse": "z / greatest(least(c, 1), 0.1)",
              "gate": "z * c"}


def confidence_query(mode):
    @query(f"confidence_{mode}", sql("z", f"""
      select {WKEY}, h, round({CONFIDENCE[mode]} + 1.3e-9, 6) + 0.0 as z
      from (select *, greatest(least(1 / (1 + nearest), 1), 0) as c from z)"""))
    def run(spark, sf):
        c = F.lit(1.0) / (F.lit(1.0) + F.col("nearest"))
        return z_steps(spark, sf).select(
            *KEYS, "w", "h", rounded(score.with_confidence(F.col("z"), c, mode)).alias("z"))
    return run


for _mode in CONFIDENCE:
    confidence_query(_mode)


@query("score_agreement", sql("z", f"""
  select {WKEY}, h, round(z * (1 + 0.5 * least(greatest(exp(-divergence), 0), 1)) + 1.3e-9, 6) + 0.0 as z
  from z"""))
def score_agreement(spark, sf):
    z = score.with_agreement(F.col("z"), F.exp(-F.col("divergence")), 0.5)
    return z_steps(spark, sf).select(*KEYS, "w", "h", rounded(z).alias("z"))


@query("score_additive", sql("z", f"""
  select {WKEY}, h, round(z + 0.25 * nearest + 0.5 * divergence + 1.3e-9, 6) + 0.0 as z from z"""))
def score_additive(spark, sf):
    z = score.with_terms(F.col("z"), "nearest", 0.25, "divergence", 0.5)
    return z_steps(spark, sf).select(*KEYS, "w", "h", rounded(z).alias("z"))


@query("overlap_add", sql("z", """
  select entity, role, segment, channel, t, round(avg(z) + 1.3e-9, 6) + 0.0 as z, count(z)::bigint as n
  from z group by 1, 2, 3, 4, 5"""))
def overlap_add(spark, sf):
    return score.overlap_add(z_steps(spark, sf), ["z"]).withColumn("z", rounded("z"))


@query("coverage", sql("z series", f"""
  , grid as (select distinct entity, t, channel from series where t >= {fx.TRAIN}),
  n as (select entity, channel, t, count(z)::bigint as n from z where role <> 'normal'
        group by 1, 2, 3)
  select g.entity, g.t, g.channel, coalesce(n.n, 0)::bigint as n, n.n is not null as covered
  from grid g left join n using (entity, channel, t)"""))
def coverage(spark, sf):
    grid = fx.series_hourly(spark, sf).where(f"t >= {fx.TRAIN}").select("entity", "t", "channel")
    late = z_steps(spark, sf).where("role <> 'normal'")
    n = score.overlap_add(late, ["z"], ["entity", "channel"]).select("entity", "channel", "t", "n")
    return grid.join(n, ["entity", "channel", "t"], "left").select(
        "entity", "t", "channel", F.coalesce("n", F.lit(0)).alias("n"),
        F.col("n").isNotNull().alias("covered"))


@query("ecdf_tail", sql("memory", f"""
  select {WKEY}, round(memory + 1.3e-9, 6) + 0.0 as tail from memory"""))
def ecdf_tail(spark, sf):
    r = retrieved(spark, sf).select(*KEYS, "w", "nearest")
    out = score.calibrate(r, r.where("role = 'normal'"), "nearest", "tail", True)
    return out.select(*KEYS, "w", rounded("tail").alias("tail"))


@query("ecdf_agreement", sql("agreement", f"""
  select {WKEY}, h, round(agreement + 1.3e-9, 6) + 0.0 as agreement from agreement"""))
def ecdf_agreement(spark, sf):
    s = steps(spark, sf)
    out = score.calibrate(s, s.where("role = 'normal'"), "divergence", "agreement", False)
    return out.select(*KEYS, "w", "h", rounded("agreement").alias("agreement"))


@memo
def parts(spark, sf):
    f = fused(spark, sf)
    late = score.signal_steps(f.where("role <> 'normal'"), f.where("role = 'normal'"))
    return stage(score.components(late, stats(spark, sf)))


@query("score_components", sql("comp", """
  select entity, role, segment, channel, t, round(residual + 1.3e-9, 6) + 0.0 as residual,
         round(memory + 1.3e-9, 6) + 0.0 as memory, round(agreement + 1.3e-9, 6) + 0.0 as agreement, n from comp"""))
def score_components(spark, sf):
    return parts(spark, sf).select(*KEYS, "t", *[rounded(c).alias(c) for c in (
        "residual", "memory", "agreement")], "n")


@query("nn_score", sql("memory fused", f"""
  select m.entity, m.role, m.segment, m.channel, m.w + h as t,
         round(avg(m.memory) + 1.3e-9, 6) + 0.0 as score
  from memory m, (select unnest(range({fx.H})) as h) where role <> 'normal'
  group by 1, 2, 3, 4, 5"""))
def nn_score(spark, sf):
    r = retrieved(spark, sf).withColumn("yhat", F.col("native"))
    late = score.signal_steps(r.where("role <> 'normal'"), r.where("role = 'normal'"))
    return score.overlap_add(late, ["memory"]).select(
        *KEYS, "t", rounded("memory").alias("score"))


part("ranked", "comp", """
  select *, row_number() over (partition by entity, role, segment, t order by s desc) as rn,
         count(*) over (partition by entity, role, segment, t) as c
  from (select *, residual + 0.25 * memory + 0.25 * agreement as s from comp)""")
part("pts", "ranked", """
  select entity, role, segment, t, avg(s) as score from ranked
  where rn <= greatest(1, ceil(0.4::double * c)) group by 1, 2, 3, 4""")


@query("top_q", sql("pts", """
  select entity, role, segment, t, round(score + 1.3e-9, 6) + 0.0 as score from pts"""))
def top_q(spark, sf):
    rows = score.channel_lists(parts(spark, sf))
    return rows.select("entity", "role", "segment", "t", rounded(score.top_q_mean(
        score.combined(0.25, 0.25), 0.4)).alias("score"))


part("smooth", "pts", """
  select *, avg(score) over (partition by entity, role, segment order by t
                             range between 2 preceding and current row) as smooth from pts""")


@query("causal_smooth", sql("smooth", """
  select entity, role, segment, t, round(smooth + 1.3e-9, 6) + 0.0 as score from smooth"""))
def causal_smooth(spark, sf):
    rows = score.channel_lists(parts(spark, sf))
    raw = rows.select("entity", "role", "segment", "t", score.top_q_mean(
        score.combined(0.25, 0.25), 0.4).alias("score"))
    return score.causal_smooth(raw, [3]).select(
        "entity", "role", "segment", "t", rounded("smooth_3").alias("score"))


@query("point_scores", sql("smooth labels_h", f"""
  select l.entity, l.t, round(s.smooth + 1.3e-9, 6) + 0.0 as score, l.label from labels_h l
  left join (select * from smooth where role = 'test') s using (entity, t)
  where l.t >= {fx.TRAIN} and (l.t - {fx.TRAIN}) // {fx.BLOCK} % 5 <> 0"""))
def point_scores(spark, sf):
    return fixed_points(spark, sf).select("entity", "t", rounded("score").alias("score"), "label")


def fixed_points(spark, sf):
    from spark_analog.plans.detect import label_points
    from spark_analog.queries.q_detect import settings
    p = parts(spark, sf).where("role = 'test'")
    params = p.select("entity").distinct().select(
        "entity", F.lit(0.4).alias("top_q"), F.lit(0.25).alias("memory_weight"),
        F.lit(0.25).alias("agreement_weight"), F.lit(3).alias("smoothing"))
    return label_points(score.apply_parameters(p, params), fx.labels_hourly(spark, sf), settings())


# --- grid selection ------------------------------------------------------------------------------
part("gridded", "comp labels_h", """
  , combos as (select q, m, a, s, row_number() over () - 1 as grid_id from (
      select q, m, a, s from (select unnest([0.2, 0.4, 1.0])::double as q, unnest(range(3)) as qi),
        (select unnest([0.0, 0.25, 1.0])::double as m, unnest(range(3)) as mi),
        (select unnest([0.0, 0.25])::double as a, unnest(range(2)) as ai),
        (select unnest([1, 3]) as s, unnest(range(2)) as si) order by qi, mi, ai, si)),
  mixed as (select entity, segment, t, grid_id, q, s,
                   residual + m * memory + a * agreement as v
            from comp, combos where role = 'score'),
  rk as (select *, row_number() over (partition by entity, segment, t, grid_id order by v desc) as rn,
                count(*) over (partition by entity, segment, t, grid_id) as c from mixed),
  pt as (select entity, segment, t, grid_id, s, round(avg(v), 9) as score from rk
         where rn <= greatest(1, ceil(q * c)) group by 1, 2, 3, 4, 5),
  sm as (select entity, segment, t, grid_id, round(case when s = 1 then score else
           avg(score) over (partition by entity, segment, grid_id order by t
             range between 2 preceding and current row) end, 9) as score from pt)
  select sm.*, label from sm join labels_h using (entity, t)""".replace("\n  , combos", "\n  with combos"))


def ap_sql(name, source, keys):
    part(name, source, f"""
      select {keys}, case when sum(pos) > 0 and sum(pos) < sum(cnt)
                          then sum(pos * tp / seen::double) / sum(pos) end as auprc,
             case when sum(pos) > 0 and sum(pos) < sum(cnt) then
               1 + sum(pos * ((cnt - pos) / 2.0::double - (seen - tp))) / (sum(pos) * sum(cnt - pos)::double)
             end as auroc, sum(cnt)::bigint as n_evaluated, sum(pos)::bigint as positives from (
        select *, sum(pos) over (partition by {keys} order by score desc) as tp,
               sum(cnt) over (partition by {keys} order by score desc) as seen from (
          select {keys}, score, sum((label > 0)::int) as pos, count(*) as cnt from {source}
          where score is not null group by {keys}, score)) group by {keys}""")


ap_sql("grid_ap", "gridded", "entity, grid_id")
ap_sql("grid_ap_seg", "gridded", "entity, segment, grid_id")


def objectives(spark, sf, selection, **axes):
    return grid_search.grid_objectives(parts(spark, sf).where("role = 'score'"), fx.labels_hourly(spark, sf),
                                       selection=selection, **axes)


# All grid points of defaults.py: a score is ranked once per pair of weights, shares and widths only pick from it.
LISTS = {name: "[" + ", ".join(map(str, grid)) + "]" for name, grid in (
    ("q", TOP_Q_GRID), ("m", MEMORY_GRID), ("a", AGREEMENT_GRID), ("s", SMOOTHING_GRID))}
SIZES = [len(g) for g in (TOP_Q_GRID, MEMORY_GRID, AGREEMENT_GRID, SMOOTHING_GRID)]
part("gridded_all", "comp labels_h", f"""
  with qs as (select unnest({LISTS['q']})::double as q, unnest(range({SIZES[0]})) as qi),
  ms as (select unnest({LISTS['m']})::double as m, unnest(range({SIZES[1]})) as mi),
  aggs as (select unnest({LISTS['a']})::double as a, unnest(range({SIZES[2]})) as ai),
  rk as (select entity, segment, t, mi, ai, v,
                row_number() over (partition by entity, segment, t, mi, ai order by v desc) as rn,
                count(*) over (partition by entity, segment, t, mi, ai) as c
         from (select entity, segment, t, mi, ai, residual + m * memory + a * agreement as v
               from comp, ms, aggs where role = 'score')),
  pt as (select entity, segment, t, mi, ai, qi, round(avg(v), 9) as score from rk, qs
         where rn <= greatest(1, ceil(q * c)) group by 1, 2, 3, 4, 5, 6),
  sm as ({" union all ".join(f"""
         select entity, segment, t, mi, ai, qi, {i} as si, {"score" if w <= 1 else f"""round(avg(score) over (
           partition by entity, segment, mi, ai, qi order by t range between {w - 1} preceding and current row), 9)"""} as score
         from pt""" for i, w in enumerate(SMOOTHING_GRID))})
  select entity, segment, t, ((qi * {SIZES[1]} + mi) * {SIZES[2]} + ai) * {SIZES[3]} + si as grid_id, score, label
  from sm join labels_h using (entity, t)""")
ap_sql("grid_ap_all", "gridded_all", "entity, grid_id")


@query("select_score_params", sql("grid_ap_all", f"""
  , best as (select *, row_number() over (partition by entity
                       order by round(auprc, 9) desc nulls last, grid_id) as rn from grid_ap_all),
  p as (select entity, case when auprc is not null then grid_id end as g, auprc from best
        where rn = 1)
  select entity, g::bigint as grid_id,
         case when g is null then 0.2 else ({LISTS['q']})[(g // {SIZES[1] * SIZES[2] * SIZES[3]} + 1)::int] end::double as top_q,
         case when g is null then 0.25 else ({LISTS['m']})[(g // {SIZES[2] * SIZES[3]} % {SIZES[1]} + 1)::int] end::double
           as memory_weight,
         case when g is null then 0.25 else ({LISTS['a']})[(g // {SIZES[3]} % {SIZES[2]} + 1)::int] end::double
           as agreement_weight,
         case when g is null then 1 else ({LISTS['s']})[(g % {SIZES[3]} + 1)::int] end::int as smoothing,
         round(auprc + 1.3e-9, 6) + 0.0 as objective from p"""))
def select_score_params(spark, sf):
    best = score.select_parameters(objectives(spark, sf, "aggregate"))
    return best.withColumn("objective", rounded("objective")).withColumn(
        "grid_id", F.col("grid_id").cast("bigint"))


@query("macro_block_auprc", sql("grid_ap grid_ap_seg", """
  , m as (select entity, grid_id, avg(auprc) as macro, count(auprc)::bigint as blocks
          from grid_ap_seg group by 1, 2)
  select entity, grid_id::bigint as grid_id, blocks,
         round(case when auprc is null then null when blocks >= 2 then macro else auprc end
           + 1.3e-9, 6) + 0.0 as objective
  from grid_ap join m using (entity, grid_id)"""))
def macro_block_auprc(spark, sf):
    o = objectives(spark, sf, "macro_block", **AXES)
    return o.select("entity", F.col("grid_id").cast("bigint").alias("grid_id"), "blocks",
                    rounded("objective").alias("objective"))


@query("select_score_params_all")
def select_score_params_all(spark, sf):
    """As select_score_params, which has the SQL."""
    return select_score_params(spark, sf)


@query("macro_block_auprc_all")
def macro_block_auprc_all(spark, sf):
    """As macro_block_auprc, over all grid points of defaults.py; no SQL."""
    o = objectives(spark, sf, "macro_block")
    return o.select("entity", F.col("grid_id").cast("bigint").alias("grid_id"), "blocks",
                    rounded("objective").alias("objective"))


@query("select_blend", sql("series labels_h", """
  , o as (select s.channel as entity, amount, round(avg(abs(coalesce(value, 0) - 100 * amount)), 3)
                   as objective
          from series s, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as amount) group by 1, 2)
  select entity, min_by(amount, amount) as selected, round(any_value(objective) + 1.3e-9, 6) + 0.0 as objective
  from (select *, max(objective) over (partition by entity) as best from o)
  where objective = best group by 1"""))
def select_blend(spark, sf):
    amounts = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("blend")
    o = fx.series_hourly(spark, sf).select("channel", "value", amounts).groupBy(
        F.col("channel").alias("entity"), "blend").agg(F.round(F.avg(F.abs(
            F.coalesce("value", F.lit(0.0)) - 100 * F.col("blend"))), 3).alias("objective"))
    return score.select_blend(o).withColumn("objective", rounded("objective"))


# --- metrics ---------------------------------------------------------------------------------------
ap_sql("f3_ap", "score_points", "entity")


@query("auprc", sql("f3_ap", "select entity, round(auprc + 1.3e-9, 6) + 0.0 as auprc from f3_ap"))
def auprc(spark, sf):
    return evaluate.average_precision(fx.score_points(spark, sf), ["entity"]).select(
        "entity", rounded("auprc").alias("auprc"))


@query("auroc", sql("f3_ap", "select entity, round(auroc + 1.3e-9, 6) + 0.0 as auroc from f3_ap"))
def auroc(spark, sf):
    return evaluate.average_precision(fx.score_points(spark, sf), ["entity"]).select(
        "entity", rounded("auroc").alias("auroc"))


part("fixed", "smooth labels_h", f"""
  select l.entity, s.segment, l.t, round(s.smooth, 9) as score, l.label from labels_h l
  left join (select * from smooth where role = 'test') s using (entity, t)
  where l.t >= {fx.TRAIN} and (l.t - {fx.TRAIN}) // {fx.BLOCK} % 5 <> 0""")
ap_sql("fixed_ap", "fixed", "entity")
part("fixed_block", "fixed", f"select * replace ((t - {fx.TRAIN}) // {fx.BLOCK} as segment) from fixed")
ap_sql("fixed_ap_seg", "fixed_block", "entity, segment")


def fixed_rounded(spark, sf):
    return stage(fixed_points(spark, sf).withColumn("score", F.round("score", 9)))


SUMMARY = """n_total, t.n_evaluated, n_total - t.n_evaluated as n_dropped, t.positives,
  t.n_evaluated - t.positives as negatives,
  round(t.positives / nullif(t.n_evaluated, 0)::double + 1.3e-9, 6) + 0.0 as positive_rate,
  t.positives = 0 or t.positives = t.n_evaluated as single_class,
  round(auprc + 1.3e-9, 6) + 0.0 as auprc, round(auroc + 1.3e-9, 6) + 0.0 as auroc"""


def summary(df):
    cols = ["positive_rate", "auprc", "auroc"]
    return df.select(*[rounded(c).alias(c) if c in cols else F.col(c) for c in df.columns])


@query("eval_summary", sql("fixed fixed_ap", f"""
  , t as (select entity, count(*)::bigint as n_total, count(score)::bigint as n_evaluated,
                 count(*) filter (score is not null and label > 0)::bigint as positives
          from fixed group by 1)
  select t.entity, {SUMMARY} from t left join fixed_ap using (entity)"""))
def eval_summary(spark, sf):
    return summary(evaluate.summary(fixed_rounded(spark, sf), ["entity"]))


@query("eval_by_group", sql("fixed_block fixed_ap_seg", f"""
  , t as (select entity, segment, count(*)::bigint as n_total, count(score)::bigint as n_evaluated,
                 count(*) filter (score is not null and label > 0)::bigint as positives
          from fixed_block group by 1, 2)
  select t.entity, t.segment, {SUMMARY} from t left join fixed_ap_seg using (entity, segment)"""))
def eval_by_group(spark, sf):
    return summary(evaluate.summary(fixed_rounded(spark, sf), ["entity", "segment"]))
