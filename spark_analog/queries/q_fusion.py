"""Forecast fusion and base forecasts."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.functions.columns import array_sum, rounded
from spark_analog.operators import forecast, fuse, memory, retrieve, windows
from spark_analog.operators.staging import stage
from spark_analog.plans import compare
from spark_analog.queries import fixtures as fx
from spark_analog.queries.q_detect import settings
from spark_analog.queries.q_windows import (
    KEYS, blocked, by_step, gapped, retrieved, uniform_bank,
)
from spark_analog.queries.registry import memo, part, query, sql

L, H, K = fx.L, fx.H, fx.K
WKEY = "entity, role, segment, channel, w"

# weights of every mode, one row per candidate
part("modes", "knn", f"""
  select k.*, dmin, cnt,
         case when rank = 1 then 1.0 else 0.0 end::double as w_nearest, 1.0::double / cnt as w_uniform,
         idw / sum(idw) over p as w_idw, soft / sum(soft) over p as w_softmax,
         (1 / (1 + distance)) / sum(1 / (1 + distance)) over p as w_select
  from (select *, 1 / (1e-4 + distance / greatest(dmin, 1e-3)) as idw,
               exp(-(distance - dmin) / 0.15) as soft
        from (select *, min(distance) over p as dmin, count(*) over p as cnt from knn
              window p as (partition by {WKEY}))) k
  window p as (partition by {WKEY})""")
part("modes_s", "modes", f"""
  select *, coalesce(cut / nullif(sum(cut) over (partition by {WKEY}), 0), 0) as w_sparse
  from (select *, case when w_softmax >= 0.5 / {K} then w_softmax else 0 end as cut from modes)""")
part("modes_h", "modes_s", f"""
  select *, last + delta[h + 1] as future, fut[h + 1] as y
  from modes_s, (select unnest(range({H}))::int as h)""")


def weight_query(mode):
    @query(f"weights_{mode}", sql("modes_s", f"""
      select {WKEY}, rank, round(w_{mode} + 1.3e-9, 6) + 0.0 as weight from modes_s"""))
    def run(spark, sf):
        r = retrieved(spark, sf)
        z = F.posexplode(retrieve.candidate_weights(mode, 0.15, K)).alias("p", "weight")
        return r.select(*KEYS, "w", z).select(
            *KEYS, "w", (F.col("p") + 1).alias("rank"), rounded("weight").alias("weight"))
    return run


for _mode in ("nearest", "uniform", "idw", "softmax", "sparse"):
    weight_query(_mode)


@query("fusion_select", sql("modes_s", f"""
  select {WKEY}, rank, round(w_select + 1.3e-9, 6) + 0.0 as weight from modes_s"""))
def fusion_select(spark, sf):
    z = F.posexplode(retrieve.candidate_weights("select")).alias("p", "weight")
    return retrieved(spark, sf).select(*KEYS, "w", z).select(
        *KEYS, "w", (F.col("p") + 1).alias("rank"), rounded("weight").alias("weight"))


part("idw_fc", "modes_h", f"""
  select {WKEY}, h, any_value(last) as native, any_value(y) as y, sum(w_idw * future) as yhat
  from modes_h group by {WKEY}, h""")


def idw(spark, sf):
    return retrieved(spark, sf).withColumn(
        "yhat", fuse.candidate_forecast("native", H, "idw", k=K))


@query("candidate_forecast", sql("idw_fc", f"""
  select {WKEY}, h, round(yhat + 1.3e-9, 6) + 0.0 as yhat from idw_fc"""))
def candidate_forecast(spark, sf):
    return by_step(idw(spark, sf), [*KEYS, "w"], yhat="yhat")


@query("mae", sql("idw_fc", """
  select entity, role, round(avg(abs(yhat - y)) + 1.3e-9, 6) + 0.0 as mae, count(*)::bigint as n
  from idw_fc group by 1, 2"""))
def mae(spark, sf):
    m = fuse.mae(idw(spark, sf), ["entity", "role"])
    return m.withColumn("mae", rounded("mae"))


@query("choose_temperature", sql("modes", f"""
  , tau as (select unnest([0.05, 0.15, 0.5, 1.0])::double as temperature),
  s as (select m.*, temperature, exp(-(distance - dmin) / temperature) as e
        from modes m, tau where role = 'normal'),
  n as (select *, e / sum(e) over (partition by {WKEY}, temperature) as weight from s),
  f as (select {WKEY}, temperature, h, any_value(fut[h + 1]) as y,
               sum(weight * (last + delta[h + 1])) as yhat
        from n, (select unnest(range({H})) as h) group by {WKEY}, temperature, h),
  l as (select entity, temperature, round(avg(abs(yhat - y)), 9) as mae from f group by 1, 2)
  select entity, temperature, round(mae + 1.3e-9, 6) + 0.0 as mae from (
    select *, row_number() over (partition by entity order by mae, temperature) as rn from l)
  where rn = 1"""))
def choose_temperature(spark, sf):
    best = fuse.choose_temperature(retrieved(spark, sf).where("role = 'normal'"), H, "softmax", K)
    return best.withColumn("mae", rounded("mae"))


@query("gate_features", sql("retr", f"""
  select {WKEY}, round(ln(1 + least(greatest(min(nearest), 0), 1e6)) + 1.3e-9, 6) + 0.0 as log_nearest,
         round(ln(1 + least(greatest(avg(divergence), 0), 1e6)) + 1.3e-9, 6) + 0.0 as log_divergence,
         round(avg(abs(analog - native)) + 1.3e-9, 6) + 0.0 as disagreement,
         (round(avg(abs(analog - y)), 9) < round(avg(abs(native - y)), 9))::int as better
  from retr group by {WKEY}"""))
def gate_features(spark, sf):
    g = fuse.gate_features(retrieved(spark, sf))
    return g.select(*KEYS, "w", *[rounded(c).alias(c) for c in fuse.GATE_FEATURES],
                    "better")


@query("gate_fit")
def gate_fit(spark, sf):
    g = fuse.gate_features(retrieved(spark, sf).where("role = 'normal'"))
    return fuse.fit_logistic(g, fuse.GATE_FEATURES, "better")


@query("adaptive_mix")
def adaptive_mix(spark, sf):
    r = retrieved(spark, sf)
    gate = fuse.fit_logistic(fuse.gate_features(r.where("role = 'normal'")),
                             fuse.GATE_FEATURES, "better")
    return fuse.adaptive_mix(r, gate).select(*KEYS, "w", "gate", "yhat")


@query("fusion_masks", sql("gap_win gap_best", f"""
  select entity, channel, w, nearest is not null as has_reference,
         case when nearest is null then 0.0 else 0.1 end::double as gate,
         case when nearest is null then round(coalesce(ctx[{L}], 0) + 1.3e-9, 6) + 0.0 end as native_kept
  from gap_win left join gap_best using (entity, channel, w)"""))
def fusion_masks(spark, sf):
    f = fuse.fusion(gapped(spark, sf), H)
    return f.select("entity", "channel", "w", (F.size("candidates") > 0).alias("has_reference"),
                    "gate", F.when(F.size("candidates") == 0, rounded(F.col("yhat")[0])).alias(
                        "native_kept"))


@query("fusion_signals", sql("cand_h retr", f"""
  , n as (select {WKEY}, min(ln(1 + nearest)) as nearest_log,
                 avg(ln(1 + divergence)) as divergence_log from retr group by {WKEY})
  select {WKEY}, rank, round(ln(1 + any_value(c.distance)) + 1.3e-9, 6) + 0.0 as log_distance,
         round(avg(abs(future - last)) + 1.3e-9, 6) + 0.0 as disagreement,
         round(any_value(nearest_log) + 1.3e-9, 6) + 0.0 as nearest_log,
         round(any_value(divergence_log) + 1.3e-9, 6) + 0.0 as divergence_log
  from cand_h c join n using ({WKEY}) group by {WKEY}, rank"""))
def fusion_signals(spark, sf):
    s = fuse.fusion_signals(retrieved(spark, sf))
    flat = s.select(*KEYS, "w", "nearest_log", "divergence_log", F.explode("signals").alias("c"))
    return flat.select(*KEYS, "w", "c.rank", *[rounded(c).alias(c.split(".")[-1]) for c in (
        "c.log_distance", "c.disagreement", "nearest_log", "divergence_log")])


part("fused", "modes_h retr", f"""
  select r.*, reference, native + 0.1 * (reference - native) as yhat from retr r join (
    select {WKEY}, h, sum(w_select * future) as reference from modes_h group by {WKEY}, h)
  using ({WKEY}, h)""")


@memo
def fused(spark, sf):
    return stage(fuse.fusion(retrieved(spark, sf), H))


@query("gated_fusion", sql("fused", f"""
  select {WKEY}, h, round(reference + 1.3e-9, 6) + 0.0 as reference, round(yhat + 1.3e-9, 6) + 0.0 as yhat
  from fused"""))
def gated_fusion(spark, sf):
    return by_step(fused(spark, sf), [*KEYS, "w"], reference="reference", yhat="yhat")


@query("forecast_blend", sql("retr", f"""
  select {WKEY}, h, amount, round(native + amount * (analog - native) + 1.3e-9, 6) + 0.0 as yhat
  from retr, (select unnest([0.0, 0.25, 0.5, 0.75, 1.0])::double as amount)"""))
def forecast_blend(spark, sf):
    amounts = F.explode(F.array(*[F.lit(a) for a in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("amount")
    r = retrieved(spark, sf).select(*KEYS, "w", "native", "analog", amounts)
    mixed = r.withColumn("yhat", fuse.blend("native", "analog", F.col("amount")))
    return by_step(mixed, [*KEYS, "w", "amount"], yhat="yhat")


HUBER = "case when abs({e}) <= 1 then 0.5 * ({e}) ** 2 else abs({e}) - 0.5 end"
part("errors", "modes_h fused", f"""
  select f.{WKEY.replace(', ', ', f.')}, b.best, f.bypass, f.full_open from (
    select {WKEY}, avg({HUBER.format(e='native - y')}) as bypass,
           avg({HUBER.format(e='reference - y')}) as full_open from fused group by {WKEY}) f
  join (select {WKEY}, min(e) as best from (
          select {WKEY}, rank, avg({HUBER.format(e='future - y')}) as e from modes_h
          group by {WKEY}, rank) group by {WKEY}) b using ({WKEY})""")
SOFT = "1 / (1 + exp(-(least(greatest((bypass - {o}) / greatest(bypass + {o}, 1e-6), -1), 1) - 0.1) / 0.05))"


@query("reference_quality", sql("errors", f"""
  select {WKEY}, round({SOFT.format(o='best')} + 1.3e-9, 6) + 0.0 as quality from errors"""))
def reference_quality(spark, sf):
    t = fuse.quality_targets(fused(spark, sf))
    return t.select(*KEYS, "w", rounded("reference_quality").alias("quality"))


@query("gate_target", sql("errors", f"""
  select {WKEY}, round({SOFT.format(o='full_open')} + 1.3e-9, 6) + 0.0 as target from errors"""))
def gate_target(spark, sf):
    t = fuse.quality_targets(fused(spark, sf))
    return t.select(*KEYS, "w", rounded("gate_target").alias("target"))


@query("gate_soft_fit")
def gate_soft_fit(spark, sf):
    t = fuse.gate_features(fuse.quality_targets(fused(spark, sf).where("role = 'normal'")))
    return fuse.fit_logistic(t, fuse.GATE_FEATURES, "gate_target", balanced=False)


@query("forecast_loss", sql("fused", f"""
  select entity, role, round(avg({HUBER.format(e='yhat - y')}) + 1.3e-9, 6) + 0.0 as huber,
         round(avg((yhat - y) ** 2) + 1.3e-9, 6) + 0.0 as mse, count(*)::bigint as n,
         round(avg(0.1::double) + 1.3e-9, 6) + 0.0 as gate_mean
  from fused group by 1, 2"""))
def forecast_loss(spark, sf):
    f = fused(spark, sf)
    keys = ["entity", "role"]
    huber = fuse.forecast_loss(f, keys).withColumnRenamed("loss", "huber")
    mse = fuse.forecast_loss(f, keys, "mse").select(*keys, F.col("loss").alias("mse"))
    gate = f.groupBy(*keys).agg(F.avg("gate").alias("gate_mean"))
    j = huber.join(mse, keys).join(gate, keys)
    return j.select(*keys, rounded("huber").alias("huber"), rounded("mse").alias("mse"), "n",
                    rounded("gate_mean").alias("gate_mean"))


@query("naive_forecast", sql("feats", f"""
  select {WKEY}, h, round(last + 1.3e-9, 6) + 0.0 as yhat, round(fut[h + 1] + 1.3e-9, 6) + 0.0 as y
  from feats, (select unnest(range({H}))::int as h)"""))
def naive_forecast(spark, sf):
    w = windows.scan(blocked(spark, sf), L, H).withColumn("yhat", forecast.naive(H))
    return by_step(w, [*KEYS, "w"], yhat="yhat", y="y")


@query("linear_forecaster")
def linear_forecaster(spark, sf):
    base = blocked(spark, sf).where("role = 'base'")
    model = forecast.linear_forecaster(base, L, H)
    seen = windows.scan(blocked(spark, sf), L, H, model=model)
    both = seen.select(*KEYS, "y", "yhat", forecast.naive(H).alias("native"))
    keys = ["entity", "role"]
    linear = fuse.mae(both, keys).withColumnRenamed("mae", "linear_mae")
    naive = fuse.mae(both, keys, "native").select(*keys, F.col("mae").alias("naive_mae"))
    return linear.join(naive, keys)


def drift(x):
    """A user model: last value plus the mean slope of the context."""
    import numpy as np
    slope = (x[:, -1] - x[:, 0]) / (x.shape[1] - 1)
    return x[:, -1:] + slope[:, None] * np.arange(1, H + 1)


part("drift", "feats", f"""
  select {WKEY}, h, last + (last - ctx[1]) / {L - 1}::double * (h + 1) as yhat
  from feats, (select unnest(range({H}))::int as h)""")


@query("predict_batch", sql("drift", f"""
  select {WKEY}, h, round(yhat + 1.3e-9, 6) + 0.0 as yhat from drift"""))
def predict_batch(spark, sf):
    return by_step(windows.scan(blocked(spark, sf), L, H, forecast=drift), [*KEYS, "w"],
                   yhat="yhat")


@query("compare_methods")
def compare_methods(spark, sf):
    return compare.compare(fx.series_hourly(spark, sf), fx.labels_hourly(spark, sf), settings())
