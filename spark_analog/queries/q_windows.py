"""Windows, features, memory and retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from spark_analog.functions.columns import array_sum, rounded
from spark_analog.operators import memory, retrieve, scale, windows
from spark_analog.operators.staging import stage
from spark_analog.plans import detect as plan
from spark_analog.queries import fixtures as fx
from spark_analog.queries.q_clean import filled, scaler
from spark_analog.queries.q_detect import settings
from spark_analog.queries.registry import memo, part, query, sql, table

L, H, M, K = fx.L, fx.H, fx.M, fx.K
KEYS = list(windows.KEYS)
TRAIN = fx.TRAIN
QUERY_ROLES = ("normal", "score", "test")

# --- the same chain in SQL -----------------------------------------------------------------
part("steps", "scaled", f"""
  select entity, 'base' as role, 0 as segment, t, channel, value, 0 as start from scaled
  where t < 285
  union all select entity, 'base_val', 0, t, channel, value, 285 from scaled
  where t >= 285 and t < 336
  union all select entity, 'memory', 0, t, channel, value, 0 from scaled where t < 384
  union all select entity, 'adapt', 0, t, channel, value, 384 from scaled
  where t >= 384 and t < 432
  union all select entity, 'normal', 0, t, channel, value, 432 from scaled
  where t >= 432 and t < {TRAIN}
  union all select entity, case when (t - {TRAIN}) // {fx.BLOCK} % 5 = 0 then 'score' else 'test' end,
    (t - {TRAIN}) // {fx.BLOCK}, t, channel, value,
    {TRAIN} + (t - {TRAIN}) // {fx.BLOCK} * {fx.BLOCK} from scaled where t >= {TRAIN}""")
part("win", "steps", f"""
  select * from (
    select entity, role, segment::bigint as segment, channel, t as w, t - start as s,
      list(value) over (partition by entity, role, segment, channel order by t
        rows between {L} preceding and 1 preceding) as ctx,
      list(value) over (partition by entity, role, segment, channel order by t
        rows between current row and {H - 1} following) as fut from steps)
  where len(ctx) = {L} and len(fut) = {H}""")
FEAT = f"""list_concat([list_avg(ctx), list_aggregate(ctx, 'stddev_pop'), ctx[{L}],
    list_sum(list_transform(range({L}), lambda i: ctx[i + 1] * (-1 + 2 * i / {L - 1}::double)))
      / {sum((-1 + 2 * i / (L - 1)) ** 2 for i in range(L))!r}::double,
    list_sum(list_transform(range(1, {L}), lambda i: (ctx[i + 1] - ctx[i]) ** 2))
      / {L - 1}::double],
  list_transform(range(16), lambda i:
    (ctx[floor(i * {L - 1} / 15::double)::int + 1]
        * (1 - (i * {L - 1} / 15::double - floor(i * {L - 1} / 15::double)))
     + ctx[ceil(i * {L - 1} / 15::double)::int + 1]
        * (i * {L - 1} / 15::double - floor(i * {L - 1} / 15::double))
     - list_avg(ctx)) / greatest(list_aggregate(ctx, 'stddev_pop'), 1e-6)))"""
part("feats", "win", f"select *, {FEAT} as feat, ctx[{L}] as last from win")
part("fscale", "feats", """
  select entity, channel, dim, center,
         case when q3 - q1 < 1e-6 then 1.0 else q3 - q1 end::double as scale from (
    select entity, channel, dim, quantile_cont(v, 0.5) as center, quantile_cont(v, 0.25) as q1,
           quantile_cont(v, 0.75) as q3
    from (select entity, channel, unnest(range(21)) as dim, unnest(feat) as v from feats
          where role = 'memory') group by 1, 2, 3)""")
part("fscale_p", "fscale", """
  select entity, channel, list(center order by dim) as center, list(scale order by dim) as scale
  from fscale group by 1, 2""")
part("scaled_feats", "feats fscale_p", """
  select f.* exclude (feat), list_transform(range(21), lambda i:
      (feat[i + 1] - center[i + 1]) / scale[i + 1]) as feat
  from feats f join fscale_p using (entity, channel)""")
part("bank", "scaled_feats", f"""
  select entity, channel, row_number() over (partition by entity, channel order by w)::int as slot,
         w as src_w, feat, list_transform(fut, lambda x: x - last) as delta from (
    select *, row_number() over (partition by entity, channel order by w) - 1 as pos,
           count(*) over (partition by entity, channel) as n
    from scaled_feats where role = 'memory')
  where n <= {M} or pos in (select floor((i + 0.5::double) * n / {M})::bigint
                            from range({M}) r(i))""")
part("knn", "scaled_feats bank", f"""
  select * from (
    select *, row_number() over (partition by entity, role, segment, channel, w
                                 order by distance, src_w)::int as rank from (
      select q.entity, q.role, q.segment, q.channel, q.w, q.last, q.fut, b.src_w, b.delta,
             round(list_distance(q.feat, b.feat) / sqrt(21), 9) as distance
      from scaled_feats q join bank b using (entity, channel)
      where q.role in ('normal', 'score', 'test')))
  where rank <= {K}""")
part("cand", "knn", f"""
  select k.*, exp(-(distance - dmin) / 0.15) / sum(exp(-(distance - dmin) / 0.15)) over (
           partition by entity, role, segment, channel, w) as weight from (
    select *, min(distance) over (partition by entity, role, segment, channel, w) as dmin
    from knn) k""")
part("cand_h", "cand", f"""
  select *, last + delta[h + 1] as future, fut[h + 1] as y
  from cand, (select unnest(range({H}))::int as h)""")
part("analog", "cand_h", """
  select entity, role, segment, channel, w, h, any_value(last) as native, any_value(y) as y,
         sum(weight * future) as analog, sum(weight * distance) as distance,
         min(distance) as nearest
  from cand_h group by 1, 2, 3, 4, 5, 6""")
part("retr", "cand_h analog", """
  select a.*, round(d.divergence, 9) as divergence from analog a join (
    select c.entity, c.role, c.segment, c.channel, c.w, c.h,
           sqrt(greatest(sum(c.weight * (c.future - a.analog) ** 2), 0)) as divergence
    from cand_h c join analog a using (entity, role, segment, channel, w, h)
    group by 1, 2, 3, 4, 5, 6) d using (entity, role, segment, channel, w, h)""")


# --- staged frames every query below starts from ------------------------------------------------
@memo
def blocked(spark, sf):
    return plan.prepare(fx.series_hourly(spark, sf), settings())


@memo
def featured(spark, sf):
    return stage(windows.scan(blocked(spark, sf), L, H, features=True, contexts=True))


def role_windows(spark, sf, role):
    """As ``featured``, of one role."""
    return windows.scan(blocked(spark, sf).where(F.col("role") == role), L, H, features=True, contexts=True)


@memo
def memory_windows(spark, sf):
    return stage(role_windows(spark, sf, "memory"))


@memo
def uniform_bank(spark, sf):
    bank, scales = memory.build_bank(memory_windows(spark, sf), M, "uniform", most=TRAIN)
    return stage(bank), scales


@memo
def retrieved(spark, sf):
    bank, scales = uniform_bank(spark, sf)
    rows = blocked(spark, sf).where(F.col("role").isin(*QUERY_ROLES))
    seen = windows.scan(rows, L, H, bank=memory.pack_bank(bank, scales), k=K)
    full = retrieve.summarise(seen, H)
    return stage(full.withColumn("native", retrieve.flat("last", H)))


def by_step(df, keys, **arrays):
    """Arrays to rows ``(keys, h, value columns)``."""
    z = F.arrays_zip(*[F.col(a).alias(n) for n, a in arrays.items()])
    return df.select(*keys, F.posexplode(z).alias("h", "z")).select(
        *keys, "h", *[rounded(F.col("z")[n]).alias(n) for n in arrays])


WINDOW_COLUMNS = """entity, role, segment, channel, w, round(ctx[1] + 1.3e-9, 6) + 0.0 as ctx_first,
  round(ctx[24] + 1.3e-9, 6) + 0.0 as ctx_last, round(list_sum(ctx) + 1.3e-9, 6) + 0.0 as ctx_sum,
  round(list_sum(fut) + 1.3e-9, 6) + 0.0 as fut_sum"""


def window_columns(df):
    return df.select(*KEYS, "w", rounded(F.col("ctx")[0]).alias("ctx_first"),
                     rounded(F.element_at("ctx", -1)).alias("ctx_last"),
                     rounded(array_sum("ctx")).alias("ctx_sum"),
                     rounded(array_sum("fut")).alias("fut_sum"))


@query("windows", sql("win", f"select {WINDOW_COLUMNS} from win"))
def all_windows(spark, sf):
    return window_columns(windows.windows(blocked(spark, sf), L, H))


@query("windows_stride", sql("win", f"""
  , last_s as (select entity, role, segment, channel, max(s) as e from win group by 1, 2, 3, 4)
  select {WINDOW_COLUMNS} from win join last_s using (entity, role, segment, channel)
  where (s - {L}) % 5 = 0 or s = e"""))
def windows_stride(spark, sf):
    return window_columns(windows.windows(blocked(spark, sf), L, H, stride=5))


@query("windows_capped")
def windows_capped(spark, sf):
    return window_columns(windows.windows(blocked(spark, sf), L, H, cap=10, seed=7))


@query("windows_segmented", sql("win", """
  select entity, role, segment, channel, count(*)::bigint as n, min(w)::bigint as first_w,
         max(w)::bigint as last_w
  from win where role in ('score', 'test') group by 1, 2, 3, 4"""))
def windows_segmented(spark, sf):
    rows = blocked(spark, sf).where("role in ('score', 'test')")
    return windows.windows(rows, L, H).groupBy(*KEYS).agg(
        F.count("*").alias("n"), F.min("w").alias("first_w"), F.max("w").alias("last_w"))


@query("window_finite", sql("series", f"""
  select entity, channel, w, len(list_filter(ctx, lambda x: x is not null)) = {L} as finite from (
    select entity, channel, t as w, list(value) over (partition by entity, channel order by t
      rows between {L} preceding and 1 preceding) as ctx,
      count(*) over (partition by entity, channel order by t
        rows between current row and {H - 1} following) as ahead from series)
  where len(ctx) = {L} and ahead = {H}"""))
def window_finite(spark, sf):
    series = fx.series_hourly(spark, sf).withColumn("start", F.lit(0).cast("bigint")).withColumn(
        "length", F.lit(fx.hours(spark, sf)).cast("bigint"))
    keys = ["entity", "channel"]
    raw = windows.windows(windows.blocks(series, L, H, keys), L, H, keys=keys)
    return raw.select("entity", "channel", "w", windows.is_finite("ctx").alias("finite"))


@query("feat_stats", sql("feats", """
  select entity, role, segment, channel, w, round(feat[1] + 1.3e-9, 6) + 0.0 as mean,
         round(feat[2] + 1.3e-9, 6) + 0.0 as std, round(feat[3] + 1.3e-9, 6) + 0.0 as last from feats"""))
def feat_stats(spark, sf):
    return featured(spark, sf).select(*KEYS, "w", *[
        rounded(F.col("feat")[i]).alias(n) for i, n in enumerate(["mean", "std", "last"])])


@query("feat_slope", sql("feats", """
  select entity, role, segment, channel, w, round(feat[4] + 1.3e-9, 7) + 0.0 as slope from feats"""))
def feat_slope(spark, sf):
    return featured(spark, sf).select(*KEYS, "w", rounded(F.col("feat")[3], 7).alias("slope"))


@query("feat_diff_energy", sql("feats", """
  select entity, role, segment, channel, w, round(feat[5] + 1.3e-9, 6) + 0.0 as energy from feats"""))
def feat_diff_energy(spark, sf):
    return featured(spark, sf).select(*KEYS, "w", rounded(F.col("feat")[4]).alias("energy"))


@query("feat_waveform", sql("feats", """
  select entity, role, segment, channel, w, p::int as p, round(feat[p + 6] + 1.3e-9, 6) + 0.0 as z
  from feats, (select unnest(range(16)) as p)"""))
def feat_waveform(spark, sf):
    wave = F.posexplode(F.slice("feat", 6, 16)).alias("p", "z")
    return featured(spark, sf).select(*KEYS, "w", wave).withColumn("z", rounded("z"))


@query("features", sql("feats", """
  select entity, role, segment, channel, w, dim::int as dim, round(feat[dim + 1] + 1.3e-9, 6) + 0.0 as v
  from feats, (select unnest(range(21)) as dim)"""))
def features(spark, sf):
    rows = windows.scan(blocked(spark, sf), L, H, features=True)
    flat = rows.select(*KEYS, "w", F.posexplode("feat").alias("dim", "v"))
    return flat.withColumn("v", rounded("v"))


@query("feat_scale", sql("fscale", """
  select entity, channel, dim::int as dim, round(center + 1.3e-9, 6) + 0.0 as center,
         round(scale + 1.3e-9, 6) + 0.0 as scale from fscale"""))
def feat_scale(spark, sf):
    return memory.feature_scale(memory_windows(spark, sf), most=TRAIN).select(
        "entity", "channel", "dim", rounded("center").alias("center"),
        rounded("scale").alias("scale"))


@query("instance_norm", sql("win", f"""
  , n as (select *, list_avg(ctx) as mean,
                 sqrt(list_aggregate(ctx, 'var_pop') + 1e-5) as spread from win)
  select entity, role, segment, channel, w, round(mean + 1.3e-9, 6) + 0.0 as mean,
         round(spread + 1.3e-9, 6) + 0.0 as spread, round((ctx[1] - mean) / spread + 1.3e-9, 6) + 0.0 as z_first,
         round((ctx[{L}] - mean) / spread + 1.3e-9, 6) + 0.0 as z_last from n"""))
def instance_norm(spark, sf):
    raw = windows.windows(blocked(spark, sf), L, H)
    z, mean, spread = windows.instance_normalise("ctx")
    return raw.select(*KEYS, "w", rounded(mean).alias("mean"), rounded(spread).alias("spread"),
                      rounded(z[0]).alias("z_first"), rounded(F.element_at(z, -1)).alias("z_last"))


# --- memory -----------------------------------------------------------------------------------
@query("memory_eligible", sql("win labels_h", f"""
  select entity, channel, w from win m where role = 'memory' and not exists (
    select 1 from labels_h l where l.entity = m.entity and l.label > 0
      and l.t between m.w - {L} and m.w + {H - 1})"""))
def memory_eligible(spark, sf):
    rows = memory_windows(spark, sf)
    good = memory.unspoiled(rows, fx.labels_hourly(spark, sf), L, H)
    return memory.eligible(rows, good).select("entity", "channel", "w")


@query("memory_uniform", sql("bank", "select entity, channel, slot, src_w from bank"))
def memory_uniform(spark, sf):
    return uniform_bank(spark, sf)[0].select("entity", "channel", "slot", "src_w")


def chosen(spark, sf, selection, size=M, role="memory"):
    rows = role_windows(spark, sf, role)
    bank, _ = memory.build_bank(rows, size, selection, most=TRAIN)
    return bank


@query("memory_farthest")
def memory_farthest(spark, sf):
    return chosen(spark, sf, "farthest").select("entity", "channel", "slot", "src_w")


@query("memory_boundary")
def memory_boundary(spark, sf):
    return chosen(spark, sf, "boundary").select("entity", "channel", "slot", "src_w")


@query("future_delta", sql("feats", f"""
  select entity, role, segment, channel, w, h, round(fut[h + 1] - last + 1.3e-9, 6) + 0.0 as delta
  from feats, (select unnest(range({H}))::int as h)"""))
def future_delta(spark, sf):
    return by_step(memory.with_delta(featured(spark, sf)), [*KEYS, "w"], delta="delta")


@query("bank_channel")
def bank_channel(spark, sf):
    return chosen(spark, sf, "boundary")


@query("bank_global")
def bank_global(spark, sf):
    return memory.build_global_bank(memory_windows(spark, sf), M, "boundary", most=TRAIN)[0]


@query("bank_prototype")
def bank_prototype(spark, sf):
    return chosen(spark, sf, "farthest", min(64, M), "base")


@query("bank_footprint", sql("bank", f"""
  select entity, (count(*) * (21 * 4 + {H} * 4 + 8)
                  + count(distinct channel) * (2 * 21 * 4 + 8))::bigint as bytes
  from bank group by 1"""))
def bank_footprint(spark, sf):
    return memory.footprint(*uniform_bank(spark, sf))


@query("bank_contexts", sql("bank win", """
  select b.entity, b.channel, b.slot, b.src_w, round(list_sum(ctx) + 1.3e-9, 6) + 0.0 as ctx_sum,
         round(list_sum(fut) + 1.3e-9, 6) + 0.0 as fut_sum
  from bank b join win on win.entity = b.entity and win.channel = b.channel
       and win.w = b.src_w and win.role = 'memory'"""))
def bank_contexts(spark, sf):
    bank, _ = uniform_bank(spark, sf)
    rows = memory.bank_contexts(bank, memory_windows(spark, sf))
    return rows.select("entity", "channel", "slot", "src_w",
                       rounded(array_sum("ctx")).alias("ctx_sum"),
                       rounded(array_sum("future")).alias("fut_sum"))


# --- retrieval ----------------------------------------------------------------------------------
@query("knn_channel", sql("knn", """
  select entity, role, segment, channel, w, rank, src_w, round(distance + 1.3e-9, 6) + 0.0 as distance
  from knn"""))
def knn_channel(spark, sf):
    return retrieve.explode_candidates(retrieved(spark, sf), [*KEYS, "w"]).select(
        *KEYS, "w", "rank", "src_w", rounded("distance").alias("distance"))


part("vec_bank", "", """
  select label, vec_id, embedding from (
    select *, row_number() over (partition by label order by vec_id) - 1 as pos,
           count(*) over (partition by label) as n from embeddings)
  where n <= 64 or pos in (select floor((i + 0.5::double) * n / 64)::bigint from range(64) r(i))""")


def vec_sql(condition="true"):
    return sql("vec_bank", f"""
  , d as (select q.label, q.vec_id as qid, b.vec_id as src_w,
                 round(list_distance(q.embedding::double[], b.embedding::double[])
                       / sqrt(len(q.embedding)), 9) as distance
          from embeddings q join vec_bank b using (label) where {condition}),
  r as (select *, row_number() over (partition by label, qid
                                     order by distance, src_w)::int as rank from d)
  select label, qid, rank, src_w, round(distance + 1.3e-9, 6) + 0.0 as distance from r where rank <= 5""")


def vector_knn(spark, sf, radius=None):
    v = fx.vectors(spark, sf).withColumn("w", F.col("vec_id"))
    bank = memory.select_uniform(v.select("label", "w", "feat"), 64, ["label"])
    n = F.size(F.element_at("__b", 1)["feat"])
    packed = stage(bank.groupBy("label").agg(F.sort_array(F.collect_list(
        F.struct("w", "feat"))).alias("__b")).select(
        "label", F.col("__b.w").alias("bank_w"), F.flatten("__b.feat").alias("bank_feat"),
        F.array_repeat(F.lit(0.0), n).alias("center"), F.array_repeat(F.lit(1.0), n).alias("scale")))
    found = retrieve.knn(v.withColumnRenamed("vec_id", "qid"), packed, 5, ["label"], radius)
    return found.select("label", "qid", "rank", "src_w", rounded("distance").alias("distance"))


@query("knn_global", vec_sql())
def knn_global(spark, sf):
    return vector_knn(spark, sf)


@query("knn_global_channels", sql("scaled_feats bank", f"""
  , d as (select q.entity, q.role, q.segment, q.w, b.src_w,
                 round(sqrt(sum(list_distance(q.feat, b.feat) ** 2) / (21 * count(*))), 9) as distance
          from scaled_feats q join bank b using (entity, channel)
          where q.role in ('normal', 'score', 'test') group by 1, 2, 3, 4, 5),
  r as (select *, row_number() over (partition by entity, role, segment, w
                                     order by distance, src_w)::int as rank from d)
  select entity, role, segment, channel, w, rank, src_w, round(distance + 1.3e-9, 6) + 0.0 as distance
  from r join (select distinct entity, channel from bank) using (entity) where rank <= {K}"""))
def knn_global_channels(spark, sf):
    bank, scales = memory.build_global_bank(memory_windows(spark, sf), M, "uniform", most=TRAIN)
    rows = blocked(spark, sf).where(F.col("role").isin(*QUERY_ROLES))
    seen = windows.scan_joint(rows, L, H, memory.pack_bank(bank, scales), K)
    return retrieve.explode_candidates(seen, [*KEYS, "w"]).select(
        *KEYS, "w", "rank", "src_w", rounded("distance").alias("distance"))


@query("knn_exclusion", vec_sql("abs(q.vec_id - b.vec_id) > 12"))
def knn_exclusion(spark, sf):
    return vector_knn(spark, sf, 12)


@query("knn_weights", sql("cand", """
  select entity, role, segment, channel, w, rank, round(weight + 1.3e-9, 6) + 0.0 as weight from cand"""))
def knn_weights(spark, sf):
    z = F.posexplode("weights").alias("p", "weight")
    return retrieved(spark, sf).select(*KEYS, "w", z).select(
        *KEYS, "w", (F.col("p") + 1).alias("rank"), rounded("weight").alias("weight"))


@query("level_align", sql("cand_h", """
  select entity, role, segment, channel, w, rank, h, round(future + 1.3e-9, 6) + 0.0 as future
  from cand_h"""))
def level_align(spark, sf):
    rows = retrieve.explode_candidates(retrieved(spark, sf), [*KEYS, "w"])
    return by_step(rows, [*KEYS, "w", "rank"], future="future")


@query("analog", sql("analog", """
  select entity, role, segment, channel, w, h, round(analog + 1.3e-9, 6) + 0.0 as analog,
         round(distance + 1.3e-9, 6) + 0.0 as distance from analog"""))
def analog(spark, sf):
    rows = by_step(retrieved(spark, sf), [*KEYS, "w", "distance"], analog="analog")
    return rows.withColumn("distance", rounded("distance"))


@query("divergence", sql("retr", """
  select entity, role, segment, channel, w, h, round(divergence + 1.3e-9, 6) + 0.0 as divergence
  from retr"""))
def divergence(spark, sf):
    return by_step(retrieved(spark, sf), [*KEYS, "w"], divergence="divergence")


@query("nearest_distance", sql("knn", """
  select entity, role, segment, channel, w, round(min(distance) + 1.3e-9, 6) + 0.0 as nearest
  from knn group by 1, 2, 3, 4, 5"""))
def nearest_distance(spark, sf):
    return retrieved(spark, sf).select(*KEYS, "w", rounded(
        retrieve.nearest_distance()).alias("nearest"))


@query("knn_candidates", sql("knn", """
  select entity, role, segment, channel, w, count(*)::int as kept,
         string_agg(src_w::varchar, ',' order by rank) as sources,
         round(max(distance) + 1.3e-9, 6) + 0.0 as farthest
  from knn group by 1, 2, 3, 4, 5"""))
def knn_candidates(spark, sf):
    src = F.transform("candidates", lambda c: c["src_w"].cast("string"))
    return retrieved(spark, sf).select(
        *KEYS, "w", F.size("candidates").alias("kept"), F.array_join(src, ",").alias("sources"),
        rounded(F.array_max(retrieve.distances())).alias("farthest"))


# gaps left in: a window with a missing step is not searched
part("gap_win", "series scaler", f"""
  select * from (
    select entity, channel, t as w, list((value - center) / scale) over (
        partition by entity, channel order by t rows between {L} preceding and 1 preceding) as ctx,
      count(*) over (partition by entity, channel order by t
        rows between current row and {H - 1} following) as ahead
    from series join scaler using (entity, channel) where t >= {TRAIN})
  where len(ctx) = {L} and ahead = {H}""")
part("gap_best", "gap_win bank fscale_p", f"""
  select entity, channel, w, min(distance) as nearest from (
    select q.entity, q.channel, q.w,
           round(list_distance(list_transform(range(21), lambda i:
             (feat[i + 1] - center[i + 1]) / scale[i + 1]), b.feat) / sqrt(21), 9) as distance
    from (select *, {FEAT} as feat from gap_win
          where len(list_filter(ctx, lambda x: x is not null)) = {L}) q
    join fscale_p f on f.entity = q.entity and f.channel = q.channel
    join (select entity, channel, feat as feat from bank) b
      on b.entity = q.entity and b.channel = q.channel) group by 1, 2, 3""".replace(
    "(feat[i + 1]", "(q.feat[i + 1]"))


@memo
def gapped(spark, sf):
    """Retrieval over series whose gaps are left in."""
    s = scale.robust_transform(fx.series_hourly(spark, sf), scaler(filled(spark, sf)))
    late = s.where(f"t >= {TRAIN}").select(
        "entity", F.lit("test").alias("role"), F.lit(0).cast("bigint").alias("segment"), "channel",
        "t", "value", F.lit(TRAIN).cast("bigint").alias("start"),
        F.lit(fx.hours(spark, sf) - TRAIN).cast("bigint").alias("length"))
    packed = memory.pack_bank(*uniform_bank(spark, sf))
    seen = windows.scan(windows.blocks(late, L, H), L, H, bank=packed, k=K)
    return stage(retrieve.summarise(seen, H).withColumn("native", retrieve.flat("last", H)))


@query("knn_fallback", sql("gap_win gap_best", f"""
  select g.entity, g.channel, g.w, round(b.nearest + 1.3e-9, 6) + 0.0 as nearest,
         case when b.nearest is null then round(coalesce(g.ctx[{L}], 0) + 1.3e-9, 6) + 0.0 end as flat
  from gap_win g left join gap_best b using (entity, channel, w)"""))
def knn_fallback(spark, sf):
    g = gapped(spark, sf)
    return g.select("entity", "channel", "w", rounded("nearest").alias("nearest"),
                    F.when(F.col("nearest").isNull(), rounded(F.col("analog")[0])).alias("flat"))


@query("explain_retrieval", sql("knn bank win", """
  select k.entity, k.role, k.segment, k.channel, k.w, k.rank, k.src_w, b.slot,
         round(k.distance + 1.3e-9, 6) + 0.0 as distance,
         round(list_sum(m.ctx) + 1.3e-9, 6) + 0.0 as ctx_sum
  from knn k join bank b on b.entity = k.entity and b.channel = k.channel and b.src_w = k.src_w
       join win m on m.entity = k.entity and m.channel = k.channel and m.w = k.src_w
            and m.role = 'memory'
  where k.role = 'test'"""))
def explain_retrieval(spark, sf):
    bank, _ = uniform_bank(spark, sf)
    stored = memory.bank_contexts(bank, memory_windows(spark, sf))
    rows = retrieve.explode_candidates(retrieved(spark, sf).where("role = 'test'"), [*KEYS, "w"])
    return rows.join(stored.drop("future"), ["entity", "channel", "src_w"]).select(
        *KEYS, "w", "rank", "src_w", "slot", rounded("distance").alias("distance"),
        rounded(array_sum("ctx")).alias("ctx_sum"))
