"""End to end: raw series and labels to point scores on held-out time."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_analog.defaults import (
    AGREEMENT_GRID, INITIAL_GATE, MEMORY_GRID, MEMORY_TEMPERATURE, SMOOTHING_GRID, TOP_Q_GRID,
)
from spark_analog.operators import (
    clean, forecast, fuse, grid_search, group_blocks, memory, retrieve, scale, score, windows,
)
from spark_analog.operators.staging import attach, stage
from spark_analog.plans.guards import guards, require


@dataclass(frozen=True)
class Settings:
    context: int = 192
    horizon: int = 8
    train_stop: int = 0          # unless the series carries a ``train_stop`` column
    size: int = 256
    k: int = 5
    selection: str = "boundary"
    memory_source: str = "base_memory"
    temperature: float = MEMORY_TEMPERATURE
    label_block: int = 1000
    label_fraction: float = 0.2
    stride: int = 1
    block: int = windows.BLOCK
    fusion_mode: str = "select"
    gamma: float = INITIAL_GATE
    learn_gate: bool = False
    mode: str = "channel"
    zero_distance: bool = False
    zero_divergence: bool = False
    score_selection: str = "aggregate"
    axes: dict = field(default_factory=lambda: dict(
        top_q=TOP_Q_GRID, memory=MEMORY_GRID, agreement=AGREEMENT_GRID,
        smoothing=SMOOTHING_GRID))


def train_stop(df: DataFrame, s: Settings) -> Column:
    return F.col("train_stop") if "train_stop" in df.columns else F.lit(s.train_stop)


def longest_training(series: DataFrame, s: Settings) -> int:
    """Bound on the training steps of a series, for choosing plans."""
    if "train_stop" in series.columns:
        return int(series.agg(F.max("train_stop")).first()[0] or 0)
    return s.train_stop


def check(series: DataFrame, labels: DataFrame, s: Settings) -> None:
    """Raise for entities that some step would lose or score without a basis."""
    require(guards(series, labels, train_stop(series, s), s.context, s.horizon, s.label_block,
                   s.label_fraction))


def prepare(series: DataFrame, s: Settings) -> DataFrame:
    """Fill, scale, assign roles and block: one row per (entity, role, segment, channel, block).

    Series that are measured to fit a task pass through all of it there."""
    if "train_stop" not in series.columns:
        lengths = stage(scale.lengths(series))
        if (lengths.agg(F.max("n")).first()[0] or 0) <= memory.GROUP_ROWS:
            return stage(group_blocks.prepared_blocks(series, lengths, s.train_stop, s.context, s.horizon, s.label_block,
                                                      s.label_fraction, s.memory_source, s.block))
    stop, most = train_stop(series, s), longest_training(series, s)
    train = F.col("t") < stop
    half = F.when(train, "train").otherwise("test")
    medians = clean.channel_medians(series.where(train), most=most)
    filled = stage(clean.causal_fill(series.withColumn("half", half), medians,
                                     restart=["half"]).drop("half"))
    fitted = scale.robust_fit(filled.where(train), most=most)
    scaled = scale.robust_transform(filled, fitted)
    roles = scale.roles(scaled, stop.cast("bigint"), s.context, s.horizon, s.label_block,
                        s.label_fraction, s.memory_source, scale.lengths(filled))
    return stage(windows.blocks(roles, s.context, s.horizon, block=s.block))


def build_memory(blocked: DataFrame, s: Settings, role: str = "memory", size: int | None = None,
                 selection: str | None = None) -> DataFrame:
    """Packed bank per entity and channel."""
    return memory.packed_block_bank(
        blocked.where(F.col("role") == role), s.context, s.horizon, size or s.size,
        selection or s.selection, most=s.train_stop or None)


def forecast_windows(blocked: DataFrame, s: Settings, bank: DataFrame | None,
                     model: DataFrame | None, roles=("normal", "score", "test")) -> DataFrame:
    """Windows of the given roles with ``native`` forecast and retrieval summary."""
    rows = blocked.where(F.col("role").isin(*roles))
    seen = windows.scan(rows, s.context, s.horizon, stride=steps_apart(s), bank=bank, k=s.k, model=model)
    if model is None:
        seen = seen.withColumn("yhat", forecast.naive(s.horizon))
    seen = seen.withColumnRenamed("yhat", "native")
    if bank is None:
        return seen
    return retrieve.summarise(seen, s.horizon, s.temperature)


def fused_windows(blocked: DataFrame, s: Settings, bank: DataFrame, model: DataFrame | None,
                  roles=("normal", "score", "test")) -> DataFrame:
    """``fuse.fusion`` of ``forecast_windows`` in one pass; candidates stay in the task that finds them."""
    rows = blocked.where(F.col("role").isin(*roles))
    seen = windows.scan(rows, s.context, s.horizon, stride=steps_apart(s), bank=bank, k=s.k, model=model,
                        then=fuse.fused_signals(s.horizon, s.gamma, s.fusion_mode, s.k, s.temperature))
    return seen.withColumnRenamed("yhat", "native").withColumnRenamed("fused", "yhat")


def steps_apart(s: Settings) -> int | Column:
    """Test windows every ``stride`` steps of their segment, and its last one; all others stay."""
    return 1 if s.stride == 1 else F.when(F.col("role") == "test", F.lit(s.stride)).otherwise(F.lit(1))


def global_windows(blocked: DataFrame, s: Settings, model: DataFrame | None,
                   roles=("normal", "score", "test")) -> DataFrame:
    """As ``forecast_windows`` with one neighbour set for all channels of an entity."""
    feats = windows.scan(blocked.where("role = 'memory'"), s.context, s.horizon, features=True)
    bank, scales = memory.build_global_bank(feats, s.size, s.selection, most=s.train_stop or None)
    seen = windows.scan_joint(blocked.where(F.col("role").isin(*roles)), s.context, s.horizon,
                              memory.pack_bank(bank, scales), s.k, stride=steps_apart(s), model=model)
    native = F.col("yhat") if model is not None else forecast.naive(s.horizon)
    return retrieve.summarise(seen.withColumn("native", native), s.horizon, s.temperature)


def scored_parts(frame: DataFrame, use_retrieval: bool, keys=("entity", "channel"),
                 group=("entity", "role", "segment", "channel"), use_agreement: bool = True,
                 most: int | None = None) -> DataFrame:
    """Point components of validation and test windows; every fit reads normal windows only."""
    normal = frame.where("role = 'normal'")
    stats = score.mad_stats(score.residual_steps(normal, [*group, "w"]), keys, most=most)
    rest = frame.where("role in ('score', 'test')")
    return stage(score.point_components(rest, normal if use_retrieval else None, stats, keys, group, use_agreement, most))


def choose_and_apply(parts: DataFrame, labels: DataFrame, s: Settings, use_retrieval: bool,
                     use_agreement: bool = True, keys=("entity",), extra=()
                     ) -> tuple[DataFrame, DataFrame]:
    """(test scores with labels, selected parameters) per key."""
    axes = dict(s.axes)
    if not use_retrieval:
        axes["memory"] = (0.0,)
    if not (use_retrieval and use_agreement):
        axes["agreement"] = (0.0,)
    group = ["entity", *extra, "role", "segment", "t"]
    marks = labels.select("entity", "t", "label")
    scored = grid_search.grid_objectives(parts.where("role = 'score'"), marks, keys, group,
                                         selection=s.score_selection, **axes)
    params = stage(score.select_parameters(scored, keys, use_retrieval, **axes))
    points = score.apply_parameters(parts.where("role = 'test'"), params, keys, group,
                                    axes["smoothing"])
    return points, params


def label_points(points: DataFrame, labels: DataFrame, s: Settings, extra=(),
                 each: dict[str, list] | None = None) -> DataFrame:
    """Every labelled held-out point, also the uncovered ones (NULL score).

    ``each`` names the values of the ``extra`` columns: every point appears once
    for each, covered or not."""
    every = scale.roles(labels, train_stop(labels, s).cast("bigint"), s.context, s.horizon,
                        s.label_block,
                        s.label_fraction).where("role = 'test'")
    keys = ["entity", "segment", "t"]
    for name, values in (each or {}).items():
        every = every.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
        keys = [*keys, name]
    rest = [c for c in extra if c not in keys]
    return every.select(*keys, "label").join(
        points.select(*keys, *rest, "score"), keys, "left")


def detect(series: DataFrame, labels: DataFrame, s: Settings, condition: str = "retrieval"
           ) -> DataFrame:
    """``(entity, segment, t, score, label)`` on the held-out test blocks.

    ``condition``: ``native`` (base forecast only) or ``retrieval`` (fusion plus
    memory distance and agreement).  Score parameters are selected per entity
    on its labelled validation blocks.  Entities that can't be served raise.
    """
    use = condition == "retrieval"
    series, labels = stage(series), stage(labels)  # the guards and later steps read both
    check(series, labels, s)
    blocked = prepare(series, s)
    model = forecast.linear_forecaster(blocked.where("role = 'base'"), s.context, s.horizon)
    frame = forecast_frame(blocked, s, model, use)
    parts = scored_parts(frame, use, most=s.train_stop * s.horizon or None)
    points, _ = choose_and_apply(parts, labels, s, use)
    return label_points(points, labels, s)


def learned_fusion(seen: DataFrame, s: Settings) -> DataFrame:
    """Fusion whose gate is learned per entity from soft targets on adaptation windows."""
    open_ = fuse.fusion(seen.where("role = 'adapt'"), s.horizon, 1.0, mode=s.fusion_mode, k=s.k)
    gate = fuse.fit_logistic(fuse.gate_features(fuse.quality_targets(open_)),
                             fuse.GATE_FEATURES, "gate_target", balanced=False)
    ready = attach(fuse.gate_features(seen.where("role <> 'adapt'")), gate, ["entity"])
    gamma = fuse.gate_probability(fuse.GATE_FEATURES)
    return fuse.fusion(ready.withColumn("gamma", gamma), s.horizon, F.col("gamma"),
                       mode=s.fusion_mode, k=s.k)


def forecast_frame(blocked: DataFrame, s: Settings, model: DataFrame | None, use: bool
                   ) -> DataFrame:
    """Fused (or native) forecasts, staged: ``yhat`` next to the retrieval signals."""
    if not use:
        return stage(forecast_windows(blocked, s, None, model).withColumn(
            "yhat", F.col("native")))
    roles = ("normal", "score", "test") + (("adapt",) if s.learn_gate else ())
    if s.learn_gate or s.mode == "global":
        seen = (global_windows(blocked, s, model, roles) if s.mode == "global"
                else forecast_windows(blocked, s, build_memory(blocked, s), model, roles))
        fused = (learned_fusion(stage(seen), s) if s.learn_gate
                 else fuse.fusion(seen, s.horizon, s.gamma, mode=s.fusion_mode, k=s.k))
    else:
        fused = fused_windows(blocked, s, build_memory(blocked, s), model, roles)
    if s.zero_distance:
        fused = fused.withColumn("nearest", F.lit(0.0))
    if s.zero_divergence:
        fused = fused.withColumn("divergence", F.transform("divergence", lambda d: d * 0))
    return stage(fused.select("entity", "role", "segment", "channel", "w", "y", "yhat", "native",
                              "nearest", "divergence", "gate"))
