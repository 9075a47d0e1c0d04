"""Anomaly events and where one method beats another."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.functions.columns import array_diff_mean
from spark_analog.operators.evaluate import average_precision
from spark_analog.operators.intervals import members
from spark_analog.operators.ordered import time_rank
from spark_analog.operators.staging import attach, stage

EVENT = ("entity", "segment", "event_start")
TRACE_CHUNK = 4_096


def enumerate_events(points: DataFrame, radius: int) -> DataFrame:
    """Contiguous positive runs inside a segment and the interval around them.

    ``points``: ``entity, segment, start, length, t, label``.  Among positives
    ``t - rank`` is constant along a run, so only anomalous steps are ranked.
    """
    hot = points.where("label > 0").select("entity", "segment", "start", "length", "t")
    ranked = time_rank(hot, ["entity", "segment"], "t", "__pos")
    runs = ranked.groupBy("entity", "segment", "start", "length",
                          (F.col("t") - F.col("__pos")).alias("__island")).agg(
        F.min("t").alias("event_start"), (F.max("t") + 1).alias("event_stop"))
    return runs.select(
        "entity", "segment", "event_start", "event_stop",
        F.greatest(F.col("start"), F.col("event_start") - radius).alias("interval_start"),
        F.least(F.col("start") + F.col("length"), F.col("event_stop") + radius).alias(
            "interval_stop"))


def event_effects(events: DataFrame, points: DataFrame, first: str, second: str) -> DataFrame:
    """Local AUPRC of two score columns per event and their difference.

    Intervals may overlap and meet their points in time blocks.  Events need two
    finite points and both classes.
    """
    near = stage(members(events, points.select("entity", "segment", "t", "label", first, second),
                         ["entity", "segment"], "t", "interval_start", "interval_stop"))
    totals = near.groupBy(*events.columns).agg(
        F.sum("label").alias("positive_points"), F.count("*").alias("interval_points"))
    known = stage(near.where(F.col(first).isNotNull() & F.col(second).isNotNull()).select(
        *EVENT, "label", F.explode(F.array(
            F.struct(F.lit("a").alias("side"), F.col(first).alias("score")),
            F.struct(F.lit("b").alias("side"), F.col(second).alias("score")))).alias("s")).select(
        *EVENT, "label", "s.side", "s.score"))
    ap = average_precision(known, [*EVENT, "side"]).where("n_evaluated >= 2").groupBy(*EVENT).agg(
        F.max(F.when(F.col("side") == "a", F.col("auprc"))).alias("first_auprc"),
        F.max(F.when(F.col("side") == "b", F.col("auprc"))).alias("second_auprc"))
    both = totals.join(ap.dropna(subset=["first_auprc", "second_auprc"]), list(EVENT))
    return both.withColumn("effect", F.col("second_auprc") - F.col("first_auprc"))


def event_extremes(effects: DataFrame, digits: int = 9) -> DataFrame:
    """The most and the least improved event per entity, never the same one."""
    order = F.struct("segment", "event_start")
    effect = F.round("effect", digits)
    best = effects.groupBy("entity").agg(F.min(F.struct(
        (-effect).alias("e"), order.alias("o"))).alias("b")).select(
        "entity", "b.o.segment", "b.o.event_start", F.lit("success").alias("selected_as"))
    best = stage(best)
    rest = effects.join(best.drop("selected_as"), ["entity", "segment", "event_start"], "left_anti")
    worst = rest.groupBy("entity").agg(F.min(F.struct(
        effect.alias("e"), order.alias("o"))).alias("b")).select(
        "entity", "b.o.segment", "b.o.event_start", F.lit("failure").alias("selected_as"))
    return best.unionByName(worst)


def event_audit(effects: DataFrame, extremes: DataFrame) -> DataFrame:
    return attach(effects, extremes, EVENT, "left")


def event_windows(selected: DataFrame, frame: DataFrame, horizon: int, first: str = "native",
                  second: str = "yhat", digits: int = 9) -> DataFrame:
    """The window and channel that explains a selected event.

    Among windows whose forecast overlaps the event, the largest (success) or
    smallest (failure) gain in squared error; without overlap the nearest
    windows.  ``selected``: one success and one failure per entity, so a window
    meets at most two events, whatever their length.
    """
    gain = (array_diff_mean(first, "y", lambda a, b: (a - b) * (a - b))
            - array_diff_mean(second, "y", lambda a, b: (a - b) * (a - b)))
    rows = frame.select("entity", "segment", "w", "channel", F.round(gain, digits).alias("gain"))
    chosen = stage(selected.select("entity", "segment", "event_start", "event_stop",
                                   "selected_as"))
    direct = rows.join(chosen, ["entity", "segment"]).where(
        (F.col("w") > F.col("event_start") - horizon) & (F.col("w") < F.col("event_stop")))
    keys = ["entity", "segment", "event_start", "event_stop", "selected_as"]
    bare = attach(rows.drop("segment"), stage(chosen.join(
        direct.select(*keys).distinct(), keys, "left_anti")), ["entity"])
    gap = F.abs(F.col("w") - F.col("event_start"))
    closest = bare.groupBy(*keys).agg(F.min(F.struct(gap.alias("g"), "w")).alias("m")).select(
        *keys, F.col("m.w").alias("w"))
    fallback = bare.join(stage(closest), [*keys, "w"])
    signed = F.when(F.col("selected_as") == "success", -F.col("gain")).otherwise(F.col("gain"))
    every = direct.select(*keys, "w", "channel", "gain").unionByName(
        fallback.select(*keys, "w", "channel", "gain"))
    return every.groupBy(*keys).agg(F.min(F.struct(
        signed.alias("g"), "w", "channel", "gain")).alias("m")).select(
        *keys, F.col("m.channel").alias("channel"), F.col("m.w").alias("forecast_start"),
        (F.col("m.w") + horizon).alias("forecast_stop"), F.col("m.gain").alias("gain"))


def event_traces(selected: DataFrame, scores: DataFrame, chunk: int = TRACE_CHUNK) -> DataFrame:
    """Score traces of selected events in chunks of at most ``chunk`` steps, numbered from 0.

    ``selected``: one success and one failure per entity, so a point meets at most two events.
    An interval without a scored point has no chunk.
    """
    near = scores.join(stage(selected.select(*EVENT, "interval_start", "interval_stop")),
                       ["entity", "segment"]).where(
        (F.col("t") >= F.col("interval_start")) & (F.col("t") < F.col("interval_stop")))
    number = F.floor((F.col("t") - F.col("interval_start")) / chunk).cast("int")
    return near.groupBy(*EVENT, number.alias("chunk")).agg(F.sort_array(F.collect_list(
        F.struct("t", "label", "native_score", "fused_score"))).alias("trace"))


def event_cases(selected: DataFrame, contexts: DataFrame, retrieved: DataFrame,
                bank_contexts: DataFrame | None = None) -> DataFrame:
    """One nested record per selected event: query, neighbours, forecasts; ``event_traces`` has its scores."""
    key = ["entity", "segment", "channel", "w"]
    at = selected.withColumn("w", F.col("forecast_start"))
    base = at.join(contexts.select(*key, "ctx"), key).join(
        retrieved.select(*key, "y", "native", "yhat", "gate", "candidates"), key)
    record = base
    if bank_contexts is not None:
        flat = record.select("entity", "segment", "event_start", "channel",
                             F.explode("candidates.src_w").alias("src_w"))
        near = flat.join(bank_contexts.select("entity", "channel", "src_w", "ctx"),
                         ["entity", "channel", "src_w"]).groupBy(
            "entity", "segment", "event_start").agg(F.sort_array(F.collect_list(
                F.struct("src_w", "ctx"))).alias("neighbour_contexts"))
        record = record.join(near, ["entity", "segment", "event_start"], "left")
    return record
