"""Bounded memory of normal history per entity and channel."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.defaults import BOUNDARY_SHARE, POOL_FACTOR, SCALE_FLOOR, WAVEFORM_POINTS
from spark_analog.functions import kernels
from spark_analog.operators import windows as win
from spark_analog.operators.intervals import open_intervals
from spark_analog.operators.ordered import DIRECT_ROWS, quantiles, time_rank
from spark_analog.operators.staging import attach, stage

GROUP = ("entity", "channel")
WIDTH = 5 + WAVEFORM_POINTS


def eligible(windows: DataFrame, normal: DataFrame | None = None, keys=("entity",)) -> DataFrame:
    """Windows that may enter the memory: complete, finite features, marked normal.

    ``normal`` holds the allowed ``(keys, w)``; with ``channel`` among the keys
    it is channel-specific, without it a window counts for all channels.
    """
    kept = windows.where("complete and known")
    if normal is not None:
        kept = kept.join(normal.select(*keys, "w").distinct(), [*keys, "w"], "left_semi")
    return kept


def unspoiled(windows: DataFrame, labels: DataFrame, context: int, horizon: int,
              keys=("entity",)) -> DataFrame:
    """``(keys, w)`` of windows that touch no labelled anomaly.

    Each anomalous step spoils an interval of windows; a sweep counts how many are
    open at a window, so a step is two rows whatever the window's length.
    """
    bad = labels.where("label > 0").select(
        *keys, (F.col("t") - horizon + 1).alias("start"), (F.col("t") + context).alias("stop"))
    own = stage(windows.select(*keys, "w").distinct())
    return open_intervals(own, bad, keys, "w", out="__open").where("__open = 0").select(*keys, "w")


def empty_channels(all_windows: DataFrame, kept: DataFrame, group=GROUP) -> DataFrame:
    return all_windows.select(*group).distinct().join(
        kept.select(*group).distinct(), list(group), "left_anti")


def feature_scale(windows: DataFrame, group=GROUP, floor: float = SCALE_FLOOR,
                  most: int | None = None, width: int | None = None) -> DataFrame:
    """Robust centre and scale of every feature dimension: ``group, dim, center, scale``.

    With a known ``width`` and groups bounded by ``most`` all dimensions are
    aggregated side by side; otherwise they are exploded into keys, so that
    large groups take the sketched path of ``quantiles``.
    """
    if width and most is not None and most <= DIRECT_ROWS:
        probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
        per = windows.groupBy(*group).agg(*[
            F.percentile(F.col("feat")[i], probs).alias(f"d{i}") for i in range(width)])
        q = per.select(*group, F.posexplode(F.array(*[f"d{i}" for i in range(width)])).alias(
            "dim", "q")).select(*group, "dim", F.col("q")[0].alias("q1"),
                                F.col("q")[1].alias("center"), F.col("q")[2].alias("q3"))
    else:
        flat = windows.select(*group, F.posexplode("feat").alias("dim", "v"))
        q = quantiles(flat, [*group, "dim"], "v", [0.25, 0.5, 0.75], ["q1", "center", "q3"],
                      most=most)
    iqr = F.col("q3") - F.col("q1")
    return q.select(*group, "dim", "center",
                    F.when(iqr < floor, F.lit(1.0)).otherwise(iqr).alias("scale"))


def pack_scale(scales: DataFrame, group=GROUP) -> DataFrame:
    """``center`` and ``scale`` as arrays in dimension order, one row per group."""
    packed = scales.groupBy(*group).agg(
        F.sort_array(F.collect_list(F.struct("dim", "center", "scale"))).alias("__s"))
    return packed.select(*group, F.col("__s.center").alias("center"),
                         F.col("__s.scale").alias("scale"))


def scale_features(windows: DataFrame, packed: DataFrame, group=GROUP) -> DataFrame:
    """Replace ``feat`` by its scaled values."""
    joined = attach(windows, packed, group)
    moved = F.zip_with("feat", "center", lambda f, c: f - c)
    return joined.withColumn("feat", F.zip_with(moved, "scale", lambda f, s: f / s)).select(
        *windows.columns)


def uniform_slot(position, n, wanted) -> Column:
    """Slot that takes ``position`` when ``wanted`` bin centres cover ``n``; NULL if none.

    Inverts ``floor((i + 0.5) * n / wanted)``, so no list of positions is joined.
    """
    i = F.ceil((2 * position * wanted - n) / (2 * n))
    hit = F.floor((2 * i + 1) * n / (2 * wanted)) == position
    return F.when(n <= wanted, position).when(hit & (i < wanted), i)


def positions(windows: DataFrame, group=GROUP) -> DataFrame:
    """``group, w, __pos, __n``: place in time among the eligible windows, staged.

    Only keys are ranked and shuffled; the wide feature rows stay where they are.
    """
    keys = windows.select(*group, "w")
    counts = keys.groupBy(*group).agg(F.count("*").alias("__n"))
    return stage(attach(time_rank(keys, group, "w", "__pos"), counts, group))


def _pick(scaled: DataFrame, placed: DataFrame, slots, extra=(), group=GROUP) -> DataFrame:
    """Feature rows whose position takes one of ``slots`` bin centres."""
    slot = uniform_slot(F.col("__pos"), F.col("__n"), slots)
    chosen = stage(placed.where(slot.isNotNull()).select(*group, "w", *extra))
    return scaled.join(chosen, [*group, "w"]).select(*scaled.columns, *[
        F.col(c) for c in chosen.columns if c not in (*group, "w")])


def select_uniform(scaled: DataFrame, size: int, group=GROUP) -> DataFrame:
    return _pick(scaled, positions(scaled, group), F.lit(size), (), group)


def _sizes(size: int, boundary: bool) -> tuple[Column, Column]:
    """(core, boundary) slots as columns of the eligible count ``__n``."""
    wanted = F.least(F.lit(size), F.col("__n"))
    if not boundary:
        return wanted, F.lit(0)
    edge = F.least(F.greatest(F.lit(1), F.bround(F.lit(BOUNDARY_SHARE) * wanted, 0)),
                   F.greatest(F.col("__n") - 1, F.lit(0)))
    return F.greatest(wanted - edge, F.lit(1)), edge


def _core(scaled: DataFrame, placed: DataFrame, size: int, boundary: bool, group=GROUP
          ) -> DataFrame:
    """Greedy farthest-point core of a uniform pool of at most 4 x size rows per group."""
    columns = scaled.columns
    core, _ = _sizes(size, boundary)
    pool = F.least(F.col("__n"), core * POOL_FACTOR)
    pooled = _pick(scaled, placed, pool, [core.cast("int").alias("__core")], group)

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("w", kind="stable", ignore_index=True)
        pool_feat = np.array(pdf["feat"].tolist(), dtype=np.float64)
        chosen = kernels.farthest(pool_feat, int(pdf["__core"].iloc[0]))
        return pdf.iloc[chosen][list(columns)]

    return pooled.groupBy(*group).applyInPandas(pick, scaled.schema)


def select_farthest(scaled: DataFrame, size: int, group=GROUP) -> DataFrame:
    return _core(scaled, positions(scaled, group), size, False, group)


def select_boundary(scaled: DataFrame, size: int, group=GROUP) -> DataFrame:
    """Diverse core plus the windows farthest from the centre among the rest.

    The rest needs only the largest ``edge + core`` radii of a group, a constant
    limit that Spark applies before the shuffle, and only keys and radii are
    sorted; the few chosen feature rows are fetched afterwards.
    """
    placed = positions(scaled, group)
    core = stage(_core(scaled, placed, size, True, group))
    radii = scaled.select(*group, "w", F.round(_square("feat"), 9).alias("__radius"))
    added = _edge(radii, core.select(*group, "w"), placed, size, group)
    return core.unionByName(scaled.join(added, [*group, "w"]).select(*scaled.columns))


def _square(feat) -> Column:
    return F.aggregate(feat, F.lit(0.0), lambda a, x: a + x * x)


def _edge(radii: DataFrame, core: DataFrame, placed: DataFrame, size: int, group=GROUP) -> DataFrame:
    """``group, w`` of the windows with the largest ``__radius`` outside the core, staged."""
    core_size, edge = _sizes(size, True)
    limit = size + int(round(BOUNDARY_SHARE * size)) + 1
    by_radius = Window.partitionBy(*group).orderBy(F.desc("__radius"), F.desc("w"))
    outer = radii.withColumn("__rn", F.row_number().over(by_radius)).where(F.col("__rn") <= limit)
    rest = outer.join(core, [*group, "w"], "left_anti").withColumn(
        "__rn", F.row_number().over(by_radius))
    sizes = placed.where("__pos = 0").select(*group, "__n")
    room = F.least(F.lit(size), F.col("__n")) - core_size
    return stage(attach(rest, sizes, group).where(
        F.col("__rn") <= F.least(edge, room)).select(*group, "w"))


SELECT = {"uniform": select_uniform, "farthest": select_farthest, "boundary": select_boundary}


def with_delta(windows: DataFrame) -> DataFrame:
    """Future stored relative to the last context value."""
    return windows.withColumn("delta", F.transform("y", lambda y: y - F.col("last")))


#: Windows of a group that are known to fit one task with their features (11 MB).
GROUP_ROWS = 1 << 16


def _slots(n: int, size: int, selection: str, w: np.ndarray, feat: np.ndarray) -> np.ndarray:
    """Positions, ascending in time, that ``SELECT[selection]`` takes of ``n`` windows."""
    def spread(wanted):
        return np.flatnonzero(_taken(np.arange(n), n, wanted))

    if selection == "uniform":
        return spread(size)
    wanted = min(size, n)
    edge = min(max(1, round(BOUNDARY_SHARE * wanted)), max(n - 1, 0)) if selection == "boundary" else 0
    core = max(wanted - edge, 1)
    pool = spread(min(n, core * POOL_FACTOR))
    chosen = pool[kernels.farthest(np.ascontiguousarray(feat[pool]), core)]
    if selection == "farthest":
        return chosen
    square = np.zeros(n)
    for d in range(feat.shape[1]):
        square += feat[:, d] * feat[:, d]
    outer = np.lexsort((-w, -square.round(9)))[:size + int(round(BOUNDARY_SHARE * size)) + 1]
    rest = outer[~np.isin(outer, chosen)][:max(0, min(edge, wanted - core))]
    return np.sort(np.concatenate([chosen, rest]))


def _taken(position: np.ndarray, n: int, wanted: int) -> np.ndarray:
    """``uniform_slot`` is not NULL."""
    if n <= wanted:
        return np.ones(len(position), bool)
    i = np.ceil((2 * position * wanted - n) / (2 * n))
    return (np.floor((2 * i + 1) * n / (2 * wanted)) == position) & (i < wanted)


def _one_bank(w, last, y, feat, size: int, selection: str):
    """Slots of one group: their ``w``, scaled features and deltas, and the centre and scale of all windows."""
    order = np.argsort(w, kind="stable")
    w, last, y, feat = w[order], last[order], y[order], feat[order]
    q1, center, q3 = kernels.percentiles(feat, (0.25, 0.5, 0.75))
    scale = np.where(q3 - q1 < SCALE_FLOOR, 1.0, q3 - q1)
    feat = (feat - center) / scale
    at = _slots(len(w), size, selection, w, feat)
    return w[at], feat[at], y[at] - last[at][:, None], center, scale


_PACKED = (("src_w", T.LongType()), ("feat", T.DoubleType()), ("delta", T.DoubleType()),
           ("center", T.DoubleType()), ("scale", T.DoubleType()))


def _packed(rows: DataFrame, group, read, size: int, selection: str) -> DataFrame:
    """Slots and scales of a group in one row, made in one task; ``read`` gives the windows of its rows."""
    if selection not in SELECT:
        raise ValueError(f"unknown selection {selection!r}")
    schema = T.StructType([rows.schema[c] for c in group] + [T.StructField(c, T.ArrayType(k)) for c, k in _PACKED])

    def run(key, table):
        w, last, y, feat, kept = read(table)
        if not kept.any():
            return pa.Table.from_batches([], schema=pa.schema(
                [(c, k.type) for c, k in zip(group, key)] + [
                    (c, pa.list_(pa.int64() if c == "src_w" else pa.float64())) for c, _ in _PACKED]))
        found = _one_bank(w[kept], last[kept], y[kept], feat[kept], size, selection)
        return pa.Table.from_arrays(
            [pa.array([k.as_py()], k.type) for k in key] + [
                pa.array([v.reshape(-1)]) for v in found], names=[*group, *(c for c, _ in _PACKED)])

    return stage(rows.groupBy(*group).applyInArrow(run, schema))


def _banks(packed: DataFrame, group) -> tuple[DataFrame, DataFrame]:
    """(bank, packed scales) of ``_packed`` groups."""
    z = packed.select(*group, "feat", "delta", F.size("src_w").alias("__n"), F.posexplode("src_w").alias("__i", "src_w"))

    def part(column):
        width = (F.size(column) / F.col("__n")).cast("int")
        return F.slice(column, F.col("__i") * width + 1, width).alias(column)

    bank = z.select(*group, (F.col("__i") + 1).alias("slot"), "src_w", part("feat"), part("delta"))
    return bank, packed.select(*group, "center", "scale")


def build_block_bank(blocked: DataFrame, context: int, horizon: int, size: int, selection: str = "boundary",
                     most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``build_bank`` from the blocks of the memory role.

    Where ``most`` bounds the steps of an entity and channel to what fits a task, its raw blocks meet
    there and features, 20 times wider, exist nowhere else."""
    if most is None or most > GROUP_ROWS:
        return build_bank(win.scan(blocked, context, horizon, features=True), size, selection, most=most)
    return _banks(_block_groups(blocked, context, horizon, size, selection), GROUP)


def _block_groups(blocked: DataFrame, context: int, horizon: int, size: int, selection: str) -> DataFrame:
    starts = win.legal_starts(context, horizon)
    rows = blocked.select(*GROUP, "start", "block", "block_size", "values", starts.alias("__starts")).where(
        F.size("__starts") > 0)
    return _packed(rows, GROUP, lambda table: win.features_of(table, context, horizon), size, selection)


def packed_block_bank(blocked: DataFrame, context: int, horizon: int, size: int, selection: str = "boundary",
                      most: int | None = None) -> DataFrame:
    """``pack_bank`` of ``build_block_bank``: what one task made in packed form stays packed."""
    if most is None or most > GROUP_ROWS:
        return pack_bank(*build_block_bank(blocked, context, horizon, size, selection, most))
    made = _block_groups(blocked, context, horizon, size, selection)
    done = made.select(*GROUP, F.col("src_w").alias("bank_w"), F.col("feat").alias("bank_feat"),
                       F.col("delta").alias("bank_delta"), "center", "scale")
    done._staged = True
    return done


def _read_windows(table: pa.Table):
    def wide(column):
        flat = table.column(column).combine_chunks().flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(table.num_rows, -1)

    w, last = (table.column(c).to_numpy(zero_copy_only=False) for c in ("w", "last"))
    return w, last, wide("y"), wide("feat"), np.ones(len(w), bool)


def build_bank(windows: DataFrame, size: int, selection: str = "boundary",
               normal: DataFrame | None = None, normal_keys=("entity",), group=GROUP,
               most: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(bank, packed scales) from feature windows of the memory role.

    ``bank``: ``group, slot, src_w, feat, delta``.  Where ``most`` bounds the windows of a group to what
    fits a task, they meet there.  Otherwise features, 20 times wider than a step, are recomputed from
    blocks in each pass rather than written or shuffled; only keys, quantiles, pools and the result are.
    """
    kept = eligible(windows, normal, normal_keys).select(*group, "w", "last", "y", "feat")
    if most is not None and most <= GROUP_ROWS:
        return _banks(_packed(kept, group, _read_windows, size, selection), group)
    scales = stage(pack_scale(feature_scale(kept, group, most=most, width=WIDTH), group))
    chosen = SELECT[selection](scale_features(kept, scales, group), size, group)
    slot = F.row_number().over(Window.partitionBy(*group).orderBy("w"))
    bank = with_delta(chosen).select(*group, slot.alias("slot"), F.col("w").alias("src_w"),
                                     "feat", "delta")
    return bank, scales


def pack_bank(bank: DataFrame, scales: DataFrame, group=GROUP) -> DataFrame:
    """One row per group with the bank as flat arrays (at most ``size`` slots)."""
    rows = bank.groupBy(*group).agg(F.sort_array(F.collect_list(
        F.struct("slot", "src_w", "feat", "delta"))).alias("__b"))
    return stage(rows.join(scales, list(group)).select(
        *group, F.col("__b.src_w").alias("bank_w"), F.flatten("__b.feat").alias("bank_feat"),
        F.flatten("__b.delta").alias("bank_delta"), "center", "scale"))


WHOLE = ("entity",)


def whole_windows(windows: DataFrame) -> DataFrame:
    """``entity, w`` of the windows that are complete and known in every channel, staged."""
    usable = F.col("complete") & F.col("known")
    return stage(windows.groupBy(*WHOLE, "w").agg(F.bool_and(usable).alias("__ok")).where("__ok").select(
        *WHOLE, "w"))


def _joint_core(scaled: DataFrame, placed: DataFrame, size: int, boundary: bool) -> DataFrame:
    """``entity, w`` of the greedy core over all channels, staged.

    The products of the pool's rows are sums over channels: a task reads an entity channel by channel
    and adds up one square table of the pool, at most 4 x size on a side.
    """
    core, _ = _sizes(size, boundary)
    pool = F.least(F.col("__n"), core * POOL_FACTOR)
    chosen = stage(placed.where(uniform_slot(F.col("__pos"), F.col("__n"), pool).isNotNull()).select(
        *WHOLE, "w", core.cast("int").alias("__core")))
    rows = scaled.select(*GROUP, "w", "feat").join(chosen, [*WHOLE, "w"]).repartition(*WHOLE).sortWithinPartitions(
        *GROUP, "w").select(*GROUP, "w", "__core", "feat")

    def kernel(batches):
        part: list = []
        entity = channel = table = w = wanted = None

        def add():
            nonlocal table, w, part
            at = np.array([x for x, _ in part], dtype=np.int64)
            if w is not None and not np.array_equal(at, w):
                raise ValueError("the channels of an entity must have the same windows")
            feat = np.array([f for _, f in part], dtype=np.float64)
            product = feat @ feat.T
            table, w, part = product if table is None else table + product, at, []

        def close():
            add()
            kept = w[kernels.farthest_by(table.diagonal().copy(), lambda i: table[i], wanted)]
            return pd.DataFrame({"entity": entity, "w": kept})

        for pdf in batches:
            for e, c, x, n, f in pdf.itertuples(index=False, name=None):
                if part and (e, c) != (entity, channel):
                    if e == entity:
                        add()
                    else:
                        yield close()
                        table = w = None
                        part = []
                entity, channel, wanted = e, c, n
                part.append((x, f))
        if part:
            yield close()

    return stage(rows.mapInPandas(kernel, "entity string, w bigint"))


def _joint_choice(scaled: DataFrame, whole: DataFrame, size: int, selection: str) -> DataFrame:
    """``entity, w`` of the slots of a global memory, staged."""
    placed = positions(whole, WHOLE)
    if selection == "uniform":
        taken = uniform_slot(F.col("__pos"), F.col("__n"), F.lit(size)).isNotNull()
        return stage(placed.where(taken).select(*WHOLE, "w"))
    if selection == "farthest":
        return _joint_core(scaled, placed, size, False)
    if selection != "boundary":
        raise ValueError(f"unknown selection {selection!r}")
    core = _joint_core(scaled, placed, size, True)
    radii = scaled.groupBy(*WHOLE, "w").agg(F.round(F.sum(_square("feat")), 9).alias("__radius"))
    return core.unionByName(_edge(radii, core, placed, size, WHOLE))


def build_global_bank(windows: DataFrame, size: int, selection: str = "boundary", most: int | None = None
                      ) -> tuple[DataFrame, DataFrame]:
    """As ``build_bank`` with the same windows in the slots of all channels of an entity.

    A window counts if it is complete and known in every channel.  What decides (products, radii) is a
    sum over channels, so features stay one row per channel: ``bank``: ``entity, channel, slot, src_w,
    feat, delta``; scales per entity and channel.
    """
    whole = whole_windows(windows)
    kept = windows.select(*GROUP, "w", "last", "y", "feat").join(whole, [*WHOLE, "w"], "left_semi")
    scales = stage(pack_scale(feature_scale(kept, most=most, width=WIDTH)))
    scaled = scale_features(kept, scales)
    choice = _joint_choice(scaled, whole, size, selection)
    slots = stage(choice.select("*", F.row_number().over(Window.partitionBy(*WHOLE).orderBy("w")).alias("slot")))
    bank = with_delta(scaled.join(slots, [*WHOLE, "w"]))
    return bank.select(*GROUP, "slot", F.col("w").alias("src_w"), "feat", "delta"), scales


def footprint(bank: DataFrame, scales: DataFrame, keys=("entity",)) -> DataFrame:
    """Bytes of a float32 bank: features, deltas and an index per slot, scales, a size."""
    slots = bank.groupBy(*keys).agg(F.sum(
        4 * F.size("feat") + 4 * F.size("delta") + 8).alias("__slots"))
    tables = scales.groupBy(*keys).agg(F.sum(2 * 4 * F.size("center") + 8).alias("__stats"))
    return slots.join(tables, list(keys)).select(
        *keys, (F.col("__slots") + F.col("__stats")).cast("bigint").alias("bytes"))


def bank_contexts(bank: DataFrame, contexts: DataFrame, group=GROUP) -> DataFrame:
    """Raw context and future of every stored slot."""
    raw = contexts.select(*group, F.col("w").alias("src_w"), "ctx", F.col("y").alias("future"))
    return bank.select(*group, "slot", "src_w").join(raw, [*group, "src_w"])
