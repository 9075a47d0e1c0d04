"""Objectives of all score parameters at once, without a copy of the points per grid point.

Average precision needs two numbers per positive point: how many points, and how many positive
ones, score at least as high. So points stay where they are, packed in time blocks, and only
the positives' scores travel. A block's scores at all grid points exist inside a task alone; there
they are sorted and each positive's place is looked up. Places are added over the blocks.

1. ``_pack``: points with labels are grouped into time blocks that also hold the steps that
   smoothing reaches back to. A row has the block's components, the scores of its positives, and
   counts per grid point.
2. ``_places``: positives are dealt into pieces of bounded size. A piece meets the blocks
   of its entity, some per task.
3. ``_sums``: places are added over tasks and turned into sums of precision.
4. ``grid_objectives`` adds sums and counts per entity: one row per entity and grid point.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.defaults import AGREEMENT_GRID, MEMORY_GRID, SMOOTHING_GRID, TOP_Q_GRID
from spark_analog.functions import kernels
from spark_analog.operators.staging import attach, stage


@dataclass(frozen=True)
class Sizes:
    """``span``: steps of a time block; ``positives``: after so many a piece ends, up to a block's more;
    ``blocks``: blocks that meet a piece in one task; ``added``: blocks whose counts are added at once."""
    span: int = 4096
    positives: int = 2048
    blocks: int = 16
    added: int = 256


def _typed(frame: DataFrame, columns, **more) -> T.StructType:
    kinds = {"long": T.LongType(), "binary": T.BinaryType(), "double": T.DoubleType(), "int": T.IntegerType()}
    return T.StructType([frame.schema[c] for c in columns] + [T.StructField(c, kinds[k]) for c, k in more.items()])


def _row(key: tuple, **more) -> pa.Table:
    """One row: the group's key, then numbers and arrays as bytes."""
    cols = [pa.array([k.as_py()], k.type) for k in key]
    names = [f"k{i}" for i in range(len(key))]
    for c, v in more.items():
        names.append(c)
        cols.append(pa.array([v.tobytes()], pa.binary()) if isinstance(v, np.ndarray) else pa.array([v], pa.int64()))
    return pa.Table.from_arrays(cols, names=names)


def _named(table: pa.Table, schema: T.StructType) -> pa.Table:
    return table.rename_columns(schema.names)


def _floats(cell, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_py(), np.float64).reshape(rows, -1)


def _pack(points: DataFrame, keys: list[str], axes: tuple, s: Sizes, digits: int) -> DataFrame:
    """keys, part, b, positives, points (packed), scores of the positives, n and p per grid point."""
    reach = max(axes[3]) - 1
    spread = points.withColumn("b", F.explode(F.sequence(F.floor(F.col("t") / s.span), F.floor((F.col("t") + reach) / s.span))))
    schema = _typed(spread, [*keys, "part", "b"], positives="long", points="binary", scores="binary", n="binary", p="binary")

    def run(key, table):
        t = table.column("t").to_numpy()
        order = np.argsort(t, kind="stable")
        packed = np.stack([t.astype(float), *[table.column(c).to_numpy(zero_copy_only=False).astype(float)
                                              for c in ("label", "residual", "memory", "agreement")]])[:, order]
        scores, mark = _block_scores(packed, key[-1].as_py(), axes, s, digits)
        own, hit = ~np.isnan(scores), mark > 0
        return _named(_row(key, positives=int(hit.sum()), points=packed, scores=scores[:, hit],
                           n=own.sum(1), p=(own & hit).sum(1)), schema)

    return stage(spread.select(*keys, "part", "b", "t", "label", "residual", "memory", "agreement")
                 .groupBy(*keys, "part", "b").applyInArrow(run, schema))


def _block_scores(packed: np.ndarray, block: int, axes: tuple, s: Sizes, digits: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores and labels of a block's own points that have a label."""
    t = packed[0].astype(np.int64)
    times, scores = kernels.grid_scores(t, packed[2:].T, axes, digits)
    mark = packed[1, np.searchsorted(t, times)]
    own = (times // s.span == block) & ~np.isnan(mark)
    return np.ascontiguousarray(scores[:, own]), mark[own]


def _places(blocks: DataFrame, keys: list[str], axes: tuple, s: Sizes, digits: int) -> DataFrame:
    """keys, piece, and for the piece's positives: their parts, scores, points and positives at or above, in
    all blocks of the key and (``own_``) in those of the same part; one row per task's share of the blocks.
    Where one task meets all blocks of the key, it makes the rows of ``_sums`` itself."""
    width = int(np.prod([len(a) for a in axes]))
    before = Window.partitionBy(*keys).orderBy("part", "b").rowsBetween(Window.unboundedPreceding, -1)
    dealt = blocks.select(*keys, "part", "b", "positives", F.floor(
        F.coalesce(F.sum("positives").over(before), F.lit(0)) / s.positives).alias("piece")).filter("positives > 0")
    shares = blocks.groupBy(*keys).agg(F.ceil(F.count("*") / s.blocks).alias("shares"))
    dealt = stage(attach(dealt.drop("positives"), shares, keys))
    empty = F.lit(None).cast("binary")
    asking = (attach(blocks.select(*keys, "part", "b", "scores"), dealt, [*keys, "part", "b"])
              .select(*keys, "piece", "shares", F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"),
                      "part", "b", "scores", empty.alias("points")))
    asked = (blocks.select(*keys, "part", "b", "points").join(dealt.select(*keys, "piece", "shares").distinct(), keys)
             .select(*keys, "piece", "shares", F.pmod(F.xxhash64("part", "b"), F.col("shares")).alias("share"),
                     "part", "b", empty.alias("scores"), "points"))
    both = asking.unionByName(asked)
    schema = _typed(both, [*keys, "piece"], parts="binary", **dict.fromkeys(
        ("scores", "seen", "hits", "own_seen", "own_hits"), "binary"), part="long", whole="binary", own="binary")

    def run(key, table):
        part, block = (table.column(c).to_pylist() for c in ("part", "b"))
        scores, points = table.column("scores"), table.column("points")
        mine = sorted((part[i], block[i], i) for i in range(table.num_rows) if scores[i].is_valid)
        values = [_floats(scores[i], width) for _, _, i in mine]
        asked_ = np.concatenate(values, axis=1)
        parts = np.repeat([p for p, _, _ in mine], [v.shape[1] for v in values])
        seen, hits, own_seen, own_hits = (np.zeros(asked_.shape, np.int64) for _ in range(4))
        for i in range(table.num_rows):
            if points[i].is_valid:
                found, mark = _block_scores(_floats(points[i], 5), block[i], axes, s, digits)
                above, hit = kernels.at_or_above(found, asked_), kernels.at_or_above(found[:, mark > 0], asked_)
                seen, hits, same = seen + above, hits + hit, parts == part[i]
                own_seen[:, same] += above[:, same]
                own_hits[:, same] += hit[:, same]
        if table.column("shares")[0].as_py() == 1:
            rows = _precision(key[:-1], parts, asked_, seen, hits, own_seen, own_hits)
        else:
            rows = _row(key[:-1], parts=parts, scores=asked_, seen=seen, hits=hits, own_seen=own_seen, own_hits=own_hits)
        lead = dict(zip(schema.names, rows.columns[:len(keys) + 1])) | {
            c: rows.column(c) for c in rows.column_names[len(keys) + 1:]}
        return pa.Table.from_arrays(
            [lead[f.name] if f.name in lead else pa.nulls(rows.num_rows, pa.int64() if f.name == "part" else pa.binary())
             for f in schema], names=schema.names)

    return both.groupBy(*keys, "piece", "share").applyInArrow(run, schema)


def _precision(key: tuple, parts, scores, seen, hits, own_seen, own_hits) -> pa.Table:
    """One row per part: the precision at its positives in all blocks and in the part's own, added per grid point."""
    whole, own = (np.where(np.isnan(scores), 0.0, hit / np.maximum(all_, 1)) for hit, all_ in ((hits, seen), (own_hits, own_seen)))
    return pa.concat_tables([_row(key, part=int(p), whole=whole[:, parts == p].sum(1), own=own[:, parts == p].sum(1))
                             for p in np.unique(parts)])


def _sums(places: DataFrame, keys: list[str], width: int) -> DataFrame:
    """keys, part, ``whole`` and ``own``: the precision at the positives of a piece and part, added per grid point."""
    schema = _typed(places, keys, part="long", whole="binary", own="binary")

    def run(key, table):
        if table.column("whole")[0].is_valid:
            return table.select(schema.names)
        scores = _floats(table.column("scores")[0], width)
        parts = np.frombuffer(table.column("parts")[0].as_py(), np.int64)
        seen, hits, own_seen, own_hits = (
            sum(np.frombuffer(x.as_py(), np.int64).reshape(scores.shape) for x in table.column(c))
            for c in ("seen", "hits", "own_seen", "own_hits"))
        return _named(_precision(key[:-1], parts, scores, seen, hits, own_seen, own_hits), schema)

    return places.groupBy(*keys, "piece").applyInArrow(run, schema)


def grid_objectives(parts: DataFrame, labels: DataFrame, keys=("entity",), group=("entity", "role", "segment", "t"),
                    top_q=TOP_Q_GRID, memory=MEMORY_GRID, agreement=AGREEMENT_GRID, smoothing=SMOOTHING_GRID,
                    selection: str = "aggregate", digits: int = 9, sizes: Sizes = Sizes()) -> DataFrame:
    """``keys, grid_id, objective, blocks``: average precision of every grid point, NULL with a single
    class; for ``macro_block`` its mean over the segments with both classes, where there are two or more.

    Scores are rounded to ``digits``, as is the mean over channels before smoothing; points without a
    label or a score are left out."""
    s, keys = sizes, list(keys)
    axes = (tuple(map(float, top_q)), tuple(map(float, memory)), tuple(map(float, agreement)), tuple(map(int, smoothing)))
    rest = [g for g in group if g not in ("t", *keys)]
    width = int(np.prod([len(a) for a in axes]))
    part = F.xxhash64(*rest) if rest else F.lit(0).cast("long")  # tells the few segments of one key apart
    points = parts.select(*keys, part.alias("part"), "t", *(c for c in ("entity",) if c not in keys),
                          "residual", "memory", "agreement").join(
        labels.select("entity", "t", F.col("label").cast("double").alias("label")), ["entity", "t"])
    blocks = _pack(points, keys, axes, s, digits)
    sums = _sums(_places(blocks, keys, axes, s, digits), keys, width)
    none = F.lit(None).cast("binary")
    counts = blocks.select(*keys, "part", F.floor(F.col("b") / s.added).alias("b"), "n", "p", none.alias("whole"), none.alias("own"))
    rows = counts.unionByName(sums.select(*keys, "part", F.lit(0).cast("long").alias("b"), none.alias("n"), none.alias("p"),
                                          "whole", "own"))
    schema = _typed(rows, [*keys, "part"], n="binary", p="binary", whole="binary", own="binary")

    def added(table, column, kind):
        return sum((np.frombuffer(x.as_py(), kind) for x in table.column(column) if x.is_valid), np.zeros(width, kind))

    def add(key, table):
        return _named(_row(key[:-1], n=added(table, "n", np.int64), p=added(table, "p", np.int64),
                           whole=added(table, "whole", np.float64), own=added(table, "own", np.float64)), schema)

    per_part = (rows.groupBy(*keys, "part", "b").applyInArrow(add, schema).withColumn("b", F.lit(0))
                .groupBy(*keys, "part", "b").applyInArrow(add, schema))
    done = _typed(rows, keys, grid_id="int", objective="double", blocks="long")

    def mean(p, n, total):
        return np.where((p > 0) & (p < n), total / np.maximum(p, 1), np.nan)

    def finish(key, table):
        n, p, whole = added(table, "n", np.int64), added(table, "p", np.int64), added(table, "whole", np.float64)
        value, several = mean(p, n, whole), np.zeros(width, np.int64)
        if selection != "aggregate":
            each = [mean(*(np.frombuffer(table.column(c)[i].as_py(), k) for c, k in
                           (("p", np.int64), ("n", np.int64), ("own", np.float64)))) for i in range(table.num_rows)]
            each = np.array(each)
            several = (~np.isnan(each)).sum(0)
            macro = np.nan_to_num(each).sum(0) / np.maximum(several, 1)
            value = np.where((several >= 2) & ~np.isnan(value), macro, value)
        cols = [pa.array([k.as_py()] * width, k.type) for k in key]
        return pa.Table.from_arrays(
            [*cols, pa.array(np.arange(width), pa.int32()), pa.array(value, mask=np.isnan(value)),
             pa.array(several, pa.int64())], names=done.names)

    return per_part.groupBy(*keys).applyInArrow(finish, done)
