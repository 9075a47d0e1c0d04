"""Near-duplicate vectors by an epsilon grid order join.

Unit vectors are turned onto the principal axes of the table (a rotation keeps
distances), and cosine >= ``cosine`` is a distance of at most
eps = sqrt(2 - 2 * cosine). Each vector gets the cells, of width eps, of its
leading coordinates; the rows are sorted by cell and cut into blocks, intervals
of the sequence with a bounding box. The join goes down over ever shorter
intervals: 16 neighbours of a level form one interval of the next, and a pair
of intervals whose boxes are more than eps apart is skipped with all it holds.
The blocks left are joined in tasks, which go on splitting them in the same way
down to small matrix products. A block pair returns sums of links and a spanning
forest, never its pairs.

Equal vectors are one row with a count before the join, so a vector copied over
a third of the table costs one row. Labels with many rows are many blocks.
The axes steer what can be skipped, not the result.

In high dimensions with evenly spread data few boxes are far apart; then the
join compares most blocks of a label, which grows with the square of a label's
different vectors. The result is exact in any case.

Results in special cases: null labels, and null, empty or zero vectors, or those
with a null, NaN or infinite component, link with nothing; vectors of different
length don't link; every row is a vector of its own, also where its id repeats or is
null, and counts as a link of the others; a component is named after the smallest id
in it, null if it has none, and a row without id is never kept; an empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.llm.components import components
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``leading``: coordinates in boxes; ``cells``: coordinates in the sort order;
    ``block``: rows of a block; ``leaf``: rows below which a task multiplies;
    ``fan``: power of two of the intervals that form one."""
    cosine: float = 0.93
    leading: int = 16
    cells: int = 8
    block: int = 1024
    leaf: int = 128
    fan: int = 4


def unit_rows(vectors: pa.Array) -> list[bytes | None]:
    """Unit vector in double precision of each usable vector."""
    out = []
    for v in vectors.to_pylist():
        if not v or any(c is None for c in v):
            out.append(None)
            continue
        x = np.array(v, float)
        top = np.abs(x).max()
        if not np.isfinite(x).all() or top == 0:
            out.append(None)
            continue
        x = x / top  # so that squares neither overflow nor vanish
        out.append((x / np.sqrt((x * x).sum())).tobytes())
    return out


def _units(vectors: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("label"), pa.array(unit_rows(b.column("v")), pa.binary())],
                names=["id", "label", "u"])
    kinds = {c: vectors.schema[c].dataType.simpleString() for c in ("id", "label")}
    return vectors.mapInArrow(run, f"id {kinds['id']}, label {kinds['label']}, u binary")


def principal_axes(reps: DataFrame, spread: int = 64) -> dict[int, np.ndarray]:
    """Axes, by variance, for each vector length; sums of products over all rows, added
    up in tasks to at most ``spread`` matrices a length before they reach the driver."""
    def partial(batches):
        from pyspark import TaskContext
        sums: dict[int, list] = {}
        for b in batches:
            found: dict[int, list] = {}
            for u in b.column("u").to_pylist():
                found.setdefault(len(u) // 8, []).append(u)
            for d, us in found.items():
                x = np.frombuffer(b"".join(us)).reshape(-1, d)
                s = sums.setdefault(d, [0, np.zeros(d), np.zeros((d, d))])
                s[0] += len(x)
                s[1] += x.sum(0)
                s[2] += x.T @ x
        g = TaskContext.get().partitionId() % spread
        for d, (n, m, c) in sums.items():
            yield pa.RecordBatch.from_pydict({"d": pa.array([d], pa.int32()), "g": pa.array([g], pa.int32()),
                                              "s": pa.array([np.concatenate([[n], m, c.ravel()]).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(s) for s in table.column("s").to_pylist())
        return table.slice(0, 1).set_column(2, "s", pa.array([total.tobytes()], pa.binary()))

    rows = (reps.select("u").mapInArrow(partial, "d int, g int, s binary")
            .groupBy("d", "g").applyInArrow(add, "d int, g int, s binary").collect())
    sums: dict[int, np.ndarray] = {}
    for r in rows:
        sums[r.d] = sums.get(r.d, 0) + np.frombuffer(bytes(r.s))
    axes = {}
    for d, s in sums.items():
        mean = s[1:d + 1] / s[0]
        cov = s[d + 1:].reshape(d, d) / s[0] - np.outer(mean, mean)
        axes[d] = np.linalg.eigh(cov)[1][:, ::-1].copy()
    return axes


class Links:
    """Links among the rows of two blocks: sums, and a forest by smallest row."""

    def __init__(self, n: int):
        self.root, self.add = np.arange(n), np.zeros(n, np.int64)

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        if not len(i):
            return
        # links of earlier calls are known by the forest only: a row that moves keeps its old root as a pair
        held = np.flatnonzero(self.root != np.arange(len(self.root)))
        i, j = np.concatenate([i, held]), np.concatenate([j, self.root[held]])
        while True:
            low = np.minimum(self.root[i], self.root[j])
            before = self.root.copy()
            for k in (i, j):
                np.minimum.at(self.root, self.root[k], low)
                np.minimum.at(self.root, k, low)
            self.root = self.root[self.root]
            if np.array_equal(before, self.root):
                return


def join_blocks(a: np.ndarray, b: np.ndarray, pa_: np.ndarray, pb: np.ndarray, ca: np.ndarray,
                cb: np.ndarray, same: bool, s: Settings) -> Links:
    """``a``, ``b``: unit rows; ``pa_``, ``pb``: their leading coordinates; ``ca``, ``cb``: counts."""
    links, eps2 = Links(len(a) + len(b)), 2 - 2 * s.cosine + 1e-9
    off = 0 if same else len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i0, i1, j0, j1 = todo.pop()
        if same and j1 <= i0:
            continue
        p, q = pa_[i0:i1], pb[j0:j1]
        gap = np.maximum(0, np.maximum(p.min(0) - q.max(0), q.min(0) - p.max(0)))
        if (gap * gap).sum() > eps2:
            continue
        if i1 - i0 > s.leaf or j1 - j0 > s.leaf:
            im, jm = (i0 + i1) // 2, (j0 + j1) // 2
            rows = [(i0, im), (im, i1)] if i1 - i0 > s.leaf else [(i0, i1)]
            cols = [(j0, jm), (jm, j1)] if j1 - j0 > s.leaf else [(j0, j1)]
            todo += [(*r, *c) for r in rows for c in cols]
            continue
        hit = a[i0:i1] @ b[j0:j1].T >= s.cosine
        i, j = np.nonzero(hit)
        i, j = i + i0, j + j0
        if same:
            keep = i < j
            i, j = i[keep], j[keep]
        if len(i):
            np.add.at(links.add, i, cb[j])
            np.add.at(links.add, j + off, ca[i])
            links.join(i, j + off)
    return links


def near_duplicates(vectors: DataFrame, settings: Settings = Settings(), vec_id: str = "vec_id",
                    label: str = "label", embedding: str = "embedding") -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector."""
    s = settings
    spark = vectors.sparkSession
    given = vectors.select(F.col(f"`{vec_id}`").cast("long").alias("id"), F.col(f"`{label}`").alias("label"),
                           F.col(f"`{embedding}`").alias("v"))
    units = stage(_units(given).withColumn("key", F.when(F.col("u").isNotNull() & F.col("label").isNotNull(), F.md5("u"))))
    usable = units.filter("key is not null")
    # ids may repeat or be missing, so equal vectors of a label go by 63 bits of a hash of both
    reps = stage(usable.groupBy("label", "key").agg(
        F.min("id").alias("least"), F.count("*").alias("count"), F.first("u").alias("u"))
        .withColumn("rep", F.shiftrightunsigned(F.xxhash64("label", "key"), 1)))
    axes = spark.sparkContext.broadcast(principal_axes(reps))
    blocks = _blocks(reps, axes, s)
    pairs = _descend(blocks, s)
    found = _link(blocks, pairs, axes, s)
    parts = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    added = found.groupBy("rep").agg(F.sum("add").alias("add"))
    classes = stage(reps.select("label", "key", "rep", "count", "least").join(added, "rep", "left")
                    .join(parts.withColumnRenamed("id", "rep"), "rep", "left")
                    .select("label", "key", (F.col("count") - 1 + F.coalesce("add", F.lit(0))).alias("n_links"),
                            F.coalesce("component", "rep").alias("class"), "least"))
    named = classes.groupBy("class").agg(F.min("least").alias("component_id"))
    out = units.join(stage(classes.drop("least").join(named, "class")), ["label", "key"], "left")
    component = F.when(F.col("key").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.cast("long").alias("component_id"),
                      F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))


def _blocks(reps: DataFrame, axes, s: Settings) -> DataFrame:
    """Sorted rows cut into blocks: label, d, o (place in the sequence), n, ids, counts, u, lo, hi."""
    eps = float(np.sqrt(2 - 2 * s.cosine)) or 1e-6
    label_type = reps.schema["label"].dataType.simpleString()

    def cells(batches):
        for b in batches:
            us = b.column("u").to_pylist()
            d = [len(u) // 8 for u in us]
            rows = []
            for u, n in zip(us, d, strict=True):
                y = np.frombuffer(u) @ axes.value[n][:, :s.cells]
                rows.append(np.floor(y / eps).astype(int).tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column("label"), pa.array(d, pa.int32()), pa.array(rows, pa.list_(pa.int32())),
                 b.column("rep"), b.column("count"), b.column("u")],
                names=["label", "d", "cell", "rep", "count", "u"])

    def cut(batches):
        from pyspark import TaskContext
        task, seq = TaskContext.get().partitionId(), 0
        held, owner = [], None

        def block():
            nonlocal seq
            label, d = owner
            u = np.frombuffer(b"".join(h[2] for h in held)).reshape(-1, d)
            y = u @ axes.value[d][:, :s.leading]
            out = pa.RecordBatch.from_arrays(
                [pa.array([label], label_arrow), pa.array([d], pa.int32()), pa.array([task], pa.int32()),
                 pa.array([seq], pa.int64()), pa.array([len(held)], pa.int32()),
                 pa.array([np.array([h[0] for h in held], np.int64).tobytes()], pa.binary()),
                 pa.array([np.array([h[1] for h in held], np.int64).tobytes()], pa.binary()),
                 pa.array([u.tobytes()], pa.binary()),
                 pa.array([y.min(0).tolist()], pa.list_(pa.float64())),
                 pa.array([y.max(0).tolist()], pa.list_(pa.float64()))],
                names=["label", "d", "task", "seq", "n", "ids", "counts", "u", "lo", "hi"])
            seq += 1
            held.clear()
            return out

        label_arrow = None
        for b in batches:
            label_arrow = b.schema.field("label").type
            for label, d, rep, count, u in zip(*(b.column(c).to_pylist() for c in
                                                 ("label", "d", "rep", "count", "u")), strict=True):
                if held and ((label, d) != owner or len(held) >= s.block):
                    yield block()
                owner = (label, d)
                held.append((rep, count, u))
        if held:
            yield block()

    runs = int(reps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["label", "d", "cell", "rep"]
    sorted_ = (reps.mapInArrow(cells, f"label {label_type}, d int, cell array<int>, rep long, count long, u binary")
               .repartitionByRange(runs, *order).sortWithinPartitions(*order))
    raw = stage(sorted_.mapInArrow(
        cut, f"label {label_type}, d int, task int, seq long, n int, ids binary, counts binary, u binary, "
             "lo array<double>, hi array<double>"))
    sizes = raw.groupBy("task").agg((F.max("seq") + 1).alias("m"))
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    shift = sizes.select("task", F.coalesce(F.sum("m").over(before), F.lit(0)).alias("shift"))
    return stage(raw.join(shift, "task").withColumn("o", F.col("seq") + F.col("shift")).drop("task", "seq", "shift"))


def _descend(blocks: DataFrame, s: Settings) -> DataFrame:
    """Pairs of blocks (label, d, a <= b) whose boxes are within eps at every level."""
    boxes = blocks.select("label", "d", "o", "lo", "hi")
    top = boxes.agg(F.max("o")).first()[0]
    levels = [boxes]
    while top:
        top >>= s.fan
        below = levels[-1]
        k = min(s.leading, 16)
        low = F.array(*[F.min(F.get("lo", F.lit(i))) for i in range(k)])
        high = F.array(*[F.max(F.get("hi", F.lit(i))) for i in range(k)])
        levels.append(stage(below.groupBy("label", "d", F.shiftright("o", s.fan).alias("o"))
                            .agg(low.alias("lo"), high.alias("hi"))))
    eps2 = 2 - 2 * s.cosine + 1e-9
    pairs = levels[-1].select("label", "d", F.col("o").alias("a"), F.col("o").alias("b"))
    for boxes in levels[-2::-1]:
        kids = boxes.withColumn("up", F.shiftright("o", s.fan))
        left = kids.select("label", "d", F.col("up").alias("a"), F.col("o").alias("x"),
                           F.col("lo").alias("lo1"), F.col("hi").alias("hi1"))
        right = kids.select("label", "d", F.col("up").alias("b"), F.col("o").alias("y"),
                            F.col("lo").alias("lo2"), F.col("hi").alias("hi2"))
        gap = F.zip_with(F.zip_with("lo1", "hi2", lambda p, q: p - q),
                         F.zip_with("lo2", "hi1", lambda p, q: p - q),
                         lambda p, q: F.greatest(p, q, F.lit(0.0)))
        apart = F.aggregate(gap, F.lit(0.0), lambda t, g: t + F.coalesce(g, F.lit(0.0)) * F.coalesce(g, F.lit(0.0)))
        pairs = stage(pairs.join(left, ["label", "d", "a"]).join(right, ["label", "d", "b"])
                      .filter((F.col("x") <= F.col("y")) & (apart <= eps2))
                      .select("label", "d", F.col("x").alias("a"), F.col("y").alias("b")))
    return pairs


def _link(blocks: DataFrame, pairs: DataFrame, axes, s: Settings) -> DataFrame:
    """(rep, add, root): links of a row found in one pair of blocks, and a row it is linked to."""
    runs = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    side = {k: blocks.select(F.col("o").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("ids", "counts", "u")])
            for k in "ab"}
    loaded = (pairs.select("a", "b", "d").join(side["a"], "a").join(side["b"], "b").repartition(runs, "a", "b"))

    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                u = [np.frombuffer(r[f"u_{k}"]).reshape(-1, r["d"]) for k in "ab"]
                ids = [np.frombuffer(r[f"ids_{k}"], np.int64) for k in "ab"]
                n = [np.frombuffer(r[f"counts_{k}"], np.int64) for k in "ab"]
                y = [x @ axes.value[r["d"]][:, :s.leading] for x in u]
                same = r["a"] == r["b"]
                links = join_blocks(*u, *y, *n, same, s)
                every = ids[0] if same else np.concatenate(ids)
                at = np.flatnonzero(links.add[:len(every)])
                if len(at):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(every[at]), pa.array(links.add[at]), pa.array(every[links.root[at]])],
                        names=["rep", "add", "root"])

    return stage(loaded.mapInArrow(run, "rep long, add long, root long"))
