import math
import random

import numpy as np
import pytest

from spark_analog.llm import grid_order_join as gj

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, cosine=0.93):
    usable = {}
    for i, v, label in rows:
        if i is not None and v and label is not None and all(c is not None and math.isfinite(c) for c in v) and any(v):
            x = np.array(np.array(v, np.float32), float)
            usable[i] = (label, x / np.sqrt((x * x).sum()))
    up, links = {i: i for i, _, _ in rows}, {i: 0 for i, _, _ in rows}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(usable)
    for a in ids:
        for b in ids:
            (la, x), (lb, y) = usable[a], usable[b]
            if a < b and la == lb and len(x) == len(y) and float(x @ y) >= cosine:
                links[a] += 1
                links[b] += 1
                p, q = find(a), find(b)
                up[max(p, q)] = min(p, q)
    return {i: (links[i], find(i)) for i in up}


def vectors(seed=5, n=260, d=8):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        v = rng.standard_normal(d)
        if rows and rng.random() < 0.6:
            v = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(d) * rng.choice([0, 0.1, 0.4])
        rows.append((i, [float(np.float32(c)) for c in v], int(rng.integers(3))))
    return rows


@pytest.mark.parametrize("settings", [gj.Settings(), gj.Settings(block=16, leaf=4, fan=1, leading=3, cells=2)])
def test_equals_all_pairs(spark, settings):
    rows = vectors()
    rows += [(1000, None, 1), (1001, [0.0] * 8, 1), (1002, [1.0, None] * 4, 1), (1003, [float("nan")] * 8, 1),
             (1004, [float("inf")] + [0.0] * 7, 1), (1005, rows[0][1], None), (1006, [], 1),
             (1007, rows[0][1][:5], rows[0][2]), (1008, [c * 1e-30 for c in rows[0][1]], rows[0][2])]
    rows += [(2000 + i, rows[3][1], rows[3][2]) for i in range(60)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = {r.vec_id: (r.n_links, r.component_id) for r in gj.near_duplicates(df, settings).collect()}
    assert got == brute(rows)


def test_repeated_rows_clashing_columns_and_empty(spark):
    rows = [(1, [1.0, 0.0], 1, 9), (1, [1.0, 0.0], 1, 8), (2, [1.0, 0.01], 1, 7), (None, [1.0, 0.0], 1, 0)]
    df = spark.createDataFrame(rows, SCHEMA + ", n_links long")
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in gj.near_duplicates(df).collect()), key=str)
    assert got == [(1, 3, 1, True), (1, 3, 1, True), (2, 3, 1, False), (None, 3, 1, False)]
    assert gj.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_every_row_is_compared_whatever_its_id(spark):
    rows = [(None, [1.0, 0.0], 1), (None, [0.0, 1.0], 1), (1, [1.0, 0.02], 1), (1, [0.7, -0.7], 1), (2, [0.71, -0.7], 1),
            (5, [-1.0, 0.0], 1), (None, [-1.0, 0.01], 1), (None, [0.0, 0.0], 1), (None, [1.0, 0.0], 2), (7, None, 1)]
    got = sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in
                  gj.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()), key=str)
    assert got == sorted([(None, 1, 1, False), (None, 0, None, False), (1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False),
                          (5, 1, 5, True), (None, 1, 5, False), (None, 0, None, False), (None, 0, None, False),
                          (7, 0, 7, True)], key=str)


def test_forest_keeps_links_of_earlier_leaves():
    links = gj.Links(10)
    links.join(np.array([5]), np.array([9]))
    links.join(np.array([1, 3]), np.array([5, 9]))
    assert links.root[[1, 3, 5, 9]].tolist() == [1, 1, 1, 1]
    rng = np.random.default_rng(2)
    for _ in range(200):
        links, up = gj.Links(40), list(range(40))
        for _ in range(6):
            i, j = rng.integers(40, size=(2, 5))
            links.join(i, j)
            for a, b in zip(i.tolist(), j.tolist(), strict=True):
                p, q = sorted((up[a], up[b]))
                up = [p if u == q else u for u in up]
        assert links.root.tolist() == up


def test_long_chains_with_default_block_and_leaf(spark):
    rng = np.random.default_rng(9)
    rows, place = [], 0
    for chain in range(8):
        x = rng.standard_normal(24)
        for _ in range(125):  # each step of a walk links with its neighbours only
            x = x / np.linalg.norm(x) + rng.standard_normal(24) * 0.075
            rows.append((place, [float(np.float32(c)) for c in x], 1))
            place += 1
    ids = rng.permutation(len(rows)).tolist()
    rows = [(ids[i], v, label) for i, v, label in rows]
    got = {r.vec_id: (r.n_links, r.component_id) for r in gj.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == brute(rows)
