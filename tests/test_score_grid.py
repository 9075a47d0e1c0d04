import itertools
import math
import random

import pytest

from spark_analog import defaults
from spark_analog.queries import q_score, registry


def average_precision(points):
    tp = seen = total = 0
    for s in sorted({p[0] for p in points}, reverse=True):
        same = [y for x, y in points if x == s]
        tp, seen = tp + sum(same), seen + len(same)
        total += sum(same) * tp / seen
    return total / tp


def test_all_grid_points_equal_a_loop(spark, monkeypatch):
    rng = random.Random(6)
    parts, labels = [], []
    for entity, (segment, t) in itertools.product("ab", [(g, 10 * g + k) for g in range(2) for k in range(10)]):
        y = int(t % 10 in (4, 5, 6))
        labels.append((entity, t, y))
        for c in "xyz":
            parts.append((entity, "score", segment, c, t, rng.random() + 0.6 * y, rng.random(), rng.random(), 1))
    docs = spark.createDataFrame(parts, "entity string, role string, segment int, channel string, t long, "
                                        "residual double, memory double, agreement double, n long")
    marks = spark.createDataFrame(labels, "entity string, t long, label int")
    monkeypatch.setattr(q_score, "parts", lambda spark, sf: docs)
    monkeypatch.setattr(q_score.fx, "labels_hourly", lambda spark, sf: marks)
    truth = {(e, t): y for e, t, y in labels}
    whole, macro = {}, {}
    axes = (defaults.TOP_Q_GRID, defaults.MEMORY_GRID, defaults.AGREEMENT_GRID, defaults.SMOOTHING_GRID)
    for g, (q, m, a, w) in enumerate(itertools.product(*axes)):
        for e in "ab":
            by = {}
            for e2, _, seg, _, t, r, me, ag, _ in parts:
                if e2 == e:
                    by.setdefault((seg, t), []).append(r + m * me + a * ag)
            raw = {k: sum(sorted(v)[::-1][:max(1, math.ceil(q * len(v)))]) / max(1, math.ceil(q * len(v)))
                   for k, v in by.items()}
            points = {}
            for seg, t in raw:
                near = [raw[seg, u] for u in range(t - w + 1, t + 1) if (seg, u) in raw]
                points.setdefault(seg, []).append((round(sum(near) / len(near), 9), truth[e, t]))
            whole[e, g] = average_precision(sum(points.values(), []))
            macro[e, g] = sum(map(average_precision, points.values())) / len(points)
    got = registry.QUERIES["macro_block_auprc_all"](spark, "small").collect()
    assert {(r.entity, r.grid_id): r.objective for r in got} == pytest.approx(macro, abs=2e-6)
    assert len(got) == 2 * 960
    for r in registry.QUERIES["select_score_params_all"](spark, "small").collect():
        best = max(round(v, 9) for (e, _), v in whole.items() if e == r.entity)
        assert r.grid_id == min(g for (e, g), v in whole.items() if e == r.entity and round(v, 9) == best)
        assert (r.top_q, r.memory_weight, r.agreement_weight, r.smoothing) == list(itertools.product(*axes))[r.grid_id]


def test_blocks_pieces_and_shares_change_nothing(spark):
    from spark_analog.operators.grid_search import Sizes, grid_objectives
    rng = random.Random(2)
    rows, marks = [], []
    for entity, segment, t in itertools.product("ab", [0, 3], range(40)):
        t = t if segment == 0 else 60 + t
        marks.append((entity, t, None if t % 11 == 0 else int(rng.random() < 0.3)))
        for c in range(0 if t == 7 else 3):
            gone = rng.random() < 0.1 or t == 8
            rows.append((entity, "score", segment, t, None if gone else round(rng.random() * 4) / 4,
                         round(rng.random(), 1), None if rng.random() < 0.05 else round(rng.random(), 1)))
    parts = spark.createDataFrame(rows, "entity string, role string, segment int, t long, residual double, memory double, agreement double")
    labels = spark.createDataFrame(marks, "entity string, t long, label int")
    axes = dict(top_q=(0.2, 1.0), memory=(0.0, 0.5), agreement=(0.0, 1.0), smoothing=(1, 5))
    truth = {(e, t): y for e, t, y in marks}
    for selection in ("aggregate", "macro_block"):
        want = {}
        for g, (q, m, a, w) in enumerate(itertools.product(*axes.values())):
            for e in "ab":
                by = {}
                for e2, _, seg, t, *v in rows:
                    if e2 == e:
                        by.setdefault((seg, t), []).append(None if None in v else v[0] + m * v[1] + a * v[2])
                raw = {}
                for key, v in by.items():
                    top = sorted([x for x in v if x is not None], reverse=True)[:max(1, math.ceil(q * len(v)))]
                    raw[key] = sum(top) / len(top) if top else None
                points = {}
                for seg, t in raw:
                    near = [raw[seg, u] for u in range(t - w + 1, t + 1) if raw.get((seg, u)) is not None]
                    if truth[e, t] is not None and near:
                        points.setdefault(seg, []).append((round(sum(near) / len(near), 9), truth[e, t]))
                each = [average_precision(p) for p in points.values() if 0 < sum(y for _, y in p) < len(p)]
                want[e, g] = sum(each) / len(each) if selection == "macro_block" and len(each) > 1 else \
                    average_precision(sum(points.values(), []))
        for sizes in (Sizes(), Sizes(span=8, positives=3, blocks=2, added=2)):
            got = grid_objectives(parts, labels, selection=selection, sizes=sizes, **axes).collect()
            assert {(r.entity, r.grid_id): r.objective for r in got} == pytest.approx(want, abs=1e-9)
    one = grid_objectives(parts, labels.withColumn("label", labels.label * 0), **axes).collect()
    assert len(one) == 32 and all(r.objective is None for r in one)
    assert grid_objectives(parts.limit(0), labels, **axes).count() == 0


def test_the_query_searches_the_whole_grid_and_so_does_its_sql(spark, monkeypatch):
    import duckdb
    import pandas as pd
    rng = random.Random(4)
    columns = ["entity", "role", "segment", "channel", "t", "residual", "memory", "agreement", "n"]
    parts, labels = [], []
    for entity, t in itertools.product("ab", range(30)):
        y = int(t % 10 in (3, 4, 5, 6, 7, 8))
        labels.append((entity, t, y))
        for c in "xyz":  # only a large weight of the memory and a long average tell the marked steps from the others
            parts.append((entity, "score", 0, c, t, 3 * rng.random(), 0.7 * rng.random() + 0.5 * y, 0.0, 1))
    docs = spark.createDataFrame(parts, "entity string, role string, segment int, channel string, t long, "
                                        "residual double, memory double, agreement double, n long")
    marks = spark.createDataFrame(labels, "entity string, t long, label int")
    monkeypatch.setattr(q_score, "parts", lambda spark, sf: docs)
    monkeypatch.setattr(q_score.fx, "labels_hourly", lambda spark, sf: marks)
    got = sorted(map(tuple, registry.QUERIES["select_score_params"](spark, "small").collect()))
    assert got == sorted(map(tuple, registry.QUERIES["select_score_params_all"](spark, "small").collect()))
    assert any(r[3] > 1.0 for r in got)  # a weight that the 36 points of before didn't have
    con = duckdb.connect()
    con.register("comp", pd.DataFrame(parts, columns=columns))
    con.register("labels_h", pd.DataFrame(labels, columns=["entity", "t", "label"]))
    text = registry.ORACLE["select_score_params"]
    body = "with gridded_all as" + text.partition("gridded_all as")[2]
    assert sorted(con.execute(body).fetchall()) == got
    each = con.execute(body.partition("best as (")[0].rstrip(" ,\n") + " select entity, grid_id, auprc from grid_ap_all").fetchall()
    want = {(r.entity, r.grid_id): r.objective for r in q_score.objectives(spark, "small", "aggregate").collect()}
    assert len(each) == len(want) == 2 * 960
    assert {(e, g): v for e, g, v in each} == pytest.approx(want, abs=1e-9)
