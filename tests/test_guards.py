import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_analog.operators import fuse, ledger
from spark_analog.operators.clean import label_column
from spark_analog.plans.ablation import components
from spark_analog.plans.detect import Settings, detect
from spark_analog.plans.guards import guards
from spark_analog.sources import files, layouts

S = Settings(context=12, horizon=3, train_stop=300, size=16, k=3, label_block=30)


def frames(spark, lengths, skip=()):
    rng = np.random.default_rng(1)
    cells = [(e, t, c, float(rng.normal())) for e, n in lengths.items() for t in range(n) for c in ("a", "b")
             if (e, c) not in skip or t >= S.train_stop]
    marks = [(e, t, int(t % 37 == 0)) for e, n in lengths.items() for t in range(n)]
    return (spark.createDataFrame(cells, "entity string, t bigint, channel string, value double"),
            spark.createDataFrame(marks, "entity string, t bigint, label int"))


def test_a_short_entity_raises_by_name(spark):
    series, labels = frames(spark, {"long": 460, "short": 310})
    with pytest.raises(ValueError, match="short: no test block"):
        detect(series, labels, S)


def test_the_ablation_raises_too(spark):
    series, labels = frames(spark, {"long": 460, "short": 310})
    with pytest.raises(ValueError, match="short: no test block"):
        components(series, labels, S)


def test_a_channel_without_training_values_raises(spark):
    series, labels = frames(spark, {"x": 460}, {("x", "b")})
    with pytest.raises(ValueError, match="x: channel in one half only; x: channel without training value"):
        detect(series, labels, S)


def test_every_reason(spark):
    series, labels = frames(spark, {"ok": 460, "y": 460})
    found = guards(series, labels.where("entity = 'ok' or t < 400"), F.lit(300), 12, 3, 30)
    assert [tuple(r) for r in found.collect()] == [("y", "labels do not match steps")]
    tight = guards(series, labels, F.lit(60), 12, 3, 30)
    assert {r.reason for r in tight.collect()} == {"training too short"}


def test_stride_thins_test_windows_only(spark):
    series, labels = frames(spark, {"x": 460})
    whole = detect(series, labels, S).where("score is not null").count()
    from dataclasses import replace
    thin = detect(series, labels, replace(S, stride=7))
    assert 0 < thin.where("score is not null").count() < whole
    assert thin.count() == detect(series, labels, S).count()


def test_text_files_of_different_width_keep_all_channels(spark, tmp_path):
    (tmp_path / "m1.txt").write_text("1,2\n" * 100)
    (tmp_path / "m2.txt").write_text("1,2,3,4\n5,6,7,8\n")
    got = files.read_headerless(spark, str(tmp_path / "*.txt"), None, "/([^/]+)[.]txt$")
    assert {r.entity: r["count"] for r in got.groupBy("entity").count().collect()} == {"m1": 200, "m2": 8}
    (tmp_path / "m3.txt").write_text("1,2\n3\n")
    with pytest.raises(Exception, match="has 1 values, not 2"):
        files.read_headerless(spark, str(tmp_path / "m3.txt"), None, "/([^/]+)[.]txt$").collect()
    assert layouts.text_per_entity


def test_more_methods_than_the_published_table(spark):
    assert ledger.range_quantile(10) == pytest.approx(3.164, abs=1e-3)
    assert ledger.range_quantile(20) == pytest.approx(3.544, abs=1e-3)
    table = dict(ledger.NEMENYI_Q05)
    ledger.NEMENYI_Q05.clear()
    try:
        for k, q in table.items():
            assert ledger.range_quantile(k) == pytest.approx(q, abs=1.1e-3)
    finally:
        ledger.NEMENYI_Q05.update(table)
    ranks = spark.createDataFrame([(f"m{i:02d}", float(i), 30) for i in range(1, 13)], "method string, avg_rank double, n bigint")
    pairs = ledger.nemenyi(ranks).collect()
    assert len(pairs) == 66 and all(p.critical_difference > 0 and p.exceeds is not None for p in pairs)
    assert ledger.cd_groups(ranks).count() > 0


def test_gate_fit_says_its_steps_and_raises_without_convergence(spark):
    rng = np.random.default_rng(0)
    rows = [("e", float(x), int(x + rng.normal() > 0)) for x in rng.normal(size=80)]
    df = spark.createDataFrame(rows, "entity string, x double, y int")
    assert fuse.fit_logistic(df, ["x"], "y").first().steps > 1
    with pytest.raises(RuntimeError, match="no convergence in 1 steps"):
        fuse.fit_logistic(df, ["x"], "y", give_up=1)


def test_label_column_order():
    assert label_column(["a", "my_label", "Normal/Attack"]) is not None
    assert label_column(["x", "y"]) is None


def test_nested_values_become_json_safe(spark):
    df = spark.sql("select named_struct('a', double('NaN'), 'b', array(1.0D, double('inf'))) as s, map('k', double('NaN')) as m")
    row = files.json_safe(df).first()
    assert row.s.a is None and row.s.b == [1.0, None] and row.m == {"k": None}
