import json
import os

import numpy as np
import pytest

from spark_analog.operators import clean
from spark_analog.sources import files


@pytest.mark.parametrize("encoding,sep,bom", [("utf-8", ",", True), ("utf-8", ";", False),
                                              ("latin-1", ";", False)])
def test_tolerant_csv(spark, tmp_path, encoding, sep, bom):
    text = sep.join(["Timestamp", "Pümp 1", "Label"]) + "\n" + sep.join(["0", "1", "Normal"]) + "\n"
    data = text.encode(encoding)
    (tmp_path / "a.csv").write_bytes((b"\xef\xbb\xbf" if bom else b"") + data)
    df = files.read_wide_csv(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["Timestamp", "Pümp 1", "Label"]
    assert clean.drop_time_columns(df).columns == ["Pümp 1", "Label"]
    assert df.first()[1] == "1"


def test_thousands_and_bad_numbers(spark):
    df = spark.createDataFrame([(" 1,250.5 ",), ("n/a",), ("inf",), ("NaN",), (None,)], "s string")
    assert [r[0] for r in df.select(clean.number("s")).collect()] == [1250.5, None, None, None, None]


def test_headerless_text_keeps_row_order_over_splits(spark, tmp_path):
    n = 5000
    for e in ("machine-1-1", "machine-1-2"):
        np.savetxt(tmp_path / f"{e}.txt", np.column_stack([np.arange(n), -np.arange(n)]),
                   delimiter=",", fmt="%.1f")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        df = files.read_headerless(spark, str(tmp_path / "*.txt"), 2, "(machine-[0-9]+-[0-9]+)")
        wide = clean.to_wide(df, ["entity", "t"], ["channel_0", "channel_1"])
        assert wide.count() == 2 * n
        assert wide.where("channel_0 <> t or channel_1 <> -t").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_npy_files_and_orientation(spark, tmp_path):
    tall, wide = np.arange(600.0).reshape(300, 2), np.arange(80.0).reshape(4, 20)
    np.save(tmp_path / "P-1.npy", tall)
    np.save(tmp_path / "P-2.npy", wide)
    for axis in (0, 1):
        got = {(r["entity"], r["t"], r["channel"]): r["value"] for r in files.read_npy(
            spark, str(tmp_path / "*.npy"), "/([^/]+)[.]npy$", time_axis=axis).collect()}
        assert len(got) == 680
        pick = lambda a, t, c: a[t, c] if axis == 0 else a[c, t]  # noqa: B023,E731
        assert got[("P-1", 1, "channel_0")] == pick(tall, 1, 0)
        assert got[("P-2", 3, "channel_2")] == pick(wide, 3, 2)


def test_discovery_reports_incomplete_entities(spark, tmp_path):
    for role, names in (("train", "ab"), ("test", "ab"), ("test_label", "a")):
        os.makedirs(tmp_path / role)
        for n in names:
            (tmp_path / role / f"machine-{n}.txt").write_text("1,2\n")
    got = {r["entity"]: r["complete"] for r in files.discover(
        spark, str(tmp_path), "/(train|test|test_label)/(machine-[a-z])[.]txt$").collect()}
    assert got == {"machine-a": True, "machine-b": False}


def test_interval_manifest(spark):
    points = spark.range(10).selectExpr("'e' as entity", "id as t")
    m = spark.createDataFrame([("e", "[[2, 3], [3, 5]]"), ("f", "[[0, 0]]"), ("f", "[[1, 99]]")],
                              "entity string, anomaly_sequences string")
    got = files.interval_labels(points, m.where("entity = 'e'")).orderBy("t").collect()
    assert [r["label"] for r in got] == [0, 0, 1, 1, 1, 1, 0, 0, 0, 0]
    n = spark.createDataFrame([("e", 10), ("f", 50)], "entity string, n bigint")
    assert {tuple(r) for r in files.manifest_checks(m, n).collect()} == {
        ("f", "records"), ("f", "interval")}


def test_ledger_ignores_broken_lines_and_nulls_nan(spark, tmp_path):
    lines = [json.dumps({"k": 1, "m": {"auprc": 0.5}}), "{broken", "", json.dumps({"k": 2})]
    (tmp_path / "l.jsonl").write_text("\n".join(lines))
    ok, bad = files.read_ledger(spark, str(tmp_path / "l.jsonl"), "k bigint, m struct<auprc:double>")
    assert sorted((r["k"], r["m"] and r["m"]["auprc"]) for r in ok.collect()) == [(1, .5), (2, None)]
    assert [r["line"] for r in bad.collect()] == ["{broken"]
    df = spark.createDataFrame([(1, float("nan")), (2, float("inf")), (3, 1.0)], "k int, v double")
    out = str(tmp_path / "out")
    files.append_rows(df.where("k < 3"), out, "json")
    files.append_rows(df.where("k = 3"), out, "json")
    back = spark.read.schema("k int, v double").json(out).orderBy("k").collect()
    assert [r["v"] for r in back] == [None, None, 1.0]
    with pytest.raises(ValueError, match="missing columns"):
        files.require_columns(df, ["k", "z"])
    with pytest.raises(ValueError, match="no rows"):
        files.require_columns(df.where("k > 5"), ["k"])
