import numpy as np
import pytest

from spark_analog.operators import scale
from spark_analog.sources import layouts


def cells(df):
    return {(r["entity"], r["t"], r["channel"]): r["value"] for r in df.collect()}


def marks(df):
    return [r["label"] for r in df.orderBy("entity", "t").collect()]


def test_label_file_next_to_csv(spark, tmp_path):
    (tmp_path / "train.csv").write_text("timestamp_(min),f.1,f 2\n0,1,2\n1,3,\n2,5,6\n")
    (tmp_path / "test.csv").write_text("timestamp_(min),F 2,f.1\n0,7,8\n1,9,10\n")
    (tmp_path / "test_label.csv").write_text("timestamp_(min),label\n0,0\n1,1\n")
    tr, te, lb = layouts.csv_with_label_file(
        spark, *[str(tmp_path / f) for f in ("train.csv", "test.csv", "test_label.csv")], "plant")
    assert cells(tr)[("plant", 1, "f.1")] == 3 and cells(tr)[("plant", 1, "f 2")] is None
    assert cells(te)[("plant", 0, "f 2")] == 7 and cells(te)[("plant", 1, "f.1")] == 10
    assert marks(lb) == [0, 1]
    series, later = scale.join_halves(tr, te, lb)
    assert {(r["t"], r["train_stop"]) for r in later.collect()} == {(3, 3), (4, 3)}
    assert series.where("t >= train_stop").count() == 4


def test_label_column_inside_the_test_file(spark, tmp_path):
    (tmp_path / "normal.csv").write_text(" Timestamp;P1;P2;Normal/Attack\nx;1,5;2;Normal\ny;3;4;Normal\n")
    (tmp_path / "attack.csv").write_text(" Timestamp;P2;P1;Normal/Attack\nx;5;6;Normal\ny;7;8;A ttack\n")
    tr, te, lb = layouts.csv_with_label_column(
        spark, str(tmp_path / "normal.csv"), str(tmp_path / "attack.csv"), "water")
    assert cells(tr)[("water", 0, "P1")] == 15.0
    assert cells(te)[("water", 1, "P1")] == 8.0 and len(cells(te)) == 4
    assert marks(lb) == [0, 1]
    (tmp_path / "bare.csv").write_text("Timestamp,P1\nx,1\n")
    with pytest.raises(ValueError, match="no label column"):
        layouts.csv_with_label_column(spark, str(tmp_path / "normal.csv"),
                                      str(tmp_path / "bare.csv"), "w")


def test_text_files_per_machine(spark, tmp_path):
    for role, text in (("train", "1,2\n3,4\n"), ("test", "5,6\n7,8\n"), ("label", "0\n1\n")):
        (tmp_path / role).mkdir()
        for m in ("machine-1-1", "machine-2-3"):
            (tmp_path / role / f"{m}.txt").write_text(text)
    tr, te, lb = layouts.text_per_entity(
        spark, *[str(tmp_path / r / "*.txt") for r in ("train", "test", "label")],
        "(machine-[0-9]+-[0-9]+)[.]txt$")
    assert cells(tr)[("machine-2-3", 1, "channel_0")] == 3
    assert cells(te)[("machine-1-1", 0, "channel_1")] == 6
    assert marks(lb) == [0, 1, 0, 1]


def test_arrays_with_an_interval_manifest(spark, tmp_path):
    for role, n in (("train", 30), ("test", 10)):
        (tmp_path / role).mkdir()
        np.save(tmp_path / role / "P-1.npy", np.arange(2.0 * n).reshape(n, 2))
    good = tmp_path / "good.csv"
    good.write_text('chan_id,spacecraft,anomaly_sequences,class\nP-1,SMAP,"[[2, 3], [7, 7]]",x\n'
                    'P-1,MSL,"[[0, 0]]",x\n')
    args = [str(tmp_path / r / "*.npy") for r in ("train", "test")]
    tr, te, lb = layouts.arrays_with_intervals(spark, *args, str(good), "SMAP")
    assert cells(te)[("SMAP@P-1", 3, "channel_1")] == 7
    assert marks(lb) == [0, 0, 1, 1, 0, 0, 0, 1, 0, 0]
    bad = tmp_path / "bad.csv"
    bad.write_text('chan_id,spacecraft,anomaly_sequences\nP-1,SMAP,"[[2, 10]]"\n')
    with pytest.raises(ValueError, match="interval"):
        layouts.arrays_with_intervals(spark, *args, str(bad), "SMAP")
    with pytest.raises(ValueError, match="records"):
        layouts.arrays_with_intervals(spark, *args, str(bad), "MSL")
