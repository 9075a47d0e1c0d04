import zlib
from hashlib import md5

import numpy as np
import pytest
from pyspark.sql import functions as F

from spark_analog.llm import cnn_toxicity as cnn
from spark_analog.llm import knn_quality as knn
from spark_analog.llm import labelled, url_filters


def plain_ids(labels, y, most):
    kept = [i for i, v in labels if v == y and zlib.crc32(str(i).encode()) % 5]
    return set(sorted(kept, key=lambda i: md5(str(i).encode()).hexdigest())[:most])


@pytest.mark.parametrize("most", [0, 7, 400, 10_000])
def test_ids_are_the_smallest_hashes(spark, most):
    labels = [(i, int(i % 3 == 0)) for i in range(6000)]
    frame = spark.createDataFrame(labels + [(None, 1), (9999, None)], "doc_id long, toxic int").repartition(16)
    got = labelled.training_ids(frame, "toxic", {0: most, 1: most}).collect()
    for y in (0, 1):
        assert {r.id for r in got if r.y == y} == plain_ids(labels, y, most)


def test_what_tasks_hand_on_is_near_the_sample(spark):
    limit = labelled._hash_limit(400, 100_000)
    seen = sum(md5(str(i).encode()).hexdigest() < limit for i in range(100_000))
    assert 400 <= seen < 1200
    assert labelled._hash_limit(400, 0) == labelled._hash_limit(400, 300) == "g"


def test_one_row_per_id_and_no_text_above_the_share(spark):
    docs = [(1, f"text {i}") for i in range(5000)] + [(2, "x" * 101), (3, "y" * 100), (4, None), (4, None), (5, ""),
                                                      (6, "é" * 51), (None, "z"), (7, "b" * 200), (7, "short")]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    ids = spark.createDataFrame([(i, i % 2) for i in range(1, 8)], "id long, y int")
    runs = [labelled.training_texts(frame.repartition(n), ids, 100).collect() for n in (3, 11)]
    first, second = ({r.id: (r.y, r.text) for r in rows} for rows in runs)
    assert all(len(rows) == 5 for rows in runs) and first == second
    assert first[3] == (1, "y" * 100) and first[4] == (0, None) and first[5] == (1, "") and first[7] == (1, "short")
    assert first[1][1].startswith("text ") and 2 not in first and 6 not in first


def test_an_id_with_many_rows_is_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"good words {i}") for i in range(3000)] + [(i, f"BAD!! {i}") for i in range(2, 12)],
                                 "doc_id long, text string").repartition(5)
    labels = spark.createDataFrame([(i, int(i == 1), int(i != 1)) for i in range(1, 12)], "doc_id long, quality int, toxic int")
    assert len(knn.fit(docs, labels).votes) <= 11
    net = cnn.fit(docs, labels)
    out, at = cnn.classify(docs, net)
    assert out.count() == 3010


def test_bounds_of_runs_come_from_a_sample(spark):
    rows = spark.range(60_000, numPartitions=12).select("id", F.concat(F.lit("com.h"), F.col("id") % 977).cast("binary").alias("k"))
    for frame in (rows, rows.withColumn("id", F.lit(None).cast("long")), rows.withColumn("k", F.lit("one").cast("binary"))):
        bounds = url_filters._bounds(frame, 60_000, 8)
        assert bounds == sorted(bounds) and len(bounds) in (0, 7)
    full = url_filters._bounds(rows, 60_000, 8)
    keys = np.array(sorted(r.k.decode() for r in rows.select("k").collect()))
    sizes = np.diff([0, *np.searchsorted(keys, [b.decode() for b in full]), len(keys)])
    assert sizes.max() < 2 * 60_000 / 8
    assert url_filters._bounds(rows.limit(0), 0, 8) == []
    few = url_filters._bounds(rows.filter("id < 20"), 20, 4)
    assert len(few) == 3
