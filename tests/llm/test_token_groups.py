import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import jaccard_components, shingles
from spark_analog.llm import token_groups as tg


@pytest.mark.parametrize("settings", [
    tg.Settings(), tg.Settings(group_tokens=200, hot=2, local_hot=1, bitmap_bits=512),
    tg.Settings(group_tokens=1, hot=10 ** 9), tg.Settings(percent=50, most_hot=3, hot=2, local_hot=1, slice_tokens=50)])
def test_equals_all_pairs(odd_docs, settings):
    sets = {r.doc_id: shingles(r.text) for r in odd_docs.collect()}
    want = jaccard_components(sets, settings.percent)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in tg.duplicates(odd_docs, settings).collect()}
    assert got == {i: (len(s), want[i]) for i, s in sets.items()}


def test_a_passage_shared_by_many_and_a_large_family(spark):
    rng = np.random.default_rng(2)
    words = [f"v{i}" for i in range(4000)]
    pick = lambda n: [words[i] for i in rng.integers(len(words), size=n)]
    passage, family = pick(40), pick(60)
    rows = [(i, " ".join(passage + pick(int(rng.integers(5, 30))))) for i in range(60)]
    for i in range(60):
        near = list(family)
        near[int(rng.integers(60))] = "other"
        rows.append((100 + i, " ".join(near)))
    rows += [(200 + i, " ".join(family)) for i in range(20)]
    rows.append((300, " ".join(passage)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    s = tg.Settings(group_tokens=300, hot=5, local_hot=2)
    want = jaccard_components({i: shingles(t) for i, t in rows})
    assert {r.doc_id: r.component_id for r in tg.duplicates(docs, s).collect()} == want


def test_threshold_is_exact():
    assert tg.similar(3, 4, 3, 75) and not tg.similar(2, 3, 3, 75)
    assert [tg.least_overlap(n, 75) for n in (1, 3, 4, 100)] == [1, 3, 3, 75]


def test_repeated_rows_null_ids_clashing_columns_and_empty(spark, no_docs):
    rows = [(1, "a b c d e f", 0), (1, "a b c d e f", 0), (None, "a b c d e f", 0), (2, "A b C d e f", 0), (3, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in tg.duplicates(docs).collect()), key=str)
    assert got == [(1, 2, 1), (1, 2, 1), (2, 2, 1), (3, 0, 3), (None, 2, None)]
    assert tg.duplicates(no_docs).count() == 0


def test_a_passage_in_a_third_of_all_documents_makes_no_pairs(spark, monkeypatch):
    """A template of 75 to 85 % of the shingles of 1,000 of 3,000 documents."""
    rng = np.random.default_rng(6)
    pick = lambda n: " ".join(f"v{i}" for i in rng.integers(50_000, size=n))
    template = pick(120)
    rows = [(i, pick(int(rng.integers(20, 60)))) for i in range(2000)]
    rows += [(2000 + i, template + " " + pick(int(rng.integers(21, 40)))) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    made = []

    def counted(frame, *keys, then=()):
        if "part" in keys:
            made.append(frame.count())
        return by_group(frame, *keys, then=then)

    by_group, pairs_of, pairs = tg._by_group, tg._pairs, []
    monkeypatch.setattr(tg, "_by_group", counted)
    monkeypatch.setattr(tg, "_pairs", lambda *a: pairs.append(pairs_of(*a)) or pairs[-1])
    got = {r.doc_id: r.component_id for r in tg.duplicates(docs, tg.Settings(crowded=8)).collect()}
    assert got == jaccard_components({i: shingles(t) for i, t in rows})
    assert pairs[0].count() < 20_000 and made[0] < 50_000  # of 500,000


def test_late_rows_meet_early_ones():
    n, place = np.arange(1, 400)[:, None], np.arange(100)[None]
    cap = tg.largest_partner(n, place, 75)
    for m in (1, 7, 60, 399):
        need = -(-75 * (n + m) // 175)
        assert ((cap >= m) == (n - place >= need)).all()


def test_every_text_of_an_id_is_compared(spark):
    a, b = "a b c d e f g h", "z y x w v u t s"
    rows = [(1, a), (1, b), (2, b), (3, a + " i"), (4, "q r s t u v"), (None, a), (None, b)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id) for r in tg.duplicates(docs).collect()), key=str)
    assert got == [(1, 1), (1, 1), (2, 1), (3, 1), (4, 4), (None, None), (None, None)]
    rows, found = tg.classes(docs)
    by_set = {r.sid: r["class"] for r in found.collect()}
    assert sorted(collections.Counter(by_set.values()).values()) == [1]  # one id doesn't tie its texts here


def test_one_of_each_class_stays_whatever_the_ids(spark, no_docs):
    a, b = "a b c d e f g h", "z y x w v u t s"
    rows = [(1, a, 5), (1, b, 2), (2, b, 1), (3, a + " i", 0), (1, a.upper(), 1), (1, a, 4), (None, a, 0), (None, a, 0),
            (7, "", 1), (7, None, 1), (8, " ", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _kept_id int")
    for c in ("sid", "row", "n", "class", "token_set"):
        docs = docs.withColumn(c, F.lit("x"))
    got = tg.one_of_each(docs)
    assert got.columns == docs.columns
    left = sorted((tuple(r)[:3] for r in got.collect()), key=str)
    assert left == sorted([(1, a.upper(), 1), (1, b, 2), (None, a, 0), (None, a, 0), (7, None, 1), (8, " ", 3)], key=str)
    assert tg.one_of_each(no_docs).count() == 0
