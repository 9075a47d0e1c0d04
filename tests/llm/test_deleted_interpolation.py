import collections
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import lower_words
from spark_analog.llm import deleted_interpolation as di
from spark_analog.llm.common import fold


def parts(doc_id="doc_id"):
    text = F.concat(F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.lit("/weights"))
    return fold(doc_id, 10) != 0, F.crc32(text.cast("binary")) % 10 == 0


@pytest.mark.parametrize(("order", "chunk", "range_keys"), [(2, 300, 100), (2, 10 ** 6, 10 ** 6), (3, 500, 50)])
def test_equals_plain_counts(odd_docs, monkeypatch, order, chunk, range_keys):
    learned = {}
    plain = di.learn_weights

    def spy(tuples, s, unseen):
        learned["w"], learned["steps"] = plain(tuples, s, unseen)
        return learned["w"], learned["steps"]

    monkeypatch.setattr(di, "learn_weights", spy)
    s = di.Settings(order=order, chunk=chunk, range_keys=range_keys)
    got = {r.doc_id: r for r in di.score(odd_docs, *parts(), s).collect()}
    texts = {r.doc_id: [*lower_words(r.text), "</s>"] for r in odd_docs.collect()}
    teaches = [i for i in texts if zlib.crc32(str(i).encode()) % 10]
    counts = collections.Counter()
    for i in teaches:
        w = texts[i]
        for k in range(len(w)):
            for n in range(1, order + 1):
                h = tuple((["<s>"] + w)[max(0, k + 2 - n):k + 1]) if n > 1 else ()
                counts[n, (*h, w[k])] += 1
    total = sum(len(texts[i]) for i in teaches)
    v = sum(1 for n, _ in counts if n == 1)
    counts[1, ("<s>",)] = len(teaches)
    assert len(got) == len(texts)
    for i, w in texts.items():
        base = sum(math.log10((counts[1, (x,)] + 0.1) / (total + 0.1 * (v + 1))) for x in w)
        full = 0.0
        for k, x in enumerate(w):
            p, longest = [], None
            for n in range(order, 0, -1):
                h = tuple((["<s>"] + w)[max(0, k + 2 - n):k + 1]) if n > 1 else ()
                seen = total if n == 1 else counts[len(h), h]
                longest = seen if longest is None else longest
                p.append(counts[n, (*h, x)] / seen if seen else 0.0)
            row = learned["w"][int(math.log2(longest + 1))]
            full += math.log10(float(np.dot(row, [*p, 1 / (v + 1)])))
        r = got[i]
        assert (r.n_tokens, r.train_tokens) == (len(w), total)
        assert r.n_known == sum(counts[1, (x,)] > 0 for x in w)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score == pytest.approx(full, rel=1e-9)


def test_weights_are_a_fixed_point_of_the_maximisation(spark):
    rows = [(3, 10, 5, 100, 4), (0, 10, 7, 100, 9), (0, 0, 2, 100, 3), (8, 10, 1, 100, 2)]
    tuples = spark.createDataFrame(rows, "c2 long, t2 long, c1 long, t1 long, times long")
    s = di.Settings(tolerance=1e-13)
    w, steps = di.learn_weights(tuples, s, 0.01)
    assert steps > 3
    x = np.array(rows, float)
    k = di.bucket(x[:, 1])
    p = w[k] * di.likelihoods([(x[:, 0], x[:, 1]), (x[:, 2], x[:, 3])], 0.01)
    post = p / p.sum(1, keepdims=True) * x[:, 4:]
    for b in set(k):
        again = post[k == b].sum(0) / x[k == b, 4].sum()
        assert again == pytest.approx(w[b], abs=1e-4)


def test_empty_and_untaught(spark, no_docs):
    assert di.score(no_docs, *parts()).count() == 0
    docs = spark.createDataFrame([(1, "a b", 5), (1, "a b", 6), (2, None, 7)], "doc_id long, text string, score int")
    rows = di.score(docs, F.lit(False), F.lit(False)).collect()
    assert sorted((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in rows) == [(1, 3, 0, 0), (1, 3, 0, 0), (2, 1, 0, 0)]
    assert all(math.isfinite(r.score) for r in rows)


def test_packed_numbers_come_back():
    x = np.sort(np.array([0, 1, 1 << 40, (1 << 64) - 1], np.uint64))
    assert di.unpack_sorted(di.pack_sorted(x)).tolist() == x.tolist()
    assert di.unpack(di.pack(np.empty(0, np.int64))).tolist() == []
