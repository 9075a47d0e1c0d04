import random

import numpy as np
import pytest

from spark_analog.llm import cnn_toxicity as cnn
from spark_analog.llm import knn_quality as knn

DOCS = "doc_id long, text string, lang string, score double"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)] + ["the", "of", "and"] * 20
    docs, labels = [], []
    for i in range(700):
        w = [rng.choice(vocab) for _ in range(rng.randrange(8, 60))]
        bad, toxic = rng.random() < 0.3, rng.random() < 0.3
        if bad:
            w = [x.upper() + "!!" for x in w]
        if toxic:
            w[rng.randrange(len(w))] = rng.choice(["grubly", "snorkish", "plomf"])
        docs.append((i, " ".join(w), "en", 0.5))
        labels.append((i, int(not bad), int(toxic)))
    docs += [(900, None, None, None), (901, "", "xx", 0.0), (902, "word " * 30_000, "en", 1.0)]
    labels += [(None, 1, 1), (5000, 0, 1), (901, None, None)]
    return (spark.createDataFrame(docs, DOCS).repartition(3), spark.createDataFrame(labels, LABELS),
            {i: (q, t) for i, q, t in labels})


def held(rows, labels, which):
    import zlib
    return [(r.predicted, labels[r.doc_id][which]) for r in rows
            if r.doc_id < 700 and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]


def test_quality_votes(corpus):
    docs, labels, truth = corpus
    model = knn.fit(docs, labels, settings=knn.Settings(sample=300))
    assert len(model.votes) <= 300
    out, at = knn.classify(docs, model)
    assert out.columns == [*docs.columns, at]
    rows = out.selectExpr("doc_id", f"{at}.score as s", f"{at}.predicted as predicted").collect()
    assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)
    pairs = held(rows, truth, 0)
    assert np.mean([p == y for p, y in pairs]) > 0.95
    by = {r.doc_id: r.s for r in rows}
    assert by[900] == by[901] == pytest.approx(model.prior)


def test_scores_equal_a_loop_over_the_sample(corpus):
    docs, labels, _ = corpus
    model = knn.fit(docs, labels, settings=knn.Settings(sample=120, block=7))
    codes = knn.Codes(knn.term_code)
    rows = [knn.terms(r.text and r.text.encode(), codes) for r in docs.limit(40).collect()]
    s = model.settings
    for row, got in zip(rows, model.score(rows), strict=True):
        v = knn.unit(knn.weights([row], model.idf) @ model.axes)[0]
        near = sorted(((float(v @ x), -i) for i, x in enumerate(model.vectors)), reverse=True)[:s.neighbours]
        w = [max(c, 0) ** s.sharpness * model.importance[-i] for c, i in near]
        y = [model.votes[-i] for _, i in near]
        assert got == pytest.approx((np.dot(w, y) + 1e-3 * model.prior) / (sum(w) + 1e-3), abs=1e-3)


def test_toxicity_net(corpus):
    docs, labels, truth = corpus
    net = cnn.fit(docs, labels, settings=cnn.Settings(epochs=12, words=1 << 11, prefixes=1 << 8))
    out, at = cnn.classify(docs, net)
    rows = out.selectExpr("doc_id", f"{at}.score as s", f"{at}.predicted as predicted").collect()
    assert len(rows) == docs.count() and all(0 <= r.s <= 1 for r in rows)
    pairs = held(rows, truth, 1)
    assert np.mean([p == y for p, y in pairs]) > 0.95
    assert {r.doc_id: r.predicted for r in rows}[901] == 0


def test_maxima_equal_a_loop():
    s = cnn.Settings(words=50, prefixes=20, width=3, filters=4)
    net = cnn.new_net(s)
    texts = [b"a b c d".split(), b"".split(), b"x y".split()]
    w, p, starts, _ = cnn.lay_out(texts, cnn.Codes(cnn.word_code(s)), max(s.spans) - 1)
    x = net.word[w] + net.prefix[p]
    got, places = net.maxima(x, starts, where=True)
    ends = [*starts[1:], len(x)]
    for t, (a, b) in enumerate(zip(starts, ends, strict=True)):
        for i, kernel in enumerate(net.kernels):
            for f in range(s.filters):
                all_ = [sum(float(x[q + j] @ kernel[j, :, f]) for j in range(len(kernel)) if q + j < len(x))
                        for q in range(a, b)]
                assert got[t, i * s.filters + f] == pytest.approx(max(all_), abs=1e-5)
                assert places[i][t, f] == a + int(np.argmax(all_))


def test_gradient_steps_lower_the_loss():
    rng = random.Random(0)
    texts = [[rng.choice([b"u", b"v", b"w", b"z"]) for _ in range(6)] + ([b"bad"] if i % 2 else []) for i in range(40)]
    y = np.array([i % 2 for i in range(40)], float)
    s = cnn.Settings(words=97, prefixes=31, epochs=15, batch=8)
    net = cnn.train(texts, y, s)
    w, p, starts, _ = cnn.lay_out(texts, cnn.Codes(cnn.word_code(s)), 2)
    assert ((net.logits(w, p, starts) > 0) == y).mean() > 0.95


def test_thresholds_by_language():
    assert cnn._best_cut(np.array([1.0, 2.0, 3.0, 4.0]), np.array([0, 0, 1, 1.0]), 0.5) == 2.5
    assert cnn._best_cut(np.array([1.0, 1.0]), np.array([1, 1.0]), 0.5) == 0.0
    tongue = cnn.lay_out([b"der die das".split(), b"le la et".split(), b"zzz".split()],
                         cnn.Codes(cnn.word_code(cnn.Settings())), 2)[3]
    assert [cnn._NAMES[i] for i in tongue] == ["de", "fr", "other"]


@pytest.mark.parametrize("kind", ["none", "one"])
def test_without_labels_or_with_one_label(spark, corpus, no_docs, kind):
    docs = corpus[0]
    labels = spark.createDataFrame([] if kind == "none" else [(i, 1, 1) for i in range(50)], LABELS)
    net = cnn.fit(docs, labels)
    out, at = cnn.classify(docs, net, keep=["doc_id"])
    assert {r[0] for r in out.select(f"{at}.score").collect()} == {1.0 if kind == "one" else 0.0}
    model = knn.fit(docs, labels)
    out, at = knn.classify(docs, model, keep=["doc_id"])
    scores = {r[0] for r in out.select(f"{at}.score").collect()}
    assert scores == {0.5} if kind == "none" else min(scores) == pytest.approx(1.0)
    assert knn.classify(no_docs, model)[0].count() == cnn.classify(no_docs, net)[0].count() == 0
    assert len(knn.fit(no_docs, labels).votes) == 0


def test_clashing_column_names_are_kept(spark, corpus):
    labels = corpus[1]
    docs = corpus[0].limit(30).selectExpr("*", "1 as quality", "2 as toxicity", "3 as _text_bytes")
    out, at = knn.classify(docs, knn.fit(docs, labels))
    assert at == "_quality" and {r.quality for r in out.collect()} == {1}


def test_labels_of_the_held_out_fold_and_without_id_change_nothing(corpus, monkeypatch):
    from pyspark.sql import functions as F
    from spark_analog.llm.common import fold
    docs, labels, _ = corpus
    s, shares = cnn.Settings(clean=150, toxic=100, epochs=1), []
    monkeypatch.setattr(cnn, "calibrate", lambda net, texts, y, share: shares.append(share))
    hidden = F.col("doc_id").isNull() | (fold("doc_id", s.folds) == 0)
    other = labels.withColumn("toxic", F.when(hidden, F.lit(1)).otherwise(F.col("toxic")))
    for frame in (labels, other):
        cnn.fit(docs, frame, settings=s)
    seen = labels.filter(~hidden & F.col("toxic").isNotNull())
    assert shares == [pytest.approx(seen.agg(F.avg("toxic")).first()[0])] * 2


def test_the_net_learns_from_every_labelled_text(corpus, monkeypatch):
    docs, labels, _ = corpus
    s, taught = cnn.Settings(clean=30, toxic=20, epochs=1, least_steps=1, words=1 << 8, prefixes=1 << 6), []
    plain = cnn._learn_shards

    def spy(rows, *rest):
        taught.append(rows.count())
        return plain(rows, *rest)

    monkeypatch.setattr(cnn, "_learn_shards", spy)
    net = cnn.fit(docs, labels, settings=s)
    rows = cnn.labelled_codes(docs, labels, "toxic", s, "text", "doc_id")
    assert len(taught) == 2 and sum(taught) == rows.filter("not held").count() > 50
    assert set(net.cut) == set(cnn._NAMES)
    again = cnn.fit(docs.repartition(7), labels, settings=s)
    assert net.cut == again.cut and np.array_equal(net.word, again.word)


def test_only_codes_of_labelled_texts_meet_the_labels(corpus, monkeypatch):
    from pyspark.sql import functions as F
    from spark_analog.llm.common import Codes, fold
    docs, labels, _ = corpus
    s, staged, plain = cnn.Settings(), [], cnn.stage
    monkeypatch.setattr(cnn, "stage", lambda frame: staged.append(frame) or plain(frame))
    for given in (labels, labels.withColumn("doc_id", F.col("doc_id").cast("string"))):
        rows = cnn.labelled_codes(docs, given, "toxic", s, "text", "doc_id").collect()
        plan = staged[-1]._jdf.queryExecution().optimizedPlan().toString()
        assert 0 <= plan.index("Join") < plan.index("MapInArrow") < plan.index("text")  # the join is above the encoding
        codes = Codes(cnn.word_code(s))
        texts = docs.join(labels, "doc_id").filter("toxic is not null").filter(fold("doc_id", s.folds) != 0).collect()
        want = sorted((r.toxic, codes.of((r.text or "").encode().lower().split()).tobytes()) for r in texts)
        assert sorted((r.y, cnn.unpack_codes(r.codes, s).tobytes()) for r in rows) == want


def test_packed_codes_come_back():
    for s in (cnn.Settings(), cnn.Settings(words=1 << 20)):
        codes = cnn.Codes(cnn.word_code(s)).of("the la des grubly w1 ... été x".encode().split())
        packed = cnn.pack_codes(codes, s)
        assert packed.itemsize == (8 if s.words > 1 << 16 else 4)
        assert np.array_equal(cnn.unpack_codes(packed.tobytes(), s), codes)
