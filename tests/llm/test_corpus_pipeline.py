import collections
import os

import numpy as np
import pytest

import corpus_pipeline as cp
from plain import jaccard_components, shingles, words
from spark_analog.llm import cnn_toxicity as cnn
from spark_analog.llm import knn_quality as knn
from spark_analog.llm import mixing, packing
from spark_analog.llm.queries import ORACLE, QUERIES
from spark_analog.operators.staging import stage

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="tables not available")


def test_stages_one_after_another(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, step in cp.STAGES:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = stage(step(spark, docs, SF))
        rows = docs.collect()
        counts.append(len(rows))
        if step is not cp.pack_sequences:
            assert docs.columns == columns
            assert all(before[r.doc_id] == r.text for r in rows)
        if step is cp.near_duplicates:
            want = jaccard_components({i: shingles(t) for i, t in before.items()})
            assert sorted(r.doc_id for r in rows) == sorted(i for i, c in want.items() if i == c)
        if step is cp.mix_sources:
            assert sum(len(words(r.text)) for r in rows) <= 1.3 * sum(len(words(t)) for t in before.values())
    assert counts[0] > counts[1] > counts[2] > 0.5 * counts[0] and counts[2] >= counts[3] > 0
    assert sum(r.length for r in rows) > 0 and {r.doc_id for r in rows} == set(before)


def test_every_stage_equals_its_plain_version(spark):
    import duckdb
    import public_tokenizers
    from tokenizers import Tokenizer
    from test_packing import expected

    def ids(frame):
        return collections.Counter(r.doc_id for r in frame.collect())

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model, s = knn.fit(docs, labels), knn.Settings()
    codes, sure, good = knn.Codes(knn.term_code), set(), set()
    for r in docs.collect():
        v = knn.unit(knn.weights([knn.terms(r.text and r.text.encode(), codes)], model.idf) @ model.axes)[0]
        near = [(float(c), i) for i, c in enumerate(model.vectors @ v)]
        near = sorted(near, key=lambda x: (-x[0], x[1]))[:s.neighbours]
        w = [max(c, 0) ** s.sharpness * model.importance[i] for c, i in near]
        score = (np.dot(w, [model.votes[i] for _, i in near]) + 1e-3 * model.prior) / (sum(w) + 1e-3)
        if abs(score - s.threshold) > 2e-3:  # a vote this near may round to either side
            sure.add(r.doc_id)
            good |= {r.doc_id} if score > s.threshold else set()
    next_ = stage(cp.quality(spark, docs, SF))
    assert {i for i in ids(next_) if i in sure} == good and len(sure) > 0.9 * docs.count()

    docs, net, clean, sure = next_, cnn.fit(next_, labels), set(), set()
    codes, pad = cnn.Codes(cnn.word_code(net.s)), max(net.s.spans) - 1
    for r in docs.collect():  # one text at a time
        w, p, starts, tongue = cnn.lay_out([(r.text or "").encode().lower().split()], codes, pad)
        score = net.score(net.logits(w, p, starts), tongue)[0]
        if abs(score - 0.5) > 1e-3:
            sure.add(r.doc_id)
            clean |= {r.doc_id} if score < 0.5 else set()
    next_ = stage(cp.toxicity(spark, docs, SF))
    assert {i for i in ids(next_) if i in sure} == clean and len(sure) > 0.9 * docs.count()

    docs = stage(cp.near_duplicates(spark, next_, SF))
    con = duckdb.connect()
    con.register("documents", docs.select("doc_id", "text", "source").toPandas())
    plan = {r[0]: (r[1], r[4]) for r in con.execute(mixing.SQL).fetchall()}
    next_ = stage(cp.mix_sources(spark, docs, SF))
    times = ids(next_)
    assert {i: size * times[i] for i, (size, _) in plan.items()} == {i: taken for i, (_, taken) in plan.items()}

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = collections.Counter((r.doc_id, *x) for r in next_.collect()
                               for x in expected(tokenizer, r.text, packing.Settings().capacity))
    packed = cp.pack_sequences(spark, next_, SF).collect()
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == want


def test_empty_table_and_null_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "a", 0), (1, "", "en", "a", 0)]):
        docs = spark.createDataFrame(rows, schema)
        left = []
        for _, step in cp.STAGES:
            docs = stage(step(spark, docs, SF))
            left.append(docs.count())
        # copies of an id are one document; texts without words take no part in the mix
        assert left == ([3, 3, 2, 0, 0] if rows else [0] * 5)


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    import sys
    sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "..", "tools"))
    import check_oracle
    message = check_oracle.compare(QUERIES[name](spark, SF), check_oracle.duck(SF), ORACLE[name])
    assert message.startswith("ok"), message


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_contract_columns(spark, name):
    want = {
        "op1": "vec_id n_links component_id kept", "op2": "doc_id piece start length ids_crc32 sequence_id offset",
        "op3": "doc_id held_out n_tokens n_known train_tokens base_score score", "op4": "doc_id held_out score predicted",
        "op5": "doc_id n_shingles component_id", "op6": "doc_id held_out score predicted",
        "op7": "page_id payload_bytes payload_digest record_type refers_to", "op8": "page_id host path rule verdict",
        "op9": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op10": "doc_id size source_size target taken",
        "op11": "doc_id leaf subroot root proof_sha256 folded_root verified", "op12": "doc_id n_lines n_dropped kept_sha256",
        "op13": "conv_id depth parent_conv_id n_convs n_children n_leaves saved_tokens ends_sha256"}
    df = QUERIES[name](spark, SF)
    kinds = dict(df.dtypes)
    assert set(want[name.split("_")[0]].split()) <= set(kinds)
    longs = "n_links component_id start length ids_crc32 sequence_id offset n_tokens n_known train_tokens n_shingles payload_bytes size source_size taken n_words " \
        "n_lines n_dropped depth parent_conv_id n_convs n_children n_leaves saved_tokens"
    assert all(kinds[c] == "bigint" for c in longs.split() if c in kinds)
    assert all(kinds[c] == "double" for c in ("score", "base_score", "target") if c in kinds)
    assert all(kinds[c] == "int" for c in ("piece", "predicted") if c in kinds)
