import itertools
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from spark_analog.llm import packing


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))


def check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def expected(tokenizer, text, capacity):
    ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
    return [(k, b, len(ids[b:b + capacity]), zlib.crc32(ids[b:b + capacity].tobytes()))
            for k, b in enumerate(range(0, len(ids), capacity))]


@pytest.mark.parametrize("settings", [packing.Settings(), packing.Settings(capacity=64, open_bins=4, merge=2)])
def test_pieces_and_places(odd_docs, tokenizer, settings):
    texts = {r.doc_id: r.text for r in odd_docs.collect()}
    texts_df = odd_docs.repartition(5)
    rows = packing.pack(texts_df, settings).collect()
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
    assert {k: sorted(v) for k, v in got.items()} == {
        k: expected(tokenizer, t, settings.capacity) for k, t in texts.items()}
    n = check(rows, settings.capacity)
    assert n <= 1.25 * -(-sum(r.length for r in rows) // settings.capacity) + 1


def test_words_alone_give_the_ids_of_the_text(tokenizer):
    ids = packing.WordIds(None)
    for text in ("It's 2024, don't|stop now é Å  x", "a<|endoftext|>b <|endoftext|>", "ΑΣ ς. Σ",
                 "가 ᆨ", "İ ß ﬁ"):
        found = text.encode().split()
        ids.learn([found])
        assert np.frombuffer(ids.of(found), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_a_word_in_another_case_or_with_other_marks_is_not_tokenised_again(tokenizer):
    ids = packing.WordIds(None)
    text = "tree tree. Tree!! TREE.*** été Été$$$ 'tree tree2 tree's"
    for _ in range(2):
        ids.learn([text.encode().split()])
    assert set(ids.known) == {b"tree", b".", b"!!", b".***", "été".encode(), "Été".encode(), b"$$$",
                              b"'tree", b"tree2", b"tree's"}
    assert np.frombuffer(ids.of(text.encode().split()), "<u4").tolist() == tokenizer.encode(
        text, add_special_tokens=False).ids


@pytest.mark.parametrize("kind", [pa.binary(), pa.large_binary()])
def test_many_texts_at_once_give_the_ids_of_each(tokenizer, kind):
    texts = ["", " \n a-b,. Ab.,\t", "x" * 100 + "! y", "<|endoftext|>!! <|ENDOFTEXT|>", "don't DON'T. 'S s'", "İ. ß_ 가!",
             "a\u0301. a\u0338 <\u0338 \u00a0b\x1cc", "\x0b\x0c\r", "中文, 中文。", "1a. a1. ..."]
    for most in (500, 3):
        words = packing.WordIds(None, most=most)
        flat, stops = words.of_texts(pa.array([b"cut", *(t.encode() for t in texts)], kind)[1:])
        got = [np.frombuffer(bytes(flat[a:b]), "<u4").tolist() for a, b in itertools.pairwise(stops)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_a_task_frees_what_others_keep_and_keeps_its_words(monkeypatch):
    cleared = []
    monkeypatch.setattr(packing.common, "KEPT", [lambda: cleared.append(1), packing.word_ids.cache_clear])
    words = packing.word_ids(None)
    packing.common.release(but=packing.word_ids.cache_clear)
    assert cleared == [1] and packing.word_ids(None) is words


def test_slices_of_texts_change_nothing(odd_docs, monkeypatch):
    docs = odd_docs.coalesce(1)
    whole = sorted(packing.pack(docs).collect())
    monkeypatch.setattr(packing, "SLICE", 1)
    assert sorted(packing.pack(docs).collect()) == whole


def test_best_fit_fills_the_fullest_that_fits_and_closes_the_fullest():
    bins = packing.BestFit(10, 2)
    assert [bins.put(n) for n in (6, 7, 3, 4)] == [(0, 0), (1, 0), (1, 7), (0, 6)]
    assert bins.open() == []
    assert [bins.put(n)[0] for n in (9, 8, 7)] == [2, 3, 4]
    assert sorted(bins.open()) == [(3, 8), (4, 7)]


def test_repeated_rows_with_ids_and_empty(spark, odd_docs, no_docs):
    two = odd_docs.filter("doc_id = 33").unionByName(odd_docs.filter("doc_id = 33")).selectExpr(
        "*", "1 as offset", "2 as ids")
    rows = packing.pack(two, with_ids=True).collect()
    assert len(rows) == 2 * len({r.piece for r in rows})
    assert all(zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length for r in rows)
    assert packing.pack(no_docs).count() == 0


def test_a_null_id_is_packed(spark):
    rows = packing.pack(spark.createDataFrame([(None, "a b")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.length, r.offset) for r in rows] == [(None, 3, 0)]
