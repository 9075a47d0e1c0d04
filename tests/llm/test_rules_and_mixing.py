import collections

import pytest
from pyspark.sql import functions as F

from plain import words
from spark_analog.llm import mixing, quality_rules as qr


def base(text):
    w = words(text)
    windows = collections.Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    again = set()
    for i in range(len(w) - 7):
        if windows[tuple(w[i:i + 8])] > 1:
            again.update(range(i, i + 8))
    lines = (text or "").split("\n")
    twice = sum(1 for i, x in enumerate(lines) if words(x) and x in lines[:i])
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), twice, len(again),
            len(w) < 20 or 100 * len(again) > 30 * len(w))


def test_base_figures(odd_docs):
    judged, at = qr.clean(odd_docs)
    rows = judged.select("doc_id", "text", f"{at}.*").collect()
    assert len(rows) == odd_docs.count()
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(r.text)
        assert not (r.kept and r.base_failed)


@pytest.mark.parametrize(("line", "fault"), [
    ("A plain sentence of words.", None), ("a long line of prose without any mark at its end", None),
    ("Home", "navigation"), ("home | news | contact us now", "navigation"), ("© 2024 Someone", "boilerplate"),
    ("We use cookies to serve you.", "boilerplate"), ("a% b$ c# d& e*", "symbols"),
    ("BUY!! NOW!! THIS!! IS!! IT!!", "marks"), ("two words", "punctuation"), ("Yes, it is.", None)])
def test_line_rules(line, fault):
    assert qr.line_fault(line.encode(), line.encode().split(), qr.Rules()) == fault


def test_bad_lines_go_and_documents_losing_too_much(spark, no_docs):
    good = "\n".join(f"this{i} is{i} good{i} line number {i} of{i} the text." for i in range(9))
    docs = spark.createDataFrame([(1, f"home | a | b\n{good}", 0), (2, f"{good}\n" + "menu | x | y | z\n" * 40, 0),
                                  (1, good, 1)], "doc_id long, text string, kept int")
    judged, at = qr.clean(docs)
    got = {(r.doc_id, r.kept): r[at] for r in judged.collect()}
    assert got[1, 0].clean_text == good and got[1, 0].kept and got[1, 0].n_bad_lines == 1
    assert not got[2, 0].kept and got[1, 1].kept
    assert qr.clean(no_docs)[0].count() == 0


def fill(sizes, weights, cap):
    """Water-filling, one excess after another."""
    total, capped = sum(sizes), set()
    while True:
        rest = total - sum(cap * sizes[i] for i in capped)
        wide = sum(weights[i] for i in range(len(sizes)) if i not in capped)
        target = [cap * sizes[i] if i in capped else rest * weights[i] / wide for i in range(len(sizes))]
        over = {i for i in range(len(sizes)) if i not in capped and target[i] > cap * sizes[i]}
        if not over:
            return target
        capped |= over


def test_targets_equal_plain_water_filling(spark):
    sizes = [5, 1000, 3, 40, 0, 700, 1]
    rows = [(f"s{i}" if i else None, n) for i, n in enumerate(sizes)]
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(rows, "source string, size long"), mixing.Settings()).collect()}
    names = sorted(f"s{i}" for i in range(1, 7)) + [None]
    by = dict(rows)
    want = fill([by[n] for n in names], [(i % 3) + 1.0 for i in range(7)], 3)
    assert [got[n] for n in names] == pytest.approx(want)


def test_taken_words_come_near_the_target(odd_docs):
    rows = mixing.mix(odd_docs).collect()
    again = mixing.mix(odd_docs.repartition(2)).collect()
    key = lambda r: (r.doc_id, r.taken)
    assert sorted(map(key, rows)) == sorted(map(key, again))
    assert {r.doc_id: r.size for r in rows} == {r.doc_id: len(words(r.text)) for r in odd_docs.collect()}
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    for source in {r.source for r in rows}:
        own = [r for r in rows if r.source == source]
        taken = sum(r.taken for r in own)
        off, sizes = abs(taken - own[0].target), sorted(r.size for r in own)
        assert off <= max(sizes[-1] / 2, 60), (source, taken, own[0].target, sizes)


def test_applied_mix_repeats_rows_and_keeps_columns(spark, odd_docs, no_docs):
    docs = odd_docs.selectExpr("*", "1 as whole", "2 as _mix_n", "3 as size")
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    times = {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()}
    assert times == {r.doc_id: r.copies for r in mixing.mix(docs).collect() if r.copies}
    assert mixing.mix(no_docs).count() == mixing.apply(no_docs).count() == 0
    same = spark.createDataFrame([(1, "a b", "s"), (1, "a b", "s"), (None, None, None)], "doc_id long, text string, source string")
    assert sorted((r.size, r.taken) for r in mixing.mix(same).collect()) == [(0, 0), (2, 2), (2, 2)]


def test_no_python_in_the_plan(odd_docs):
    plan = mixing.mix(odd_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
    assert F.lit(1) is not None
