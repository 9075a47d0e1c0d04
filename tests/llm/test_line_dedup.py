import collections
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from plain import LOWER
from spark_analog.llm import line_dedup
from spark_analog.llm.queries import op12

SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain(rows, least=20, documents=3):
    """(doc_id, n_lines, n_dropped, kept text) of every (doc_id, text)."""
    inside = collections.defaultdict(set)
    key = lambda line: line.strip(SPACE).translate(LOWER)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= least:
                inside[key(line)].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(inside[key(x)]) < documents
                or i == max(inside[key(x)], key=lambda d: (d is not None, d or 0))]
        out.append((i, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def cleaned(df, settings=line_dedup.Settings()):
    found, at = line_dedup.clean(df, settings)
    assert found.columns == [*df.columns, at]
    return sorted([(r.doc_id, r[at].n_lines, r[at].n_dropped, r[at].text) for r in found.collect()], key=repr)


def line_docs():
    rng = random.Random(8)
    pool = [f"Line {i} of the POOL, with é and more" for i in range(60)]
    rows = [(k, None if k == 7 else "\n".join(rng.choice([rng.choice(pool), "  " + rng.choice(pool).upper() + "\t", "short",
            "", f"only here {k} {rng.random()}"]) for _ in range(rng.randrange(9)))) for k in range(-5, 60)]
    rows += [(k, "A header that is in very many of the documents\nrest " + str(k)) for k in range(100, 300)]
    rows += [(None, pool[0] + "\n" + pool[1]), (None, pool[0]), (3, pool[2] + "\n" + pool[2]), (3, None), (3, "")]
    rows += [(400, "x" * 19), (401, "x" * 19), (402, "x" * 19), (403, "é" * 20), (404, "é" * 20), (405, " " + "é" * 20 + "\r"),
             (406, "É" * 20), (500, ("y" * 40 + "\n") * 3000), (501, "Y" * 40), (502, "z\n" + "y" * 40)]
    return rows


def test_equals_plain_version_whatever_the_shards(spark):
    rows = line_docs()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).repartition(4)
    want = plain(rows)
    assert cleaned(df) == want
    assert cleaned(df, line_dedup.Settings(shard_keys=7, askers=5)) == want
    assert any(d for _, _, d, _ in want) and any(t == "" and n for _, n, _, t in want)
    assert cleaned(df, line_dedup.Settings(documents=2, least_chars=1)) == plain(rows, 1, 2)


def test_odd_texts_clashing_columns_and_no_rows(spark, odd_docs, no_docs):
    df = odd_docs
    for c in ("a", "b", "doc", "shard", "copy", "kind", "keeper", "lost", "line_dedup", "_body", "_own", "_lost_by", "_LOST_A"):
        df = df.withColumn(c, F.lit("x"))
    assert cleaned(df) == plain([(r.doc_id, r.text) for r in odd_docs.collect()])
    assert cleaned(no_docs) == []
    short = spark.createDataFrame([(1, "a\nb", None, None, None), (2, None, None, None, None)], SCHEMA)
    assert cleaned(short) == [(1, 2, 0, "a\nb"), (2, 1, 0, "")]


def test_query_hashes_what_stays(spark, tmp_path):
    rows = line_docs()
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted([tuple(r) for r in op12(spark, str(tmp_path)).collect()], key=repr)
    assert got == sorted([(i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in plain(rows)], key=repr)


@pytest.mark.parametrize("n", [0, 1, 2, 63, 1000, 20_000])
def test_hash_is_minimal_and_perfect(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-2**63, 2**63 - 1, (2, n))
    slots = line_dedup.PerfectHash.build(a, b).slots(a, b)
    assert sorted(slots.tolist()) == list(range(n))


def test_hash_refuses_repeated_keys():
    a = np.array([1, 1, 5]), np.array([2, 2, 5])
    with pytest.raises(ValueError):
        line_dedup.PerfectHash.build(*a)


def test_shard_answers_and_knows_foreign_lines():
    rng = np.random.default_rng(2)
    a, b = rng.integers(-2**63, 2**63 - 1, (2, 9000))
    counts, keepers = rng.integers(1, 6, 3000), rng.integers(-9, 10**12, 3000)
    counts[0] = 1 << 40
    row = line_dedup.Shard.build(a[:3000], b[:3000], counts, keepers, 3)
    got, kept = line_dedup.Shard(row).probe(a, b)
    assert got[:3000].tolist() == np.minimum(counts, 2**32 - 1).tolist()
    assert (kept[:3000] == np.where(counts >= 3, keepers, 0)).all()
    assert not got[3000:].any()
    # compact: bit arrays, four bytes of fingerprint and four of count a key
    assert len(row["words"]) < 0.6 * 3000 and len(row["marks"]) + len(row["counts"]) == 8 * 3000


def test_crowded_shard_is_copied(spark):
    docs = spark.createDataFrame([(i, 11, 12) for i in range(100)] + [(5, 13, 14)], "doc long, a long, b long")
    s = line_dedup.Settings(askers=10, shard_keys=1)
    shards = line_dedup.index(docs, s)
    assert sorted(r.asked for r in shards.collect()) in ([1, 100], [101])
    answers = line_dedup.probe(shards, docs, s).collect()
    assert sorted(r.doc for r in answers) == list(range(100)) and {r.keeper for r in answers} == {99}
