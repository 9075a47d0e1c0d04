import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from spark_analog.llm import merkle
from spark_analog.llm.queries import op11

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, bent=False):
    def said(v):
        return "-" if v is None else f"{len(str(v).encode())}:{v}"
    text = row["text"].translate(LOWER) if bent and row["text"] is not None else row["text"]
    return H(*[said(row[c]) for c in FIELDS[:-1]], said(text))


def ways(nodes, fan):
    """(top, steps of each node) of a tree over a list of digests."""
    steps, at = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // fan * fan:][:fan]
            steps[i].append(("".join(run[:k % fan]), "".join(run[k % fan + 1:])))
        nodes = [H(*nodes[k:k + fan]) for k in range(0, len(nodes), fan)]
        at = [k // fan for k in at]
    return nodes[0], steps


def plain(rows, fan):
    """(doc_id, leaf, subroot, root, steps) of every row."""
    trees = collections.defaultdict(list)
    for r in rows:
        trees[r["source"]].append(r)
    low, tops = {}, []
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    for s in order:
        trees[s].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, plain_leaf(r)))
        low[s] = ways([plain_leaf(r) for r in trees[s]], fan)
        tops.append(low[s][0])
    root, high = ways(tops, fan)
    return [(r["doc_id"], plain_leaf(r), low[s][0], root, low[s][1][i] + high[k])
            for k, s in enumerate(order) for i, r in enumerate(trees[s])]


def rows_of(sizes, seed=5):
    rng, out = random.Random(seed), []
    for s, n in sizes.items():
        for _ in range(n):
            out.append({"doc_id": len(out) * 7 % 997, "text": rng.choice([None, "", "Aé", "b" * rng.randrange(9), "X\nY"]),
                        "lang": rng.choice([None, "", "en"]), "source": s, "n_chars": rng.choice([None, 3, -12])})
    rng.shuffle(out)
    return out


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def made(df, settings):
    return sorted([(str(r.id), r.leaf, r.subroot, r.root, [tuple(s) for s in r.way]) for r in
                   merkle.manifest(df, "source", "doc_id", FIELDS, {"id": F.col("doc_id")}, settings)
                   .select("kept.id", "leaf", "subroot", "root", "way").collect()])


@pytest.mark.parametrize("fan,levels", [(2, 2), (3, 1)])
def test_every_step_to_the_root(spark, fan, levels):
    sizes = {None: 1, "": 2, "a": 3, "é": 16, "z": 17, "b": 70, "one": 1, "mid": 33}
    rows = rows_of(sizes)
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(",", "").split()[::2]) for r in rows], SCHEMA)
    want = sorted([(str(a), *b) for a, *b in plain(rows, fan)])
    assert made(df.repartition(3), merkle.Settings(fan=fan, levels=levels)) == want


def test_more_than_one_block(spark):
    rows = rows_of({"s": 600, "t": 257, "u": 256})
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(",", "").split()[::2]) for r in rows], SCHEMA)
    assert made(df, merkle.Settings()) == sorted([(str(a), *b) for a, *b in plain(rows, 16)])


@pytest.mark.parametrize("sizes", [{"only": 1}, {str(i): 1 for i in range(40)}])
def test_one_leaf_one_source_many_sources(spark, sizes):
    rows = rows_of(sizes)
    df = spark.createDataFrame([tuple(r[c] for c in SCHEMA.replace(",", "").split()[::2]) for r in rows], SCHEMA)
    assert made(df, merkle.Settings()) == sorted([(str(a), *b) for a, *b in plain(rows, 16)])


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(None, "A", "en", "s", 1)] * 3 + [(4, "B", None, "s", None)] * 40 + [(4, "b", None, "s", None)] + [(5, None, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("leaf", "rank", "n", "hash", "kids", "way", "tree", "block", "top", "kept", "d0", "at", "run", "first", "skip", "all", "sort"):
        df = df.withColumn(c, F.lit("x"))
    dicts = [dict(zip(SCHEMA.replace(",", "").split()[::2], r)) for r in rows]
    assert made(df, merkle.Settings()) == sorted([(str(a), *b) for a, *b in plain(dicts, 16)])


def test_empty_table(spark, no_docs):
    assert merkle.manifest(no_docs, "source", "doc_id", FIELDS).count() == 0


def test_query_finds_what_was_tampered_with(spark, tmp_path, odd_docs):
    odd_docs.write.parquet(f"{tmp_path}/documents.parquet")
    rows = [r.asDict() for r in odd_docs.collect()]
    want, by_id = {}, {r["doc_id"]: r for r in rows}
    for i, leaf, subroot, root, steps in plain(rows, 16):
        bent = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
        now = plain_leaf(by_id[i], bent)
        for before, after in steps:
            now = H(before, now, after)
        proof = H("".join(a + b for a, b in steps))
        want[i] = (leaf, subroot, root, proof, now, now == root)
    got = {r.doc_id: (r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root, r.verified)
           for r in op11(spark, str(tmp_path)).collect()}
    assert got == want and {v[-1] for v in want.values()} == {True, False}
