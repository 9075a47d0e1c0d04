import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from plain import words
from spark_analog.llm import conversation_trie as ct
from spark_analog.llm.queries import op13

SCHEMA = "conv_id long, turn long, role string, text string"


def numbered(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            body = (role or "", text or "")
            digest = hashlib.md5(f"{len(body[0].encode())}:{body[0]}{body[1]}".encode()).hexdigest()
            own[c].append((turn is not None, turn or 0, digest, body))
    return {c: [t[-1] for t in sorted(ts)] for c, ts in own.items()}


def rebuilt(own):
    out = {}
    for c, turns in own.items():
        h, base = zlib.crc32(str(c).encode()) % 4, c - (abs(c) % 20) * (1 if c > 0 else -1)
        out[c] = own.get(base, [])[:h] + turns[h:]
    return out


def plain(convs):
    """The rows of a trie over conv -> turns, by walking it."""
    members, children = collections.defaultdict(set), collections.defaultdict(set)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].add(c)
            if d:
                children[tuple(turns[:d - 1])].add(tuple(turns[:d]))
    leaves, saved = collections.Counter(), collections.Counter()
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] += not children[node]
            saved[node[:d]] += (len(own) - 1) * (len(words(node[-1][1])) if node else 0)
    ends = lambda n: ",".join(str(c) for c in sorted(members[n]) if len(convs[c]) == len(n))
    return sorted([(min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n],
                    hashlib.sha256(ends(n).encode()).hexdigest()) for n, m in members.items()], key=repr)


def some_rows(seed, convs=90, longest=14):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(range(-60, 300), convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, turn * 2, rng.choice(["user", "assistant"]), rng.choice(["a b", "c", "a b é  d", ""])
                         if rng.random() < 0.2 else f"turn {turn} as usual"))
    for c in (20, 23, 31, 47):  # long ones that part late
        rows = [r for r in rows if r[0] != c] + [(c, k, "user", f"word {k}" if k < 70 or c < 40 else "else") for k in range(60 + c)]
    rows += [(500, None, None, None), (500, None, "user", "x"), (500, 4, "user", "same"), (500, 4, "user", "same"), (500, 4, None, "z")]
    rows += [(None, 0, "user", "nobody's"), (None, None, None, None)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("settings", [ct.Settings(), ct.Settings(turns=3, piece=2, ids=10)])
def test_equals_walk(spark, settings):
    rows = some_rows(4)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    for c in ("conv", "digest", "words", "rank", "n", "owner", "k", "at", "run"):
        df = df.withColumn(c, F.lit("x"))
    got = ct.trie(*ct.as_they_are(*ct.number_turns(df)), settings).collect()
    assert sorted([tuple(r) for r in got], key=repr) == plain(numbered(rows))


def test_query_opens_conversations_as_their_family_does(spark, tmp_path):
    rows = some_rows(9)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/conversations.parquet")
    df = op13(spark, str(tmp_path))
    got = sorted([tuple(r) for r in df.collect()], key=repr)
    want = plain(rebuilt(numbered(rows)))
    assert got == want and any(len(t) == 0 for t in rebuilt(numbered(rows)).values())
    assert dict(df.dtypes) == {c: "string" if c == "ends_sha256" else "bigint" for c in df.columns}


def test_copies_prefixes_and_conversations_without_turns(spark):
    convs = {c: [("user", f"t{k}") for k in range(n)] for c, n in
             [(1, 9), (2, 9), (3, 9), (4, 8), (5, 16), (6, 17), (7, 1), (8, 0), (9, 0), (10, 25)]}
    turns = spark.createDataFrame([(c, k, f"d{k}", 2 + k) for c, t in convs.items() for k in range(len(t))],
                                  "conv long, pos long, digest string, words long")
    members = spark.createDataFrame([(c,) for c in convs], "conv long")
    got = sorted([tuple(r) for r in ct.trie(turns, members).collect()], key=repr)
    as_words = {c: [("user", "w " * (2 + k)) for k in range(len(t))] for c, t in convs.items()}
    assert got == plain(as_words)
    assert [tuple(r) for r in ct.trie(turns.limit(0), members.filter("conv = 8")).collect()] == plain({8: []})


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert ct.trie(*ct.with_openings(*ct.number_turns(none))).count() == 0
    nobody = spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)
    assert ct.trie(*ct.with_openings(*ct.number_turns(nobody))).count() == 0
