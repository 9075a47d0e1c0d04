import hashlib
import random
import uuid

import pytest
from pyspark.sql import functions as F

from spark_analog.llm import warc

SCHEMA = "page_id long, url string, html string"
MAGIC = warc.MAGIC


def pages():
    rng = random.Random(8)
    body = lambda n: "".join(rng.choice("abc é<p>\n\r") for _ in range(n))
    fake = f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:77>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    big, same = body(3000), body(999)
    rows = [(i, f"http://h/{i}", body(rng.randrange(2500))) for i in range(60)]
    rows += [(100, None, None), (101, "u\r\nv", ""), (102, "http://x", fake), (103, "x", fake * 40), (104, "x", MAGIC * 50),
             (105, "x", f"{body(400)}{MAGIC}{body(500)}"), (106, "x", MAGIC[:-1] + "\r"), (107, "x", "a\r\n\r\n")]
    rows += [(200 + i, "http://b", big) for i in range(30)] + [(300 + i, "http://s", same) for i in range(3)]
    rows += [(400 + i, "http://f", fake * 40 + "x") for i in range(3)]
    rng.shuffle(rows)
    return rows


def expected(rows):
    top = {}
    for i, _, html in rows:
        if i is not None:
            top[html] = max(i, top.get(html, i))
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        copy = len(data) >= 1000 and i != top[html] and sum(h == html for _, _, h in rows) > 1
        out.append((str(i) if i is not None else "null", "revisit" if copy else "response", len(data),
                    hashlib.sha1(data).hexdigest(), str(top[html]) if copy else None))
    return sorted(out)


def read(df):
    return sorted((r.page, r.type, r.payload_bytes, r.digest, r.refers) for r in df.collect())


@pytest.mark.parametrize("split", [700, 5000, 1 << 27])
def test_round_trip_with_files_split_anywhere(spark, split):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    spark.conf.set("spark.sql.files.openCostInBytes", 1)
    try:
        rows = pages()
        df = spark.createDataFrame(rows, SCHEMA).withColumn("digest", F.lit("x")).repartition(3)
        assert read(warc.round_trip(df, warc.Settings(records_per_file=25))) == expected(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])


def test_repeated_rows_null_ids_and_empty(spark):
    long = "z" * 1500
    rows = [(1, "a", long), (1, "a", long), (None, "a", long), (0, "a", long)]
    got = read(warc.round_trip(spark.createDataFrame(rows, SCHEMA)))
    assert [(p, t, r) for p, t, _, _, r in got] == [
        ("0", "revisit", "1"), ("1", "response", None), ("1", "response", None), ("null", "revisit", "1")]
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def record(page, payload):
    block = f"HTTP/1.1 200 OK\r\nContent-Length: {len(payload)}\r\n\r\n{payload}"
    return f"{MAGIC}WARC-Type: response\r\nWARC-Record-ID: <urn:page:{page}>\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n"


def test_only_the_chain_from_the_start_counts(spark, tmp_path):
    whole = "".join(record(i, "p" * i) for i in range(5))
    broken = record(6, "x") + "garbage" + record(7, "never reached")
    cut = record(8, "x") + record(9, "truncated" * 10)[:-20]
    for name, text in (("a", whole), ("b", broken), ("c", "no magic first" + whole), ("d", cut), ("e", "")):
        (tmp_path / f"{name}.txt").write_bytes(text.encode())
    got = warc.read(spark, str(tmp_path))
    assert sorted(r.page for r in got.collect()) == ["0", "1", "2", "3", "4", "6", "8"]
    assert uuid.uuid4()


def test_pointer_jumping_reaches_only_the_chain(spark):
    edges = [(1, i, i + 1) for i in range(100) if i != 50] + [(1, 200, 201), (2, 0, 5), (2, 5, 5000)]
    nodes = spark.createDataFrame(edges, "file long, pos long, next long")
    starts = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "file long, pos long")
    got = {(r.file, r.pos) for r in warc.reachable(nodes, starts).collect()}
    assert got == {(1, i) for i in range(50)} | {(2, 0), (2, 5)}
