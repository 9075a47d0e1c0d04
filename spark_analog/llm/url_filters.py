"""URL filters as a sort-merge range join.

A host is written backwards by labels (``www.example.com`` is
``com.example.www.``), so a rule for a host and its subdomains is an interval
of keys. Urls and rules are sorted by key; one sweep over each sorted run keeps
a stack of the rules whose interval is open, and pops those that the next key
has left. Rules of one host lie in one frame of the stack, by the length of
their path, so a url asks each frame for the longest path that starts its own.

The keys are dealt into runs at bounds drawn from a bounded sample of keys; the
bounds decide the balance only. A rule goes to every run its interval touches.
A key that fills several runs (one url with a large part of all rows) is dealt
over them by a hash of the id, so no key makes a run large.

Results in special cases: a null url, or one without ``://``, has empty host and
path; a rule with an empty host fits every url whose path starts with its path;
of equally long rules that fit the one with the longer host wins, of equal rules
``block``; urls that no rule fits get ``default``; null rule fields are empty;
repeated rows are judged each on its own; empty tables give no rows, without
rules all get ``default``; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.llm.common import annotate

#: Keys sampled for the bounds, and the bytes kept of each.
SAMPLE, KEY_BYTES = 4096, 256
_PARTS = re.compile(rb"([^/?#]*)([^?#]*)", re.S)


def host_path(url: bytes | None) -> tuple[bytes, bytes]:
    at = url.find(b"://") if url else -1
    if at < 0:
        return b"", b""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.lower(), path


def host_key(host: bytes) -> bytes:
    """Labels backwards, each followed by a dot; empty for the empty host of a rule."""
    return b".".join(host.split(b".")[::-1]) + b"."


def past(key: bytes) -> bytes:
    """First key after all that start with ``key`` (which ends with a dot)."""
    return key[:-1] + b"/"


_URL = T.StructType([T.StructField("host", T.BinaryType()), T.StructField("path", T.BinaryType()),
                     T.StructField("key", T.BinaryType())])


def _split_kernel():
    def run(urls):
        parts = [host_path(u) for u in urls]
        return {"host": [h for h, _ in parts], "path": [p for _, p in parts],
                "key": [host_key(h) for h, _ in parts]}
    return run


def _bounds(urls: DataFrame, rows: int, runs: int) -> list[bytes]:
    """runs - 1 sorted sort keys (host key, then path) from a sample of about SAMPLE of all ``rows``:
    those whose hash lies below a limit set beforehand; a repeated row counts once, so all tasks
    together send no more than the sample."""
    mark = F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "k", F.lit("url"))
    limit = int(min(1.0, SAMPLE / max(1, rows)) * 2 ** 64) - 2 ** 63
    keys = [bytes(r.k) for r in urls.select("k", mark.alias("h")).filter(F.col("h") <= min(limit, 2 ** 63 - 1))
            .distinct().collect()]
    keys.sort()
    return [keys[i * len(keys) // runs] for i in range(1, runs)] if keys else []


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url",
          page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule, verdict; ``rules`` has host, path, verdict."""
    spark = pages.sparkSession
    id_type = pages.schema[page_id].dataType.simpleString()
    narrow = pages.select(F.col(f"`{page_id}`").alias("id"), F.col(f"`{url}`").alias("url"))
    split, at = annotate(narrow, lambda: _split_kernel(), _URL, "url", "parts", keep=["id"])
    urls = split.select("id", f"{at}.host", f"{at}.path", f"{at}.key")
    runs = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the bound has a zero byte between host and path, so hosts sort before longer hosts
    urls = urls.withColumn("k", F.substring(
        F.concat("key", F.lit(b"\x00"), "path"), 1, KEY_BYTES))
    bounds = spark.sparkContext.broadcast(_bounds(urls, pages.count(), runs))

    schema = (f"run int, key binary, kind int, k binary, id {id_type}, host binary, path binary, "
              "verdict string")

    def deal_urls(batches):
        from pyspark import TaskContext
        edges, turn = bounds.value, TaskContext.get().partitionId()
        for batch in batches:
            out = []
            for k in batch.column("k").to_pylist():
                lo, hi = bisect.bisect_left(edges, k), bisect.bisect_right(edges, k)
                out.append(lo + turn % (hi - lo + 1))
                turn += 1
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int32()), batch.column("key"), pa.array([1] * n, pa.int32()),
                 batch.column("k"), batch.column("id"), batch.column("host"), batch.column("path"),
                 pa.nulls(n, pa.string())],
                names=["run", "key", "kind", "k", "id", "host", "path", "verdict"])

    def deal_rules(batches):
        edges = bounds.value
        for batch in batches:
            rows = []
            for host, path, verdict in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "verdict")),
                                           strict=True):
                host = (host or "").encode().lower()
                key = host_key(host) if host else b""
                lo = bisect.bisect_left(edges, key[:KEY_BYTES])
                hi = bisect.bisect_right(edges, past(key)[:KEY_BYTES]) if key else len(edges)
                rows += [(run, key, host, (path or "").encode(), verdict) for run in range(lo, hi + 1)]
            n = len(rows)
            run, key, host, path, verdict = zip(*rows, strict=True) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(run, pa.int32()), pa.array(key, pa.binary()), pa.array([0] * n, pa.int32()),
                 pa.array(key, pa.binary()), pa.nulls(n, batch_id), pa.array(host, pa.binary()),
                 pa.array(path, pa.binary()), pa.array(verdict, pa.string())],
                names=["run", "key", "kind", "k", "id", "host", "path", "verdict"])

    from pyspark.sql.pandas.types import to_arrow_type
    batch_id = to_arrow_type(pages.schema[page_id].dataType)
    both = urls.mapInArrow(deal_urls, schema).unionByName(
        rules.select("host", "path", "verdict").mapInArrow(deal_rules, schema))
    swept = (both.repartition(runs, "run")
             .sortWithinPartitions("run", "key", "kind", "path")
             .mapInArrow(_sweep(default), f"id {id_type}, host binary, path binary, rule binary, verdict string"))
    return swept.select(F.col("id").alias("page_id"), F.col("host").cast("string").alias("host"),
                        F.col("path").cast("string").alias("path"),
                        F.col("rule").cast("string").alias("rule"), "verdict")


class Frame:
    """The rules of one host."""

    def __init__(self, key: bytes, host: bytes):
        self.key, self.host, self.verdicts = key, host, {}
        self.lengths: list[int] = []

    def add(self, path: bytes, verdict: str) -> None:
        if path not in self.verdicts or verdict == "block":
            self.verdicts[path] = verdict
        if len(path) not in self.lengths:
            self.lengths = sorted({*self.lengths, len(path)}, reverse=True)

    def longest(self, path: bytes) -> bytes | None:
        return next((path[:n] for n in self.lengths if n <= len(path) and path[:n] in self.verdicts), None)


def decide(stack: list[Frame], path: bytes, default: str) -> tuple[bytes | None, str]:
    best, rule, verdict = (-1, -1), None, default
    for frame in stack:
        found = frame.longest(path)
        if found is not None and (rank := (len(frame.host) + len(found), len(frame.host))) > best:
            best, rule, verdict = rank, frame.host + found, frame.verdicts[found]
    return rule, verdict


def _sweep(default: str):
    def run(batches):
        stack: list[Frame] = []
        current = None
        for batch in batches:
            cols = {c: batch.column(c).to_pylist() for c in ("run", "key", "kind", "host", "path", "verdict")}
            pick, rules, verdicts = [], [], []
            for i, (run_, key, kind) in enumerate(zip(cols["run"], cols["key"], cols["kind"], strict=True)):
                if run_ != current:
                    stack, current = [], run_
                while stack and not key.startswith(stack[-1].key):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1].key != key:
                        stack.append(Frame(key, cols["host"][i]))
                    stack[-1].add(cols["path"][i], cols["verdict"][i])
                else:
                    rule, verdict = decide(stack, cols["path"][i], default)
                    pick.append(i)
                    rules.append(rule)
                    verdicts.append(verdict)
            take = batch.take(pa.array(pick, pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [take.column("id"), take.column("host"), take.column("path"),
                 pa.array(rules, pa.binary()), pa.array(verdicts, pa.string())],
                names=["id", "host", "path", "rule", "verdict"])
    return run


#: Same rows in DuckDB for the rules in :data:`RULES`; table ``pages``.
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block"))
SQL = r"""
with rest as (
  select page_id, case when strpos(url, '://') > 0
                       then substr(url, strpos(url, '://') + 3) else '' end as r from pages),
parts as (
  select page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                            'abcdefghijklmnopqrstuvwxyz') as host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path from rest),
rules(rhost, rpath, verdict) as (values
  ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
fits as (
  select page_id, host, path, rhost || rpath as rule, verdict,
         row_number() over (partition by page_id order by length(rhost || rpath) desc, length(rhost) desc) as k
  from parts join rules on (host = rhost or ends_with(host, '.' || rhost)) and starts_with(path, rpath))
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') as verdict
from parts p left join fits f on f.page_id = p.page_id and f.k = 1
"""
