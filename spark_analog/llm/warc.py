"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. A record is one string whose record separator is the sink's line
separator, so any file system that Spark writes to will do. Of records with
equal payloads of ``revisit_from`` bytes or more the one with the largest page
id is a response; the others are revisits that refer to it and carry no payload.

Reading. Files are split anywhere. The reader cuts at the magic that starts a
record, which a payload may contain as well, so each cut is a candidate only:
tasks emit its offset and, from its Content-Length, the offset of its successor.
Pointer jumping from the start of each file (the jump doubles every round) keeps
the candidates that the chain reaches and rejects magic inside payloads. Where a
payload held magic, the pieces of that record are read again and put together;
all other payloads are digested where they are first read and never shuffled.

Results in special cases: null payloads are empty, null urls have no target
header; a null page id is written as such; repeated rows with the page id of the
response are responses too; a file that doesn't start with magic, and what
follows a broken or truncated record in its file, yields nothing; an empty table
gives no records; extra columns are ignored. A record is held whole by one task.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spark_analog.operators.staging import stage, staging_folder

MAGIC = "WARC/1.1\r\n"
GAP = "\r\n\r\n"
_M, _G = len(MAGIC), len(GAP)


@dataclass(frozen=True)
class Settings:
    revisit_from: int = 1000
    records_per_file: int = 2000
    date: str = "2024-01-01T00:00:00Z"


def _lines(*lines):
    return F.concat(*[x if not isinstance(x, str) else F.lit(x) for x in lines])


def records(pages: DataFrame, s: Settings = Settings(), page_id: str = "page_id", url: str = "url",
            html: str = "html") -> DataFrame:
    """One string per record, without the gap that ends it."""
    rows = pages.select(F.col(f"`{page_id}`").cast("string").alias("page"),
                        F.col(f"`{page_id}`").cast("long").alias("id"),
                        F.regexp_replace(F.col(f"`{url}`"), "[\r\n]", "").alias("url"),
                        F.coalesce(F.col(f"`{html}`").cast("string"), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1(F.col("payload").cast("binary"))) \
               .withColumn("bytes", F.octet_length("payload"))
    twins = stage(rows.filter(F.col("bytes") >= s.revisit_from).groupBy("digest")
                  .agg(F.count("*").alias("n"), F.max("id").alias("first")).filter("n > 1")
                  .select("digest", "first"))
    rows = rows.join(twins, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("id"))
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ",
                  F.col("bytes").cast("string"), "\r\n\r\n")
    block = F.when(revisit, http).otherwise(F.concat(http, F.col("payload")))
    page = F.coalesce("page", F.lit("null"))
    target = F.when(F.col("url").isNotNull(), _lines("WARC-Target-URI: ", F.col("url"), "\r\n")).otherwise("")
    refers = F.when(revisit, _lines(
        "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n"
        "WARC-Refers-To: <urn:page:", F.col("first").cast("string"), ">\r\n")).otherwise("")
    return rows.select(_lines(
        MAGIC, "WARC-Type: ", F.when(revisit, "revisit").otherwise("response"),
        "\r\nWARC-Record-ID: <urn:page:", page, f">\r\nWARC-Date: {s.date}\r\n", target, refers,
        "WARC-Payload-Digest: sha1:", F.col("digest"),
        "\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: ",
        F.octet_length(block).cast("string"), GAP, block).alias("value"))


def write(pages: DataFrame, path: str, s: Settings = Settings(), **columns: str) -> None:
    (records(pages, s, **columns).write.option("lineSep", GAP)
     .option("maxRecordsPerFile", s.records_per_file).text(path))


_HEADER = re.compile(rb"(?im)^([\w-]+):[ \t]*(.*?)\r?$")
_PAGE = re.compile(rb"<urn:page:(.*)>")


def parse(value: bytes) -> dict | None:
    """Header fields and the number of bytes that a record has after its magic."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    head = {k.lower(): v for k, v in _HEADER.findall(value[:end])}
    length = head.get(b"content-length", b"")
    if not length.isdigit() or len(length) > 15 or b"warc-type" not in head:
        return None
    return {"head": head, "start": end + 4, "size": end + 4 + int(length) + _G}


def content(value: bytes, found: dict) -> tuple:
    """page, type, payload_bytes, digest, refers_to of a whole record."""
    head = found["head"]
    block = value[found["start"]:found["size"] - _G]
    cut = block.find(b"\r\n\r\n")
    http, payload = (block[:cut], block[cut + 4:]) if cut >= 0 else (b"", block)
    kind = head[b"warc-type"].decode("utf-8", "replace")
    name = lambda h: (m := _PAGE.search(head.get(h, b""))) and m[1].decode("utf-8", "replace")
    if kind == "revisit":
        sizes = [v for k, v in _HEADER.findall(http) if k.lower() == b"content-length" and v.isdigit()]
        size = int(sizes[0]) if sizes else None
        digest = head.get(b"warc-payload-digest", b"").decode("utf-8", "replace").removeprefix("sha1:") or None
    else:
        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
    return name(b"warc-record-id"), kind, size, digest, name(b"warc-refers-to")


_FIELDS = "page string, type string, payload_bytes long, digest string, refers string"
_KINDS = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
_NAMES = ["page", "type", "payload_bytes", "digest", "refers"]


def _pieces(spark, path: str) -> DataFrame:
    """What lies between magics: file, split (start of the split), value; in order within a split."""
    text = spark.read.option("lineSep", MAGIC).text(path)
    return text.select(F.xxhash64("_metadata.file_path").alias("file"),
                       F.col("_metadata.file_block_start").alias("split"),
                       F.col("value").cast("binary").alias("value"))


def _candidates(spark, path: str) -> DataFrame:
    def run(batches):
        seen: dict[tuple, list] = {}
        for b in batches:
            out = []
            for file, split, value in zip(*(b.column(c).to_pylist() for c in ("file", "split", "value")),
                                          strict=True):
                at = seen.setdefault((file, split), [0, 0])  # number, offset in the split's rows
                found = None if split == 0 and at[0] == 0 else parse(value)
                whole = found is not None and found["size"] <= len(value)
                out.append((file, split, at[0], at[1], len(value), found and found["size"], whole,
                            *(content(value, found) if whole else [None] * 5)))
                at[0] += 1
                at[1] += len(value) + _M
            cols = list(zip(*out, strict=True)) if out else [[]] * 12
            kinds = [pa.int64()] * 6 + [pa.bool_()] + _KINDS
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                                             names=["file", "split", "k", "rel", "bytes", "size", "whole", *_NAMES])
    return _pieces(spark, path).mapInArrow(
        run, f"file long, split long, k long, rel long, bytes long, size long, whole boolean, {_FIELDS}")


def read(spark, path: str) -> DataFrame:
    """page, type, payload_bytes, digest, refers of every record on the chain."""
    local = stage(_candidates(spark, path))
    before = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    splits = (local.groupBy("file", "split").agg(F.sum(F.col("bytes") + _M).alias("wide"), F.count("*").alias("rows"))
              .select("file", "split", F.coalesce(F.sum("wide").over(before), F.lit(0)).alias("base"),
                      F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first")))
    # offset of the magic before each piece; the piece before the first magic has a negative one
    placed = stage(local.join(splits, ["file", "split"]).select(
        "file", "split", "k", "size", "whole", *_NAMES, (F.col("first") + F.col("k")).alias("row"),
        (F.col("base") + F.col("rel") - _M).alias("pos"),
        (F.col("base") + F.col("rel") + F.col("bytes")).alias("end"))
        .withColumn("next", F.col("pos") + _M + F.col("size")))
    chain = stage(reachable(placed.filter("size is not null").select("file", "pos", "next"),
                            placed.filter("row = 0 and end = 0").select("file", F.lit(0).cast("long").alias("pos"))))
    ends = placed.groupBy("file").agg(F.max("end").alias("file_end"))
    kept = (placed.filter("size is not null").join(chain, ["file", "pos"])
            .join(ends, "file").filter("next <= file_end"))
    parted = stage(kept.filter("not whole").select("file", "row", "pos", "next", "file_end"))
    out = kept.filter("whole").select(*_NAMES)
    if parted.isEmpty():
        return out
    return out.unionByName(_put_together(spark, path, placed, parted))


def reachable(nodes: DataFrame, starts: DataFrame) -> DataFrame:
    """(file, pos) of all nodes on the chain from the starts; nodes: file, pos, next."""
    step = stage(nodes.join(nodes.select("file", F.col("pos").alias("next")), ["file", "next"]))
    reach = stage(starts.join(nodes.select("file", "pos"), ["file", "pos"]).select("file", "pos"))
    while not step.isEmpty():
        moved = reach.join(step, ["file", "pos"]).select("file", F.col("next").alias("pos"))
        reach = stage(reach.unionByName(moved).distinct())
        far = step.select("file", F.col("pos").alias("next"), F.col("next").alias("_far"))
        step = stage(step.join(far, ["file", "next"]).select("file", "pos", F.col("_far").alias("next")))
    return reach


def _put_together(spark, path: str, placed: DataFrame, parted: DataFrame) -> DataFrame:
    """Records whose payload held magic: their pieces, read again and joined by it."""
    last = placed.select("file", F.col("pos").alias("next"), F.col("row").alias("stop"))
    total = placed.groupBy("file").agg((F.max("row") + 1).alias("rows"))
    spans = (parted.join(last, ["file", "next"], "left").join(total, "file")
             .withColumn("stop", F.coalesce("stop", "rows")))
    wanted = (spans.select("file", F.col("row").alias("owner"),
                           F.explode(F.sequence("row", F.col("stop") - 1)).alias("row"))
              .join(placed.select("file", "row", "split", "k"), ["file", "row"])
              .select("file", "split", "k", "row", "owner"))

    def number(batches):
        seen: dict[tuple, int] = {}
        for b in batches:
            ks = []
            for key in zip(b.column("file").to_pylist(), b.column("split").to_pylist(), strict=True):
                ks.append(seen.get(key, 0))
                seen[key] = ks[-1] + 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ks, pa.int64())], names=[*b.schema.names, "k"])

    def assemble(table: pa.Table) -> pa.Table:
        parts = sorted(zip(table.column("row").to_pylist(), table.column("value").to_pylist(), strict=True))
        value = MAGIC.encode().join(v for _, v in parts)
        found = parse(value)
        row = content(value, found) if found and found["size"] <= len(value) else None
        cols = [[x] for x in row] if row else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS, strict=True)], names=_NAMES)

    again = _pieces(spark, path).mapInArrow(number, "file long, split long, value binary, k long")
    return (again.join(stage(wanted), ["file", "split", "k"]).select("file", "owner", "row", "value")
            .groupBy("file", "owner").applyInArrow(assemble, _FIELDS))


def round_trip(pages: DataFrame, s: Settings = Settings(), **columns: str) -> DataFrame:
    """Write all pages to an archive in the shared folder and read it back."""
    path = f"{staging_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    write(pages, path, s, **columns)
    return read(pages.sparkSession, path)
