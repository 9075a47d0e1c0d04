"""Line dedup by a sharded minimal perfect hash.

1. One pass over the texts takes the 128-bit hashes of each document's distinct long lines.
   Documents per hash, and the largest document, are counted with a partial sum before each shuffle.
2. Hashes are dealt over shards of some thousand. A task builds the minimal perfect hash of a
   shard: in each round the keys that have a bit of a bit array to themselves set it, the others
   go on to the next, smaller array; a key's slot is the number of bits set before its own. At the
   slots lie a fingerprint, the number of documents and, for lines in enough documents, the
   document that keeps the line. A shard is one row of a few dozen kilobytes.
3. Documents send their hashes to the shards, which answer with the lines that a document loses.
   A shard that very many ask is copied and its askers dealt over the copies.
4. A document meets the list of the lines that it loses, and drops them.

All distinct long lines are in the index, so every hash that a document of the same table sends
lies at its own slot. The fingerprint is for other texts: it tells a line that isn't in the index
but for one in 2 ** 32.

Results in special cases: documents are told apart by their id. Rows of one id count as one
document, whose lines are those of all its rows; rows without an id are one document, smaller than
every other. A null or empty text is one empty line. A line's copies in one text all stay or all
go. A text whose lines all go becomes empty. Repeated rows give a row each; an empty table gives no
rows; other columns are handed on as they are, also where their names clash with those in use here;
a long text is read whole, line by line.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from spark_analog.llm.common import free_name, mix
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``least_chars``: code points that a line must have to be dropped; ``documents``: in so many
    documents it must be; ``shard_keys``: hashes per shard; ``askers``: requests that one copy of a
    shard answers."""
    least_chars: int = 20
    documents: int = 3
    shard_keys: int = 4096
    askers: int = 16_384


SPACE = b" \t\n\x0b\x0c\r"


def line_keys(text: bytes | None, least: int) -> tuple[list[bytes], list[int | None]]:
    """Lines of a whole text, and of those with enough code points the 128-bit hash of the key."""
    import xxhash

    lines = (text or b"").split(b"\n")
    keys: list[int | None] = []
    for line in lines:
        key = line.strip(SPACE).lower()
        long = len(key) >= least and (len(key) >= 4 * least or sum(b & 0xC0 != 0x80 for b in key) >= least)
        keys.append(xxhash.xxh3_128_intdigest(key) if long else None)
    return lines, keys


_LOW = (1 << 64) - 1


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    n = len(keys)
    return (np.fromiter((k >> 64 for k in keys), np.uint64, n).view(np.int64),
            np.fromiter((k & _LOW for k in keys), np.uint64, n).view(np.int64))


class PerfectHash:
    """Minimal perfect hash of a set of 128-bit keys: bit arrays searched one after the other.

    A key's place in the array of a round depends on the key and the round alone. ``sizes``: bits
    of each round; ``words``: all arrays, 64 bits a word; ``before``: bits set before each word.
    """

    MOST_ROUNDS = 64

    def __init__(self, sizes: np.ndarray, words: np.ndarray):
        self.sizes, self.words = sizes.astype(np.int64), words.astype(np.uint64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words).astype(np.int64))])

    @staticmethod
    def _places(a: np.ndarray, b: np.ndarray, round_: int, size: int) -> np.ndarray:
        h = mix(a.view(np.uint64) + np.uint64(round_ + 1) * b.view(np.uint64))
        return (mix(h + np.uint64(round_)) % np.uint64(size)).astype(np.int64)

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray) -> PerfectHash:
        """Of distinct keys, given as halves."""
        sizes, words = [], []
        left = np.arange(len(a))
        for k in range(cls.MOST_ROUNDS):
            if not len(left):
                return cls(np.array(sizes, np.int64), np.concatenate([*words, np.empty(0, np.uint64)]))
            size = -(-len(left) * 3 // 2 // 64) * 64 or 64
            at = cls._places(a[left], b[left], k, size)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            words.append(np.packbits(alone, bitorder="little").view(np.uint64))
            left = left[~alone[at]]
        raise ValueError("keys of a shard aren't distinct")

    def slots(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Slot of each key; -1 for some of the keys that aren't in the set."""
        out = np.full(len(a), -1, np.int64)
        left = np.arange(len(a))
        for k, size in enumerate(self.sizes.tolist()):
            if not len(left):
                break
            at = self.starts[k] + self._places(a[left], b[left], k, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            there = (self.words[word] >> bit) & np.uint64(1) > 0
            below = self.words[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[there]] = (self.before[word] + np.bitwise_count(below))[there]
            left = left[~there]
        return out


def fingerprints(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mix(mix(a.view(np.uint64)) ^ b.view(np.uint64)) >> np.uint64(32)).astype(np.uint32)


class Shard:
    """Arrays of one shard; a keeper of None (rows without id) has ``has_keeper`` false."""

    def __init__(self, row: dict):
        read = lambda c, kind: np.frombuffer(row[c], kind)
        self.hash = PerfectHash(read("sizes", np.int64), read("words", np.uint64))
        self.marks, self.counts = read("marks", np.uint32), read("counts", np.uint32)
        self.heavy, self.keepers = read("heavy", np.uint32), read("keepers", np.int64)

    @staticmethod
    def build(a, b, counts, keepers, documents: int) -> dict:
        made = PerfectHash.build(a, b)
        slots = made.slots(a, b)
        order = np.empty(len(a), np.int64)
        order[slots] = np.arange(len(a))
        told = np.minimum(counts[order], np.iinfo(np.uint32).max).astype(np.uint32)
        heavy = np.flatnonzero(told >= documents).astype(np.uint32)
        return {"sizes": made.sizes.tobytes(), "words": made.words.tobytes(),
                "marks": fingerprints(a, b)[order].tobytes(), "counts": told.tobytes(),
                "heavy": heavy.tobytes(), "keepers": keepers[order][heavy].astype(np.int64).tobytes()}

    def probe(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(documents, keeper) of each line; 0 documents where the line isn't in the index. The
        keeper counts where the documents are enough."""
        slot = self.hash.slots(a, b)
        known = slot >= 0
        known[known] = self.marks[slot[known]] == fingerprints(a, b)[known]
        counts = np.where(known, self.counts[np.where(known, slot, 0)] if len(self.counts) else 0, 0).astype(np.int64)
        keepers = np.zeros(len(a), np.int64)
        if len(self.heavy):
            at = np.minimum(np.searchsorted(self.heavy, slot), len(self.heavy) - 1)
            keepers = np.where(self.heavy[at] == slot, self.keepers[at], 0)
        return counts, keepers


ARRAYS = ("sizes", "words", "marks", "counts", "heavy", "keepers")


def _lines(docs: DataFrame, text: str, doc_id: str, s: Settings) -> DataFrame:
    """(doc, a, b) once per row and distinct long line."""
    given = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc"),
                        F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    schema = "doc long, a array<long>, b array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, ends = [], [0]
            for text_ in batch.column(1).to_pylist():
                found += {k for k in line_keys(text_, s.least_chars)[1] if k is not None}
                ends.append(len(found))
            a, b = _halves(found)
            ends_ = pa.array(ends, pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.ListArray.from_arrays(ends_, pa.array(a)), pa.ListArray.from_arrays(ends_, pa.array(b))],
                names=["doc", "a", "b"])

    return given.mapInArrow(run, schema).select("doc", F.inline(F.arrays_zip("a", "b")))


def _runs(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Stretches of equal values."""
    values = column.to_numpy(zero_copy_only=False)
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)] if len(values) else []
    yield from zip(edges[:-1], edges[1:])


#: The document that rows without an id form, where a number is needed; such a keeper is never one's own id.
NO_ID = -(1 << 63)


def index(pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(shard, shards, asked, arrays...): one row per shard, from distinct (doc, a, b).

    ``asked``: pairs that fall into the shard."""
    s = settings
    doc = F.coalesce("doc", F.lit(NO_ID))
    keys = stage(pairs.groupBy("a", "b").agg(F.count("*").alias("count"), F.max(doc).alias("keeper")))
    shards = max(1, -(-keys.count() // s.shard_keys))
    dealt = keys.withColumn("shard", F.pmod("a", F.lit(shards))).repartition("shard").sortWithinPartitions("shard")
    schema = T.StructType([T.StructField("shard", T.LongType()), T.StructField("shards", T.LongType()),
                           T.StructField("asked", T.LongType()), *[T.StructField(c, T.BinaryType()) for c in ARRAYS]])
    arrow = to_arrow_schema(schema)

    def run(batches):
        def close(shard, parts):
            a, b, counts, keepers = (np.concatenate(x) for x in zip(*parts))
            made = Shard.build(a, b, counts, keepers, s.documents)
            return pa.RecordBatch.from_pylist(
                [{"shard": shard, "shards": shards, "asked": int(counts.sum()), **made}], arrow)

        current, parts = None, []
        for batch in batches:
            names = {c: i for i, c in enumerate(batch.schema.names)}
            shard = batch.column(names["shard"])
            for i, j in _runs(shard):
                if parts and shard[i].as_py() != current:
                    yield close(current, parts)
                    parts = []
                current = shard[i].as_py()
                parts.append([batch.column(names[c]).slice(i, j - i).to_numpy() for c in ("a", "b", "count", "keeper")])
        if parts:
            yield close(current, parts)

    return stage(dealt.mapInArrow(run, schema))


def probe(shards: DataFrame, pairs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(doc, a, b, documents, keeper) of every pair whose line is in the index in enough documents."""
    s = settings
    width = shards.agg(F.max("shards")).first()[0]
    if width is None:
        return pairs.select("doc", "a", "b", F.lit(0).cast("long").alias("documents"), F.lit(0).cast("long").alias("keeper")).limit(0)
    copies = F.ceil(F.col("asked") / s.askers)
    hot = stage(shards.select("shard", copies.alias("copies")).filter("copies > 1"))
    none = lambda c: F.lit(None).cast(c)
    held = shards.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.greatest(copies, F.lit(1))))) \
        .select("shard", "copy", F.lit(0).alias("kind"), none("long").alias("doc"), none("long").alias("a"),
                none("long").alias("b"), *ARRAYS)
    asked = (pairs.withColumn("shard", F.pmod("a", F.lit(width))).join(hot, "shard", "left")
             .select("shard", (F.pmod(F.xxhash64("doc"), F.coalesce("copies", F.lit(1))) + 1).alias("copy"),
                     F.lit(1).alias("kind"), "doc", "a", "b", *[none("binary").alias(c) for c in ARRAYS]))
    met = held.unionByName(asked).repartition("shard", "copy").sortWithinPartitions("shard", "copy", "kind")

    def run(batches):
        at, arrays = None, None
        for batch in batches:
            cols = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            shard, copy, kind = (cols[c].to_numpy() for c in ("shard", "copy", "kind"))
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(copy) != 0) | (np.diff(kind) != 0)) + 1
            edges = [0, *cuts.tolist(), len(shard)]
            for i, j in zip(edges[:-1], edges[1:]):
                if i == j:
                    continue
                if kind[i] == 0:
                    at, arrays = (shard[i], copy[i]), Shard({c: cols[c][i].as_py() for c in ARRAYS})
                elif at == (shard[i], copy[i]):  # else the index has no such shard
                    a, b = (cols[c].slice(i, j - i).to_numpy() for c in ("a", "b"))
                    counts, keepers = arrays.probe(a, b)
                    some = np.flatnonzero(counts >= s.documents)
                    yield pa.RecordBatch.from_arrays(
                        [cols["doc"].slice(i, j - i).take(pa.array(some)), pa.array(a[some]), pa.array(b[some]),
                         pa.array(counts[some]), pa.array(keepers[some])], names=["doc", "a", "b", "documents", "keeper"])

    return met.mapInArrow(run, "doc long, a long, b long, documents long, keeper long")


def clean(docs: DataFrame, settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id",
          keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """The columns ``keep`` (all by default) and a struct n_lines, n_dropped, text (what stays) of
    every row; also returns the struct's name."""
    s = settings
    keep = docs.columns if keep is None else keep
    pairs = stage(_lines(docs, text, doc_id, s).distinct())
    answers = probe(index(pairs, s), pairs, s)
    lost = stage(answers.filter(F.coalesce("doc", F.lit(NO_ID)) != F.col("keeper"))
                 .groupBy("doc").agg(F.collect_list(F.struct("a", "b")).alias("lost")))
    body, own, gone, name = (free_name(docs, c) for c in ("_body", "_own", "_gone", "line_dedup"))
    given = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{doc_id}`").cast("long").alias(own),
                        F.col(f"`{text}`").cast("string").cast("binary").alias(body))
    told = lost.select(F.col("doc").alias("_lost_by"), F.col("lost.a").alias("_lost_a"), F.col("lost.b").alias("_lost_b"))
    sides = {c: free_name(given, c) for c in told.columns}
    told = told.select(*[F.col(c).alias(n) for c, n in sides.items()])
    met = given.join(told, given[own].eqNullSafe(told[sides["_lost_by"]]), "left") \
        .select(*[given[f"`{c}`"] for c in keep], given[body], told[sides["_lost_a"]], told[sides["_lost_b"]])
    fields = T.StructType([T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType()),
                           T.StructField("text", T.StringType())])
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField(name, fields)])

    def run(batches):
        for batch in batches:
            texts, a, b = (batch.column(batch.num_columns - k) for k in (3, 2, 1))
            rows = []
            for text_, la, lb in zip(texts, a, b):
                value = text_.as_py()
                if not la.is_valid:
                    rows.append({"n_lines": (value or b"").count(b"\n") + 1, "n_dropped": 0, "text": value or b""})
                    continue
                out = set(zip(la.values.to_numpy().view(np.uint64).tolist(), lb.values.to_numpy().view(np.uint64).tolist()))
                lines, keys = line_keys(value, s.least_chars)
                stay = [x for x, k in zip(lines, keys) if k is None or (k >> 64, k & _LOW) not in out]
                rows.append({"n_lines": len(lines), "n_dropped": len(lines) - len(stay), "text": b"\n".join(stay)})
            made = pa.StructArray.from_arrays(
                [pa.array([r[c] for r in rows], k) for c, k in (("n_lines", pa.int64()), ("n_dropped", pa.int64()))]
                + [pa.array([r["text"] for r in rows], pa.binary()).cast(pa.string())], names=["n_lines", "n_dropped", "text"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-3], made], names=[*batch.schema.names[:-3], name])

    return met.mapInArrow(run, schema), name
