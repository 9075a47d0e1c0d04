"""Best-fit packing of documents into token sequences of a fixed length.

Bounded-space online best fit: every task keeps at most ``open_bins`` open
sequences. A bitset has one bit per amount of free space, so the open sequence
that a piece fills best is the lowest set bit at or above its length. When too
many are open, the fullest closes first. What a task leaves open is packed
again in the same way, group of tasks by group of tasks, until one group is
left, so that half-empty ends don't add up with the number of tasks.

Only documents longer than a sequence are cut. A text's ids are those of its
words one after another: this tokenizer's normaliser and pre-tokenizer never
look across white space, so words are tokenised once and their ids kept.

The first pass is written to the shared folder before its sequence numbers are
used; a lost executor repeats tasks, never numbers that were handed out.

Results in special cases: null and empty texts are the end id alone; repeated
rows are packed each on its own; texts of any length are packed whole; an empty
table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import functools
import itertools
import os
import string
import unicodedata
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spark_analog.llm import common
from spark_analog.operators.staging import stage


@dataclass(frozen=True)
class Settings:
    """``tokenizer``: a file of the ``tokenizers`` library (None: word_bpe_49k.json of
    ``public_tokenizers``). ``merge``: tasks whose open sequences are packed together."""
    capacity: int = 2048
    open_bins: int = 512
    end_id: int = 0
    tokenizer: str | None = None
    merge: int = 64


class BestFit:
    """At most ``most`` open bins; ``put`` gives (bin, offset)."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most = capacity, most
        self.bits, self.count, self.next = 0, 0, 0
        self.at: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        fitting = self.bits >> length
        if fitting:
            free = length + (fitting & -fitting).bit_length() - 1
            bin_ = self._take(free)
        else:
            free, bin_ = self.capacity, self.next
            self.next += 1
        self._keep(free - length, bin_)
        if self.count > self.most:
            self._take((self.bits & -self.bits).bit_length() - 1)
        return bin_, self.capacity - free

    def _take(self, free: int) -> int:
        bin_ = self.at[free].pop()
        if not self.at[free]:
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_

    def _keep(self, free: int, bin_: int) -> None:
        if free > 0:
            self.at[free].append(bin_)
            self.bits |= 1 << free
            self.count += 1

    def open(self) -> list[tuple[int, int]]:
        """(bin, words in it) of every bin still open."""
        return [(b, self.capacity - free) for free, bins in enumerate(self.at) for b in bins]


@functools.lru_cache(2)
def _tokenizer(path: str | None):
    from tokenizers import Tokenizer
    if path is None:
        import public_tokenizers
        path = public_tokenizers.path("word_bpe_49k.json")
    return Tokenizer.from_file(path)


class WordIds:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    The words of many texts are parted and told apart by Arrow; Python sees each different
    one once. A word of letters is one pre-token, so A-Z lower-cased many of them are tokenised
    as one text and parted where an id ends a word; ASCII punctuation after it is another. Any
    other word is tokenised on its own. Words longer than ``longest`` aren't kept."""

    def __init__(self, path: str | None, most: int = 300_000, longest: int = 64):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the threads
        self.tokenizer, self.most, self.longest = _tokenizer(path), most, longest
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.once: set[bytes] = set()

    def of_texts(self, texts: pa.Array) -> tuple[memoryview, list[int]]:
        """The ids of all texts (binary, no nulls), and the bytes before each text and after the last."""
        parts = pc.ascii_split_whitespace(texts.view(pa.large_string() if pa.types.is_large_binary(texts.type)
                                                     else pa.string()))
        words = parts.flatten().dictionary_encode()
        ids = self._of_words(words.dictionary).take(words.indices)
        _, offsets, data = ids.buffers()
        stops = np.frombuffer(offsets, np.int64)[np.asarray(parts.offsets)]
        return memoryview(data or b""), stops.tolist()

    def learn(self, texts: list[list[bytes]]) -> None:
        self._of_words(pa.array(set(itertools.chain.from_iterable(texts)), pa.binary()).view(pa.string()))

    def of(self, found: list[bytes]) -> bytes:
        return bytes(self.of_texts(pa.array([b" ".join(found)], pa.binary()))[0])

    def _of_words(self, words: pa.Array) -> pa.Array:
        """The ids of each of some different words."""
        core = pc.ascii_rtrim(words, characters=string.punctuation)
        letters = np.array(pc.match_substring_regex(core, "^[A-Za-zÀ-ÖØ-öø-ÿ]+$"))
        strange = np.flatnonzero(~letters & ~np.array(pc.string_is_ascii(core)))
        letters[strange] = [_letters(w) for w in _bytes(core.take(pa.array(strange)))]
        keys = pc.if_else(pa.array(letters), pc.ascii_lower(core), words).dictionary_encode()
        cut = np.where(letters, np.array(pc.binary_length(core)), np.array(pc.binary_length(words)))
        marked = np.flatnonzero(cut < np.array(pc.binary_length(words)))
        marks = [w[n:] for w, n in zip(_bytes(words.take(pa.array(marked))), cut[marked].tolist(), strict=True)]
        found = _bytes(keys.dictionary)
        plain = np.zeros(len(found), bool)
        plain[np.array(keys.indices)] = letters
        which = {m: k for k, m in enumerate(set(marks), 1)}
        self._learn(dict(zip(found, plain.tolist(), strict=True)) | dict.fromkeys(which, False))
        mark = np.zeros(len(words), np.int64)
        mark[marked] = [which[m] for m in marks]
        ids = self.known.__getitem__
        return pc.binary_join_element_wise(
            pa.array(list(map(ids, found)), pa.large_binary()).take(keys.indices),
            pa.array([b"", *map(ids, which)], pa.large_binary()).take(pa.array(mark)),
            pa.scalar(b"", pa.large_binary()))

    def _learn(self, words: dict[bytes, bool]) -> None:
        """``words``: is each nothing but letters?"""
        for w in self.once:
            self.known.pop(w, None)
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.most:
            self.known.clear()
            new = list(words)
        self.once = {w for w in new if len(w) > self.longest}
        letters = [w for w in new if words[w]]
        other = [w for w in new if not words[w]]
        for i in range(0, len(letters), 1_000):
            self._together(letters[i:i + 1_000])
        for i in range(0, len(other), 1_000):
            part = other[i:i + 1_000]
            self.known.update(zip(part, self._alone(part), strict=True))

    def _alone(self, words: list[bytes]) -> list[bytes]:
        done = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words],
                                                add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in done]

    def _together(self, words: list[bytes]) -> None:
        done, = self.tokenizer.encode_batch_fast([b" ".join(words).decode()], add_special_tokens=False)
        ids = np.array(done.ids, "<u4")
        ends = 4 * (np.flatnonzero(self.ends[ids]) + 1)
        if len(ends) != len(words):  # a tokenizer that marks no word ends
            self.known.update(zip(words, self._alone(words), strict=True))
            return
        flat = ids.tobytes()
        for w, a, b in zip(words, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
            self.known[w] = flat[a:b]


def _bytes(words: pa.Array) -> list[bytes]:
    """The words of a string or large string array without nulls, as they are."""
    _, offsets, data = words.buffers()
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    at = np.frombuffer(offsets, kind)[words.offset:words.offset + len(words) + 1].tolist() if len(words) else []
    flat = data.to_pybytes() if data else b""
    return [flat[a:b] for a, b in itertools.pairwise(at)]


def _letters(word: bytes) -> bool:
    """Is a word nothing but letters after normalising and lower-casing?"""
    try:
        text = word.decode()
    except UnicodeDecodeError:
        return False
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


@functools.lru_cache(1)
def word_ids(path: str | None) -> WordIds:
    """Kept from task to task of one Python worker."""
    return WordIds(path)


common.KEPT.append(word_ids.cache_clear)


#: Bytes of texts whose words are looked up together; bounds what one slice holds.
SLICE = 2_000_000


def _first_pass(docs: DataFrame, s: Settings, with_ids: bool) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = (f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, task int, bin long, "
              "offset long, left_open boolean" + (", ids binary" if with_ids else ""))

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get().partitionId()
        common.release(but=word_ids.cache_clear)
        words, bins = word_ids(s.tokenizer), BestFit(s.capacity, s.open_bins)
        end = s.end_id.to_bytes(4, "little")
        wide = 4 * s.capacity
        names = [c.split()[0] for c in schema.split(", ")]
        id_type = None

        def table(rows):
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            kinds = [id_type, pa.int32(), *[pa.int64()] * 3, pa.int32(), *[pa.int64()] * 2, pa.bool_(), pa.binary()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds[:len(names)], strict=True)], names=names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            ids = batch.column(0).to_pylist()
            texts = pc.fill_null(batch.column(1), b"")
            sizes = np.cumsum(np.array(pc.binary_length(texts), np.int64))
            at, before = 0, 0
            while at < len(ids):
                first, at = at, int(np.searchsorted(sizes, before + SLICE)) + 1
                before = sizes[min(at, len(ids)) - 1]
                flat, stops = words.of_texts(texts[first:at])
                rows = []
                for doc, (a, z) in zip(ids[first:at], itertools.pairwise(stops), strict=True):
                    code = bytes(flat[a:z]) + end
                    for k, b in enumerate(range(0, len(code), wide)):
                        own = code[b:b + wide]
                        bin_, offset = bins.put(len(own) // 4)
                        rows.append((doc, k, b // 4, len(own) // 4, zlib.crc32(own), task, bin_, offset,
                                     False, *([own] if with_ids else [])))
                yield table(rows)
        if id_type is not None:
            yield table([(None, None, None, fill, None, task, bin_, None, True, *([None] if with_ids else []))
                         for bin_, fill in bins.open()])

    given = docs.select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    return given.mapInArrow(run, schema)


def _merge_open(left: DataFrame, s: Settings, tasks: int) -> DataFrame:
    """(task, bin, sequence, shift): where the open bins of every task end up.

    Each round packs the open bins of ``merge`` neighbouring groups; bins that close
    are final, those still open go to the next round."""
    def repack(pdf: pd.DataFrame) -> pd.DataFrame:
        fit = BestFit(s.capacity, s.open_bins)
        pdf = pdf.sort_values(["fill", "owner"], ascending=False, kind="stable")
        put = [fit.put(int(n)) for n in pdf["fill"]]
        still = dict(fit.open())
        first: dict[int, int] = {}
        for (b, _), owner in zip(put, pdf["owner"], strict=True):
            first.setdefault(b, int(owner))  # a sequence is named after its first member
        return pd.DataFrame({"owner": pdf["owner"], "to": [first[b] for b, _ in put],
                             "shift": [o for _, o in put],
                             "still": [b in still for b, _ in put],
                             "total": [still.get(b, 0) for b, _ in put]})

    moves = left.select("task", "bin", F.shiftleft(F.col("task").cast("long"), 40)
                        .bitwiseOR(F.col("bin")).alias("owner"), F.col("length").alias("fill"))
    start = moves.select("owner", F.col("owner").alias("to"), F.lit(0).cast("long").alias("shift"))
    items = stage(moves.select("owner", "fill"))
    where = stage(start)
    groups, span = tasks, 1
    while groups > 1:
        span *= s.merge
        packed = stage(items.withColumn("group", F.shiftright("owner", 40) / span)
                       .groupBy(F.floor("group").alias("group"))
                       .applyInPandas(repack, "owner long, to long, shift long, still boolean, total long"))
        step = packed.select(F.col("owner").alias("to"), F.col("to").alias("_to"),
                             F.col("shift").alias("_shift"))
        where = stage(where.join(step, "to", "left")
                      .select("owner", F.coalesce("_to", "to").alias("to"),
                              (F.col("shift") + F.coalesce("_shift", F.lit(0))).alias("shift")))
        items = (packed.filter("still and owner = to")
                 .select("owner", F.col("total").alias("fill")))
        groups = -(-groups // s.merge)
    return where


def pack(docs: DataFrame, settings: Settings = Settings(), text: str = "text",
         doc_id: str = "doc_id", with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece, and its
    ids (little-endian, four bytes each) when ``with_ids``."""
    s = settings
    docs = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    first = stage(_first_pass(docs, s, with_ids))
    left = first.filter("left_open")
    tasks = (first.agg(F.max("task")).first()[0] or 0) + 1
    where = _merge_open(left, s, tasks)
    own = F.shiftleft(F.col("task").cast("long"), 40).bitwiseOR(F.col("bin"))
    pieces = first.filter("not left_open").withColumn("owner", own)
    return (pieces.join(where, "owner", "left")
            .select("doc_id", "piece", "start", "length", "ids_crc32",
                    F.coalesce("to", "owner").alias("sequence_id"),
                    (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"),
                    *(["ids"] if with_ids else [])))
