"""What the operators share: words, folds, staged tables and Arrow passes over texts."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: White space that separates words; ``bytes.split()`` separates at the same six bytes.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"


def fold(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    col = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary")) % n


def words(text: bytes | None) -> list[bytes]:
    """Words of a text as they are."""
    return text.split() if text else []


def lower_words(text: bytes | None) -> list[bytes]:
    """Words after lower-casing A-Z only (``bytes.lower`` touches nothing else)."""
    return text.lower().split() if text else []


def free_name(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it while the frame has such a column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


#: Empties what an operator keeps in a Python worker from task to task.
KEPT: list[Callable[[], None]] = []


def release(but: Callable[[], None] | None = None) -> None:
    """Free what other operators left behind in this Python worker, which Spark uses for one after the other.
    ``but`` is not called: what it would empty stays."""
    for clear in KEPT:
        if clear != but:
            clear()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library: it keeps what it has freed


def annotate(df: DataFrame, make: Callable[[], Callable[[list], dict[str, np.ndarray]]],
             fields: T.StructType, text: str = "text", into: str = "result",
             keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """Append a struct computed from each whole text; one narrow Arrow pass, no shuffle.

    ``make`` runs once per task and returns the kernel: list of bytes (None for
    null) to a column for each field. ``keep`` are the columns handed on (all by
    default). Returns the frame and the name of the new column.
    """
    keep = df.columns if keep is None else keep
    name = free_name(df, into)
    body = free_name(df, "_text_bytes")
    given = df.select(*[F.col(f"`{c}`") for c in keep],
                      F.col(f"`{text}`").cast("string").cast("binary").alias(body))
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(name, fields)])
    kinds = [(f.name, to_arrow_type(f.dataType)) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        kernel = make()
        for batch in batches:
            if not batch.num_rows:
                continue
            out = kernel(batch.column(batch.num_columns - 1).to_pylist())
            made = pa.StructArray.from_arrays(
                [pa.array(out[n], type=k) for n, k in kinds], names=[n for n, _ in kinds])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], made], names=[*batch.schema.names[:-1], name])

    return given.mapInArrow(run, schema), name


def word_hash(word: bytes) -> int:
    import xxhash
    return xxhash.xxh3_64_intdigest(word)


class Codes(dict):
    """Cache from word to a number; emptied when it has grown past ``most``, which
    changes no result because every number is a function of the word alone."""

    def __init__(self, code: Callable[[bytes], int], most: int = 400_000):
        super().__init__()
        self.code, self.most = code, most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        value = self[word] = self.code(word)
        return value

    def of(self, found: list[bytes], dtype=np.uint64) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, found), dtype=dtype, count=len(found))


def mix(values: np.ndarray) -> np.ndarray:
    """Spread unsigned 64-bit numbers evenly (one-to-one)."""
    v = values.astype(np.uint64, copy=True)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    v *= np.uint64(0xD6E8FEB86659FD93)
    v ^= v >> np.uint64(32)
    return v


def chain(codes: np.ndarray, width: int) -> np.ndarray:
    """64-bit hashes of every run of ``width`` codes."""
    n = len(codes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(width):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + codes[k:k + n])
    return h


class WordHashes:
    """64-bit hashes of the words of many texts at once, without a Python step per word.

    A word's hash is a polynomial in numbers drawn per byte, modulo 2 ** 64, read off
    running sums over all bytes; it depends on the word alone."""

    _BASE = 0x5851F42D4C957F2D

    def __init__(self):
        rng = np.random.default_rng(20)
        self.draw = rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.blank = np.zeros(256, bool)
        self.blank[list(b" \t\n\x0b\x0c\r")] = True
        self.up = self.down = np.ones(1, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            back = pow(self._BASE, -1, 1 << 64)
            for name, base in (("up", self._BASE), ("down", back)):
                steps = np.full(n, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))

    def of(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """(hashes, ends): the words of text i are hashes[ends[i - 1]:ends[i]]."""
        blob = b"\n" + b"\n".join(t or b"" for t in texts) + b"\n"
        raw = np.frombuffer(blob, np.uint8)
        self._powers(-(-len(raw) // (1 << 18)) << 18)
        edge = np.flatnonzero(np.diff(self.blank[raw])) + 1
        first, last = edge[::2], edge[1::2]
        sums = np.zeros(len(raw) + 1, np.uint64)
        np.cumsum(self.draw[raw] * self.up[:len(raw)], dtype=np.uint64, out=sums[1:])
        h = (sums[last] - sums[first]) * self.down[first]
        stops = np.cumsum([len(t or b"") + 1 for t in texts])
        return mix(h + (last - first).astype(np.uint64)), np.searchsorted(first, stops)
