"""A language model by deleted interpolation, and its score for every text.

Maximum-likelihood estimates of all orders (n-gram, ..., unigram, uniform) are
mixed with weights that depend on how often the context was seen (buckets of
powers of two). The weights are learned by expectation maximisation on counts
held out from the training texts: one fold of them is left out of the counts, and
the weights are those under which the fold is likeliest. The final estimates
count the fold too.

The model is as large as the corpus, so it is never brought to the texts whole.
Texts are gathered into chunks of bounded size, as numbers into a vocabulary of
their own. Each chunk asks once for every different n-gram it holds; the request
carries the chunk's own count, so the requests are also the counts. They meet by
ranges of the n-gram's 64-bit hash, where they are summed, and an answer goes
back for those n-grams that other chunks hold as well. A common n-gram is thus
one row per chunk and range, not one per occurrence. Requests are packed into
one row per chunk and range (never more rows than there are n-grams).

Jobs: gather (written), count (written: answers), a pass per step of expectation
maximisation over the fold's distinct count tuples (written), score.

Results in special cases: null and empty texts are the end alone; repeated rows
each count and get a row each; without training texts every token is uniform
over one unknown; without a held-out fold the weights stay equal; an empty
table gives no rows; extra columns are ignored. Texts of any length count whole;
one text is held by one task.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spark_analog.llm.common import Codes, lower_words, mix, word_hash
from spark_analog.operators.staging import stage

END, START = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F  # stand for the end of a text and its start


@dataclass(frozen=True)
class Settings:
    """``order``: longest n-gram; ``chunk``: tokens gathered (a longer text is a chunk of
    its own); ``range_keys``: n-grams summed together, about; ``tolerance``: gain in mean
    log likelihood (base 10) below which the maximisation has converged."""
    order: int = 2
    folds: int = 10
    chunk: int = 2_000_000
    range_keys: int = 2_000_000
    smoothing: float = 0.1
    tolerance: float = 1e-5


def pack(x: np.ndarray) -> bytes:
    """Integers of 8 bytes, byte by byte of equal weight, compressed."""
    import zstandard
    return zstandard.ZstdCompressor(level=1).compress(
        np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes())


def unpack(b: bytes) -> np.ndarray:
    import zstandard
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(b), np.uint8)
    return np.ascontiguousarray(raw.reshape(8, -1).T).view("<u8").ravel()


def pack_sorted(x: np.ndarray) -> bytes:
    return pack(np.diff(x, prepend=np.uint64(0)))


def unpack_sorted(b: bytes) -> np.ndarray:
    return np.cumsum(unpack(b), dtype=np.uint64)


# --- gather -----------------------------------------------------------------

def _gather(docs: DataFrame, s: Settings) -> DataFrame:
    """One row per chunk: chunk, part (1: held out for the weights), ids, sizes, train, tokens,
    vocab, and the sums n_train (tokens) and n_tokens."""
    kind = docs.schema["id"].dataType.simpleString()
    schema = (f"chunk long, part int, ids array<{kind}>, sizes binary, train binary, tokens binary, "
              "vocab binary, n_train long, n_tokens long")

    def run(batches):
        from pyspark import TaskContext
        task, made = TaskContext.get().partitionId(), 0
        cache = Codes(word_hash)

        class Chunk:
            def __init__(self):
                self.ids, self.sizes, self.train, self.parts, self.n = [], [], [], [], 0
                self.vocab = {}

            def add(self, id_, train, found):
                vocab = self.vocab
                self.parts.append(np.fromiter(
                    (vocab.setdefault(w, len(vocab) + 2) for w in found), np.int64, len(found)))
                self.parts.append(np.array([1]))  # the end; 0 is the start
                self.ids.append(id_)
                self.train.append(train)
                self.sizes.append(len(found) + 1)
                self.n += len(found) + 1

            def row(self, part, id_type):
                nonlocal made
                made += 1
                sizes = np.array(self.sizes)
                train = np.array(self.train)
                hashes = np.concatenate([np.array([START, END], np.uint64), cache.of(list(self.vocab))])
                return pa.RecordBatch.from_arrays(
                    [pa.array([task << 24 | made]), pa.array([part], pa.int32()),
                     pa.array([self.ids], pa.list_(id_type)), pa.array([pack(sizes)]),
                     pa.array([pack(train)]), pa.array([pack(np.concatenate(self.parts))]),
                     pa.array([hashes.tobytes()], pa.binary()), pa.array([int(sizes[train > 0].sum())]),
                     pa.array([int(sizes.sum())])],
                    names=[c.split()[0] for c in schema.split(", ")])

        held, id_type = [Chunk(), Chunk()], None
        for b in batches:
            id_type = b.schema.field("id").type
            for id_, train, part, text in zip(*(b.column(c).to_pylist() for c in ("id", "train", "part")),
                                              b.column("text"), strict=True):
                held[part].add(id_, train, lower_words(text.as_py()))
                if held[part].n >= s.chunk:
                    yield held[part].row(part, id_type)
                    held[part] = Chunk()
        for part, c in enumerate(held):
            if c.n:
                yield c.row(part, id_type)

    return docs.mapInArrow(run, schema)


class Grams:
    """The n-grams of a chunk: for each order the sorted keys, every token's place among
    them, and how often training texts hold them."""

    def __init__(self, tokens: np.ndarray, vocab: np.ndarray, sizes: np.ndarray, train: np.ndarray, order: int):
        self.sizes = sizes
        self.keys, self.at, self.own = [], [], []
        starts = np.cumsum(sizes) - sizes
        learned = np.repeat(train > 0, sizes)
        rank = np.empty(len(vocab), np.int64)
        by_value = np.argsort(vocab)
        rank[by_value] = np.arange(len(vocab))
        word = rank[tokens]
        self._add(vocab[by_value], word, learned)
        self.own[0][rank[0]] = int((train > 0).sum())  # the start, before every text
        ids, hashes = word, vocab[by_value]
        self.start = int(rank[0])
        before = self._shift(word, starts)
        for _ in range(2, order + 1):
            # history one word longer, then the word itself
            pair = before * len(vocab) + word
            different, at = np.unique(pair, return_inverse=True)
            h = mix(hashes[different // len(vocab)] * np.uint64(3) + mix(vocab[by_value][different % len(vocab)]))
            order_ = np.argsort(h)
            place = np.empty(len(h), np.int64)
            place[order_] = np.arange(len(h))
            ids, hashes = place[at], h[order_]
            self._add(hashes, ids, learned)
            before = self._shift(ids, starts)
            if len(self.keys) < order:
                # a history that reaches over the start is the start and what follows
                hashes = np.append(hashes, vocab[by_value][self.start])
                before[starts] = len(hashes) - 1

    def _add(self, keys, at, learned):
        self.keys.append(keys)
        self.at.append(at)
        self.own.append(np.bincount(at[learned], minlength=len(keys)))

    def _shift(self, ids, starts):
        before = np.empty_like(ids)
        before[1:] = ids[:-1]
        before[starts] = self.start
        return before


def _grams(row: dict, order: int) -> Grams:
    return Grams(unpack(row["tokens"]).astype(np.int64), np.frombuffer(row["vocab"], np.uint64),
                 unpack(row["sizes"]).astype(np.int64), unpack(row["train"]).astype(np.int64), order)


# --- count ------------------------------------------------------------------

def _requests(chunks: DataFrame, ranges: int, s: Settings) -> DataFrame:
    edges = np.array([(i << 64) // ranges for i in range(1, ranges)], np.uint64)

    def run(batches):
        for b in batches:
            for row in b.to_pylist():
                g = _grams(row, s.order)
                for n, (keys, own) in enumerate(zip(g.keys, g.own, strict=True), 1):
                    cut = [0, *np.searchsorted(keys, edges).tolist(), len(keys)]
                    live = [i for i in range(ranges) if cut[i] < cut[i + 1]]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(live, pa.int32()), pa.array([n] * len(live), pa.int32()),
                         pa.array([row["chunk"]] * len(live), pa.int64()), pa.array([row["part"]] * len(live), pa.int32()),
                         pa.array([cut[i] for i in live], pa.int64()),
                         pa.array([pack_sorted(keys[cut[i]:cut[i + 1]]) for i in live], pa.binary()),
                         pa.array([pack(own[cut[i]:cut[i + 1]]) for i in live], pa.binary())],
                        names=["range", "n", "chunk", "part", "first", "keys", "own"])
    return chunks.mapInArrow(run, "range int, n int, chunk long, part int, first long, keys binary, own binary")


def _sum(table: pa.Table) -> pa.Table:
    """Answers of one range and order, and one row with the number of learned keys (chunk null).

    An answer names n-grams by their place among the chunk's sorted keys, which the chunk
    works out again; places next to each other pack into a byte or two."""
    n, chunk, part, first = (table.column(c).to_pylist() for c in ("n", "chunk", "part", "first"))
    keys = [unpack_sorted(k) for k in table.column("keys").to_pylist()]
    own = [unpack(o).astype(np.int64) for o in table.column("own").to_pylist()]
    every, count = np.concatenate(keys), np.concatenate(own)
    held = np.repeat(np.array(part), [len(k) for k in keys])
    _, at = np.unique(every, return_inverse=True)
    kept = np.bincount(at[held == 0], count[held == 0], minlength=at.max() + 1).astype(np.int64)
    left = np.bincount(at[held == 1], count[held == 1], minlength=at.max() + 1).astype(np.int64)
    rows, pos = [], 0
    for c, p, f, k, o in zip(chunk, part, first, keys, own, strict=True):
        i = at[pos:pos + len(k)]
        pos += len(k)
        more = (kept[i] + left[i]) != o
        rows.append((c, p, pack_sorted((f + np.flatnonzero(more)).astype(np.uint64)), pack(kept[i][more]),
                     pack(left[i][more]), None))
    rows.append((None, None, None, None, None, int(((kept + left) > 0).sum())))
    cols = list(zip(*rows, strict=True))
    return pa.Table.from_arrays(
        [pa.array([n[0]] * len(rows), pa.int32()), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()),
         *[pa.array(c, pa.binary()) for c in cols[2:5]], pa.array(cols[5], pa.int64())],
        names=["n", "chunk", "part", "places", "kept", "left", "learned"])


class Counts:
    """Counts of all n-grams of a chunk: its own where no other chunk holds them."""

    def __init__(self, grams: Grams, part: int, answers: list[dict]):
        self.kept = [np.where(part == 0, o, 0) for o in grams.own]
        self.left = [np.where(part == 1, o, 0) for o in grams.own]
        for a in answers:
            at = unpack_sorted(a["places"]).astype(np.int64)
            self.kept[a["n"] - 1][at] = unpack(a["kept"]).astype(np.int64)
            self.left[a["n"] - 1][at] = unpack(a["left"]).astype(np.int64)


def estimates(grams: Grams, counts: list[np.ndarray], total: int, starts: int) -> tuple[list, np.ndarray]:
    """Counts (n-gram, context) of each order from the longest, for every token; context
    counts of the longest order."""
    first = np.cumsum(grams.sizes) - grams.sizes
    out = []
    for n in range(len(grams.at), 0, -1):
        own = counts[n - 1][grams.at[n - 1]]
        if n == 1:
            context = np.full(len(own), total)
        else:
            context = np.empty(len(own), np.int64)
            context[1:] = counts[n - 2][grams.at[n - 2][:-1]]
            context[first] = starts
        out.append((own, context))
    return out


def bucket(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(context + 1.0).astype(np.int64), BUCKETS - 1)


BUCKETS = 40


def likelihoods(pairs: list, unseen: float) -> np.ndarray:
    """Maximum-likelihood estimates, a column per order from the longest, then uniform."""
    cols = [np.divide(c, t, out=np.zeros(len(c)), where=t > 0) for c, t in pairs]
    return np.stack([*cols, np.full(len(cols[0]), unseen)], 1)


# --- weights ----------------------------------------------------------------

def _tuples(found: DataFrame, s: Settings, total: int, starts: int) -> DataFrame:
    """Distinct count tuples of the held-out fold and how often they occur."""
    names = [f"{c}{n}" for n in range(s.order, 0, -1) for c in ("c", "t")]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        g = _grams(row, s.order)
        counts = Counts(g, row["part"], right.to_pylist()).kept
        pairs = estimates(g, counts, total, starts)
        learned = np.repeat(unpack(row["train"]) > 0, g.sizes)
        x = np.stack([v for p in pairs for v in p], 1)[learned]
        x, times = np.unique(x, axis=0, return_counts=True)
        return pa.Table.from_arrays([*[pa.array(x[:, i]) for i in range(x.shape[1])], pa.array(times)],
                                    names=[*names, "times"])

    chunks, answers = found
    joined = (chunks.filter("part = 1").groupBy("chunk").cogroup(answers.filter("part = 1").groupBy("chunk"))
              .applyInArrow(run, ", ".join(f"{n} long" for n in [*names, "times"])))
    return stage(joined)


def learn_weights(tuples: DataFrame, s: Settings, unseen: float) -> tuple[np.ndarray, int]:
    """Weights (bucket x component) at the maximum, and the steps it took."""
    parts = s.order + 1
    weights = np.full((BUCKETS, parts), 1 / parts)

    def sums(w: np.ndarray) -> np.ndarray:
        def run(batches):
            total = np.zeros((BUCKETS, parts + 2))
            for b in batches:
                x = [b.column(i).to_numpy() for i in range(b.num_columns)]
                pairs = [(x[2 * i], x[2 * i + 1]) for i in range(s.order)]
                k = bucket(pairs[0][1])
                p = w[k] * likelihoods(pairs, unseen)
                all_ = p.sum(1)
                times = x[-1].astype(float)
                post = p / all_[:, None] * times[:, None]
                for j in range(parts):
                    total[:, j] += np.bincount(k, post[:, j], minlength=BUCKETS)
                total[:, parts] += np.bincount(k, times, minlength=BUCKETS)
                total[:, parts + 1] += np.bincount(k, times * np.log10(all_), minlength=BUCKETS)
            yield pa.RecordBatch.from_pydict({
                "i": pa.array(np.arange(total.size), pa.int32()), "v": pa.array(total.ravel())})
        rows = tuples.mapInArrow(run, "i int, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        out = np.zeros(BUCKETS * (parts + 2))
        for r in rows:
            out[r.i] = r.v
        return out.reshape(BUCKETS, parts + 2)

    before, steps = None, 0
    while True:
        found = sums(weights)
        n = found[:, parts].sum()
        if not n:
            return weights, steps
        mean = found[:, parts + 1].sum() / n
        if before is not None and mean - before < s.tolerance:
            return weights, steps
        seen = found[:, parts] > 0
        weights[seen] = found[seen, :parts] / found[seen, parts:parts + 1]
        # no component may die out, or a token without counts would be impossible
        weights = np.maximum(weights, 1e-9)
        weights /= weights.sum(1, keepdims=True)
        before, steps = mean, steps + 1


# --- score ------------------------------------------------------------------

def score(docs: DataFrame, train: Column, part: Column, settings: Settings = Settings(),
          text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score of every text.

    ``train``: does the row teach? ``part``: is a row that teaches in the fold held out
    for the weights?"""
    s = settings
    given = docs.select(F.col(f"`{doc_id}`").alias("id"), train.cast("int").alias("train"),
                        (train & part).cast("int").alias("part"),
                        F.col(f"`{text}`").cast("string").cast("binary").alias("text"))
    kind = given.schema["id"].dataType.simpleString()
    chunks = stage(_gather(given, s))
    sums = chunks.groupBy().agg(F.sum("n_train"), F.sum("n_tokens"), F.sum(F.when(F.col("part") == 0, F.col("n_train")))).first()
    total, tokens, kept_total = (int(v or 0) for v in sums)
    runs = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranges = max(runs, -(-tokens // s.range_keys))
    counted = stage(_requests(chunks, ranges, s).groupBy("range", "n").applyInArrow(
        _sum, "n int, chunk long, part int, places binary, kept binary, left binary, learned long"))
    answers = counted.filter("chunk is not null").drop("learned")
    words = int(counted.filter("chunk is null and n = 1").agg(F.sum("learned")).first()[0] or 0)
    texts = _texts(chunks)
    starts = int(texts[0])
    kept_starts = int(texts[1])
    vocabulary = max(0, words - (1 if starts else 0))  # the start is no token
    unseen = 1 / (vocabulary + 1)
    tuples = _tuples((chunks, answers), s, kept_total, kept_starts)
    weights, _ = learn_weights(tuples, s, unseen)
    floor = total + s.smoothing * (vocabulary + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        g = _grams(row, s.order)
        found = Counts(g, row["part"], right.to_pylist())
        counts = [k + v for k, v in zip(found.kept, found.left, strict=True)]
        pairs = estimates(g, counts, total, starts)
        p = (weights[bucket(pairs[0][1])] * likelihoods(pairs, unseen)).sum(1)
        c = pairs[-1][0]
        first = np.cumsum(g.sizes) - g.sizes
        base = np.add.reduceat(np.log10((c + s.smoothing) / floor), first)
        known = np.add.reduceat((c > 0).astype(np.int64), first)
        return pa.Table.from_arrays(
            [pa.array(row["ids"], left.schema.field("ids").type.value_type), pa.array(g.sizes), pa.array(known),
             pa.array([total] * len(g.sizes), pa.int64()), pa.array(base),
             pa.array(np.add.reduceat(np.log10(p), first))],
            names=["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return (chunks.groupBy("chunk").cogroup(answers.groupBy("chunk"))
            .applyInArrow(run, f"doc_id {kind}, n_tokens long, n_known long, train_tokens long, "
                               "base_score double, score double"))


def _texts(chunks: DataFrame) -> tuple[int, int]:
    """Texts that teach, and those of them outside the held-out fold."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "part": b.column("part"),
                "n": pa.array([int((unpack(t) > 0).sum()) for t in b.column("train").to_pylist()], pa.int64())})
    rows = (chunks.select("part", "train").mapInArrow(run, "part int, n long")
            .groupBy("part").agg(F.sum("n").alias("n")).collect())
    n = {r.part: r.n for r in rows}
    return sum(n.values()), n.get(0, 0)
