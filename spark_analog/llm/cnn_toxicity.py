"""Toxicity by a small convolutional text classifier trained in numpy.

A word is the sum of two hashed embeddings (the word and its first four
letters). Filters of several widths slide over the whole text, the maximum over
all positions of each filter goes into a logistic layer. The net is trained by
Adagrad on every labelled text: texts are dealt to shards by a hash, the first
shard trains the net that all others start from, each in a task of its own, and
what they learn is averaged. Every text of the part that is held back sets the
thresholds, one per language, and the score is moved so that 0.5 is that
threshold. The language is read off the text itself (function words), never
from a column.

Scoring is one narrow pass: texts are not shuffled, the model (about 1 MB) is
broadcast, and memory per text is linear in its length, in slices.

Results in special cases: null and empty texts have no word and score what the
net gives to no match at all (below the threshold after training); without
labelled rows, or with one label only, every text scores the share of label 1
(0 without rows); repeated rows score alike; an empty table gives no rows.
"""

from __future__ import annotations

import copy
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from spark_analog.llm.common import Codes, annotate, fold, word_hash
from spark_analog.llm.labelled import label_share
from spark_analog.llm.token_groups import bitmap, in_bitmap
from spark_analog.operators.ordered import running_by_value
from spark_analog.operators.staging import stage

#: Function words that tell a language.
LANGUAGES = {
    "en": "the of and to in is that it for was with as be on by this are from at",
    "fr": "le la les des et un une du est dans pour que qui par sur pas au avec",
    "de": "der die das und den von zu mit sich des auf für ist im dem nicht ein eine",
    "es": "el la los las de que y en un una por con para del se no su al es",
}
_WORDS = {k: frozenset(w.encode() for w in v.split()) for k, v in LANGUAGES.items()}
_NAMES = [*LANGUAGES, "other"]


@dataclass(frozen=True)
class Settings:
    """``toxic`` and ``clean`` together: texts of a shard, ``most_bytes``: bytes of a shard's texts, both on
    average; no text is left out or cut. ``later``: passes over the shards after the first."""
    toxic: int = 2000
    clean: int = 2400
    most_bytes: int = 1 << 26
    words: int = 1 << 14
    prefixes: int = 1 << 12
    width: int = 16
    filters: int = 16
    spans: tuple[int, ...] = (1, 2, 3)
    epochs: int = 8
    least_steps: int = 400
    later: int = 2
    batch: int = 48
    rate: float = 0.12
    held_back: float = 0.25
    folds: int = 5
    seed: int = 11


def word_code(s: Settings):
    letters = " .,;:!?\"'()[]|#*$%&<>-"

    def code(word: bytes) -> int:
        bare = word.decode("utf-8", "replace").strip(letters)
        tongue = sum(1 << i for i, k in enumerate(LANGUAGES) if bare.encode() in _WORDS[k])
        return (1 + word_hash(bare.encode()) % (s.words - 1)
                | (1 + word_hash(b"^" + bare[:4].encode()) % (s.prefixes - 1)) << 24 | tongue << 48)
    return code


def lay_out(texts: list[list[bytes]], codes: Codes, pad: int):
    """Codes of many texts in one array, ``pad`` empty places after each; starts; languages."""
    return lay_codes([codes.of(found) for found in texts], pad)


def lay_codes(texts: list[np.ndarray], pad: int):
    """``lay_out`` of texts that are codes already."""
    parts, starts, tongues, at = [], [], [], 0
    for c in texts:
        hits = [int(((c >> np.uint64(48 + i)) & np.uint64(1)).sum()) for i in range(len(LANGUAGES))]
        tongues.append(int(np.argmax(hits)) if max(hits) else len(LANGUAGES))
        parts += [c, np.zeros(max(pad, 1), np.uint64)]
        starts.append(at)
        at += len(c) + max(pad, 1)
    flat = np.concatenate(parts) if parts else np.empty(0, np.uint64)
    return ((flat & np.uint64(0xFFFFFF)).astype(np.int64),
            ((flat >> np.uint64(24)) & np.uint64(0xFFFFFF)).astype(np.int64),
            np.array(starts, np.int64), np.array(tongues, np.int64))


def _code_bits(s: Settings) -> tuple[int, int] | None:
    """Bits of a word and of a prefix where a code fits 32 bits."""
    bits = (s.words - 1).bit_length(), (s.prefixes - 1).bit_length()
    return bits if sum(bits) + len(LANGUAGES) <= 32 else None


def pack_codes(codes: np.ndarray, s: Settings) -> np.ndarray:
    """Codes in half their bytes, where the settings allow it."""
    bits = _code_bits(s)
    if bits is None:
        return codes
    part = lambda at, to: (codes >> np.uint64(at) & np.uint64(0xFFFFFF)) << np.uint64(to)
    return (part(0, 0) | part(24, bits[0]) | part(48, sum(bits))).astype(np.uint32)


def unpack_codes(cell: bytes, s: Settings) -> np.ndarray:
    """The codes that ``pack_codes`` made the bytes of ``cell`` from."""
    bits = _code_bits(s)
    if bits is None:
        return np.frombuffer(cell, np.uint64)
    found = np.frombuffer(cell, np.uint32).astype(np.uint64)
    part = lambda at, size, to: (found >> np.uint64(at) & np.uint64((1 << size) - 1)) << np.uint64(to)
    return part(0, bits[0], 0) | part(bits[0], bits[1], 24) | part(sum(bits), len(LANGUAGES), 48)


@dataclass
class Net:
    s: Settings
    word: np.ndarray
    prefix: np.ndarray
    kernels: list[np.ndarray]   # span x width x filters
    shifts: list[np.ndarray]    # filters
    out: np.ndarray
    bias: np.ndarray
    cut: dict[str, float] = field(default_factory=dict)
    constant: float | None = None

    def maxima(self, x: np.ndarray, starts: np.ndarray, where: bool = False):
        """Largest answer of every filter in every text (and the place of it)."""
        tops, places = [], []
        for kernel, shift in zip(self.kernels, self.shifts, strict=True):
            y = x @ kernel[0]
            for j in range(1, len(kernel)):
                y[:-j] += x[j:] @ kernel[j]
            top = np.maximum.reduceat(y, starts, axis=0)
            tops.append(top + shift)
            if where:
                owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(y))))
                row, col = np.nonzero(y == top[owner])
                first = np.full(top.shape, len(y), np.int64)
                np.minimum.at(first, (owner[row], col), row)
                places.append(first)
        h = np.concatenate(tops, 1)
        return (h, places) if where else h

    def logits(self, words: np.ndarray, prefixes: np.ndarray, starts: np.ndarray) -> np.ndarray:
        x = self.word[words] + self.prefix[prefixes]
        return np.maximum(self.maxima(x, starts), 0) @ self.out + self.bias[0]

    def score(self, logit: np.ndarray, tongue: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(logit), self.constant)
        cut = np.array([self.cut[k] for k in _NAMES])[tongue]
        return 1 / (1 + np.exp(-np.clip(logit - cut, -30, 30)))


def new_net(s: Settings) -> Net:
    rng = np.random.default_rng(s.seed)
    r = lambda *n, scale: (rng.standard_normal(n) * scale).astype(np.float32)
    word, prefix = r(s.words, s.width, scale=0.1), r(s.prefixes, s.width, scale=0.1)
    word[0] = prefix[0] = 0
    return Net(s, word, prefix, [r(k, s.width, s.filters, scale=0.25 / k ** 0.5) for k in s.spans],
               [np.zeros(s.filters, np.float32) for _ in s.spans],
               r(s.filters * len(s.spans), scale=0.2), np.zeros(1, np.float32))


def _dense(net: Net) -> list[np.ndarray]:
    return [*net.kernels, *net.shifts, net.out, net.bias]


def new_past(net: Net) -> list[np.ndarray]:
    """Adagrad's sums of squares: of the dense parameters, the words and the prefixes."""
    return [np.full(p.shape, 1e-3, np.float32) for p in (*_dense(net), net.word[:, 0], net.prefix[:, 0])]


def train(texts: list[list[bytes]], y: np.ndarray, s: Settings) -> Net:
    net, codes = new_net(s), Codes(word_code(s))
    learn(net, new_past(net), [codes.of(t) for t in texts], y, first_passes(len(texts), s), float(y.mean()), s.seed + 1)
    return net


def first_passes(n: int, s: Settings) -> int:
    """A small shard is passed more often, so that it takes as many steps."""
    return max(s.epochs, -(-s.least_steps * s.batch // max(1, n)))


def learn(net: Net, past: list[np.ndarray], texts: list[np.ndarray], y: np.ndarray, passes: int, positive: float,
          seed: int) -> None:
    """Change ``net`` and ``past`` by some passes over the codes of texts; ``positive``: share of label 1."""
    s, rng = net.s, np.random.default_rng(seed)
    n, pad = len(texts), max(s.spans) - 1
    balance = np.where(y > 0, 0.5 / max(1e-9, positive), 0.5 / max(1e-9, 1 - positive))
    dense, (seen_w, seen_p) = _dense(net), past[-2:]
    for _ in range(passes):
        order = rng.permutation(n)
        for b in range(0, n, s.batch):
            at = order[b:b + s.batch]
            w, p, starts, _ = lay_codes([texts[i] for i in at], pad)
            x = net.word[w] + net.prefix[p]
            h, places = net.maxima(x, starts, where=True)
            a = np.maximum(h, 0)
            z = np.clip(a @ net.out + net.bias[0], -30, 30)
            g = ((1 / (1 + np.exp(-z)) - y[at]) * balance[at] / len(at)).astype(np.float32)
            dh = g[:, None] * net.out * (h > 0)
            grads_k, grads_s = [], []
            dx = {}
            for i, kernel in enumerate(net.kernels):
                own = dh[:, i * s.filters:(i + 1) * s.filters]
                gk = np.zeros_like(kernel)
                for j in range(len(kernel)):
                    spot = np.minimum(places[i] + j, len(x) - 1)           # texts x filters
                    gk[j] = np.einsum("bfw,bf->wf", x[spot], own)
                    live = own != 0
                    flow = (own[:, :, None] * kernel[j].T[None])[live]      # hits x width
                    dx.setdefault("at", []).append(spot[live])
                    dx.setdefault("g", []).append(flow)
                grads_k.append(gk)
                grads_s.append(own.sum(0))
            for q, (param, grad) in enumerate(zip(
                    dense, [*grads_k, *grads_s, a.T @ g, np.array([g.sum()])], strict=True)):
                past[q] += grad ** 2
                param -= (s.rate * grad / np.sqrt(past[q])).astype(np.float32)
            spot, flow = np.concatenate(dx["at"]), np.concatenate(dx["g"])
            for table, seen, ids in ((net.word, seen_w, w), (net.prefix, seen_p, p)):
                touched, inverse = np.unique(ids[spot], return_inverse=True)
                total = np.zeros((len(touched), s.width), np.float32)
                np.add.at(total, inverse, flow)
                seen[touched] += (total ** 2).mean(1)
                table[touched] -= s.rate * total / np.sqrt(seen[touched])[:, None]
                table[0] = 0


def calibrate(net: Net, held: DataFrame, names: list[str], share: float) -> None:
    """Threshold per language: the cut with the best F1 at the true share of label 1; between two
    neighbours, their middle. Languages with few rows use the common one. ``held``: ``y, codes`` of
    all texts held back; only counts per logit and one row per language leave the tasks."""
    shared = held.sparkSession.sparkContext.broadcast(net)

    def score(batches):
        known = shared.value
        for batch in batches:
            texts = [unpack_codes(c.as_py(), known.s) for c in batch.column(1)]
            for b in range(0, len(texts), known.s.batch):
                w, p, starts, tongue = lay_codes(texts[b:b + known.s.batch], max(known.s.spans) - 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([names[i] for i in tongue]), pa.array(known.logits(w, p, starts).astype(float)),
                     batch.column(0).slice(b, known.s.batch)], names=["k", "z", "y"])

    seen = held.select("y", "codes").mapInArrow(score, "k string, z double, y long")
    every = seen.select(F.explode(F.array(F.lit("*"), "k")).alias("k"), "z", "y")
    counts = stage(every.groupBy("k", "z").agg(F.sum("y").alias("p"), F.sum(1 - F.col("y")).alias("n")))
    totals = stage(counts.groupBy("k").agg(F.sum("p").alias("all_p"), F.sum("n").alias("all_n")))
    both = running_by_value(counts, ["k"], "z", {"up_p": "p", "up_n": "n"}, descending=True).join(totals, "k")
    up = share / (F.col("all_p") / (F.col("all_p") + F.col("all_n")))
    down = (1 - share) / (F.col("all_n") / (F.col("all_p") + F.col("all_n")))
    hit, reached, whole = up * F.col("up_p"), up * F.col("up_p") + down * F.col("up_n"), up * F.col("all_p")
    fits = reached <= 2 * whole  # a cut never lets most clean ones in
    best = both.filter("all_p > 0 and all_n > 0").groupBy("k", "all_p", "all_n").agg(
        F.max(F.when(fits, F.struct((2 * hit / (reached + whole)).alias("f1"), "z"))).alias("b"), F.max("z").alias("top"))
    best = stage(best.select("k", "all_p", "all_n", F.col("b.z").alias("at"), "top"))
    below = counts.join(best.select("k", "at"), "k").filter(F.col("z") < F.col("at")).groupBy("k").agg(
        F.max("z").alias("under"))
    cut = {r.k: (r.top if r["at"] is None else r["at"] - 1 if r.under is None else (r["at"] + r.under) / 2,
                 min(r.all_p, r.all_n)) for r in best.join(below, "k", "left").collect()}
    common = cut.get("*", (0.0, 0))[0]
    net.cut = {k: cut[k][0] if k in cut and cut[k][1] >= 10 else common for k in names}


def _best_cut(logit: np.ndarray, y: np.ndarray, share: float) -> float:
    """The cut of ``calibrate`` for one language, on plain arrays."""
    if not len(y) or y.min() == y.max():
        return 0.0
    weight = np.where(y > 0, share / y.mean(), (1 - share) / (1 - y.mean()))
    order = np.argsort(logit, kind="stable")[::-1]
    z, hit = logit[order], np.cumsum((weight * y)[order])
    f1 = 2 * hit / (np.cumsum(weight[order]) + (weight * y).sum())
    ends = np.append(z[1:] < z[:-1], True)  # a cut lies between different values only
    ends &= np.cumsum(weight[order]) <= 2 * (weight * y).sum()  # and never lets most clean ones in
    if not ends.any():
        return float(z[0])
    best = int(np.argmax(np.where(ends, f1, -1)))
    return float((z[best] + z[best + 1]) / 2) if best + 1 < len(z) else float(z[best] - 1)


#: Bits of the map of labelled ids that every task has, 4 MB.
BITMAP_BITS = 1 << 25


def labelled_codes(docs: DataFrame, labels: DataFrame, label: str, s: Settings, text: str, doc_id: str) -> DataFrame:
    """``place, held, y, codes`` of every text whose id has a label and is not in fold 0, staged; an id
    labelled twice takes the larger label. ``place`` is a hash of the row, ``held`` goes by the id.

    Only codes meet the labels, and only those of ids in the map of labelled ids, which lets a few others
    through by chance; texts are never shuffled. The join is the same for tables of any size."""
    given = F.col(f"`{doc_id}`")
    ids = stage(labels.select(given.alias("id"), F.col(f"`{label}`").cast("long").alias("y"))
                .filter("id is not null and y in (0, 1)").filter(fold("id", s.folds) != 0)
                .groupBy("id").agg(F.max("y").alias("y")))
    alike = docs.schema[doc_id].dataType == labels.schema[doc_id].dataType  # else equal ids can hash differently
    labelled = bitmap(ids.select(F.xxhash64("id").alias("id")), "id", BITMAP_BITS) if alike else None
    shared = docs.sparkSession.sparkContext.broadcast(labelled)
    name = F.col("id").cast("string")
    rows = (docs.select(given.alias("id"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).cast("binary")
                        .alias("text")).filter("id is not null").filter(fold("id", s.folds) != 0)
            .select("id", F.xxhash64(name, "text").alias("place"),
                    (F.pmod(F.xxhash64(F.lit(s.seed), name), F.lit(10_000)) < int(10_000 * s.held_back)).alias("held"),
                    F.xxhash64("id").alias("key"), "text"))

    def encode(batches):
        codes, known = Codes(word_code(s)), shared.value
        for batch in batches:
            if known is not None:
                batch = batch.filter(pa.array(in_bitmap(known, batch.column(3).to_numpy(), BITMAP_BITS)))
            found = [pack_codes(codes.of(t.as_py().lower().split()), s).tobytes() for t in batch.column(4)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found, pa.binary())],
                                             names=["id", "place", "held", "codes"])

    kind = rows.schema["id"].dataType.simpleString()
    coded = rows.mapInArrow(encode, f"id {kind}, place long, held boolean, codes binary")
    return stage(coded.join(ids.hint("merge"), "id").select("place", "held", "y", "codes"))


#: Pieces in which the parameters of all shards are added.
PIECES = 64


def _learn_shards(rows: DataFrame, net: Net, past: list[np.ndarray], passes: int, shards: int, positive: float
                  ) -> tuple[Net, list[np.ndarray]]:
    """``net`` and ``past`` after every shard of ``rows`` (``shard, place, y, codes``) has learned from them
    on its own: the mean over the shards, weighted by their texts."""
    s = net.s
    shared = rows.sparkSession.sparkContext.broadcast((net, past))

    def work(batches):
        def close():
            own, sums = copy.deepcopy(shared.value)
            learn(own, sums, texts, np.array(y, float), passes, positive, s.seed + 1 + shard)
            flat = np.concatenate([p.astype(np.float32).reshape(-1) for p in (*_arrays(own), *sums)])
            return pa.RecordBatch.from_arrays(
                [pa.array(range(PIECES), pa.int32()), pa.array([shard] * PIECES, pa.int64()),
                 pa.array([len(y)] * PIECES, pa.int64()),
                 pa.array([p.tobytes() for p in np.array_split(flat, PIECES)], pa.binary())],
                names=["piece", "shard", "texts", "values"])

        shard, texts, y = None, [], []
        for batch in batches:
            for own, label, codes in zip(*(batch.column(c) for c in ("shard", "y", "codes")), strict=True):
                if shard is not None and own.as_py() != shard:
                    yield close()
                    texts, y = [], []
                shard = own.as_py()
                texts.append(unpack_codes(codes.as_py(), s))
                y.append(label.as_py())
        if texts:
            yield close()

    def mean(key, table):
        order = np.argsort(table.column("shard").to_numpy())
        size, values = table.column("texts").to_numpy(), table.column("values")
        total = sum(size[i] * np.frombuffer(values[int(i)].as_py(), np.float32).astype(float) for i in order)
        return pa.Table.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array(
            [(total / size.sum()).astype(np.float32).tobytes()], pa.binary())], names=["piece", "values"])

    done = (rows.select("shard", "place", "y", "codes").repartition(shards, "shard")
            .sortWithinPartitions("shard", "place", "y").mapInArrow(work, "piece int, shard long, texts long, values binary")
            .groupBy("piece").applyInArrow(mean, "piece int, values binary").collect())
    flat = np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(done, key=lambda r: r.piece)])
    net, past = copy.deepcopy((net, past))
    at = 0
    for p in (*_arrays(net), *past):
        p[...] = flat[at:at + p.size].reshape(p.shape)
        at += p.size
    return net, past


def _arrays(net: Net) -> list[np.ndarray]:
    return [net.word, net.prefix, *_dense(net)]


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", settings: Settings = Settings(),
        text: str = "text", doc_id: str = "doc_id") -> Net:
    s = settings
    rows = labelled_codes(docs, labels, label, s, text, doc_id)
    book = {(r.held, r.y): r for r in rows.groupBy("held", "y").agg(
        F.count("*").alias("n"), F.sum(F.octet_length("codes") * (2 if _code_bits(s) else 1)).alias("size")).collect()}

    def total(column, held=(True, False), y=(0, 1)):
        return sum(r[column] for k, r in book.items() if k[0] in held and k[1] in y)

    net = new_net(s)
    if not total("n", y=(0,)) or not total("n", y=(1,)):
        net.constant = total("n", y=(1,)) / total("n") if total("n") else 0.0
        return net
    share = label_share(labels, label, s.folds, doc_id)
    few = min(total("n", (True,), (y,)) for y in (0, 1)) < 10 or not all(
        total("n", (False,), (y,)) for y in (0, 1))  # too few held back to set a threshold
    taught, held = ((True, False),) * 2 if few else ((False,), (True,))
    n = total("n", taught)
    shards = max(-(-n // (s.toxic + s.clean)), -(-total("size", taught) // s.most_bytes))
    positive = total("n", taught, (1,)) / n
    dealt = rows.filter(F.col("held").isin(*taught)).withColumn("shard", F.pmod("place", F.lit(shards)))
    net, past = _learn_shards(dealt.filter("shard = 0"), net, new_past(net), first_passes(n // shards, s), 1, positive)
    if shards > 1:
        net, past = _learn_shards(dealt.filter("shard > 0"), net, past, s.later, shards - 1, positive)
    # a text's logit reads into the next text of its batch, so batches are the same in every layout
    tasks = -(-total("n", held) // (s.toxic + s.clean))
    ordered = rows.filter(F.col("held").isin(*held)).repartition(tasks, "place").sortWithinPartitions("place", "y")
    calibrate(net, ordered, _NAMES, share)
    return net


FIELDS = T.StructType([T.StructField("score", T.DoubleType()),
                       T.StructField("predicted", T.IntegerType()),
                       T.StructField("language", T.StringType())])
#: Words laid out at once while scoring; longer texts are one slice each.
SLICE = 200_000


def classify(docs: DataFrame, net: Net, text: str = "text",
             keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct of score, predicted and the language read off the text."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def make():
        known = shared.value
        codes, pad = Codes(word_code(known.s)), max(known.s.spans) - 1

        def run(texts):
            score, tongue = [np.empty(0)], [np.empty(0, np.int64)]
            part, size = [], 0
            for i, t in enumerate(texts):
                part.append(t.lower().split() if t else [])
                size += len(part[-1])
                if size >= SLICE or i == len(texts) - 1:
                    w, p, starts, own = lay_out(part, codes, pad)
                    score.append(known.score(known.logits(w, p, starts), own))
                    tongue.append(own)
                    part, size = [], 0
            got = np.concatenate(score)
            return {"score": got, "predicted": (got >= 0.5).astype(np.int32),
                    "language": [_NAMES[i] for i in np.concatenate(tongue)]}
        return run

    return annotate(docs, make, FIELDS, text, "toxicity", keep)
