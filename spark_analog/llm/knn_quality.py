"""Quality by nearest-neighbour voting in a latent-semantic space.

Texts become counts of hashed terms (words, word shapes, and marks for words
that repeat), weighted by tf-idf and projected on the leading singular vectors
of a bounded sample of labelled texts. The sample's vectors are broadcast: at
most ``sample`` rows of ``rank`` numbers (3 MB with the defaults, whatever the
corpus). Every document is compared with all of them by blocked matrix
products; its ``neighbours`` nearest vote with their cosine, raised to
``sharpness``, as weight. No shuffle of texts takes place.

Results in special cases: null and empty texts, and all texts when nothing is
labelled, score the share of label 1 in the sample (0.5 without labels); with
one label only that label's value; repeated rows score alike; ties among
neighbours go to the row earlier in the sample; an empty table gives no rows.
Labels are learned only from rows outside fold 0; language, source and id are
never inputs.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from spark_analog.llm.common import Codes, annotate, chain, word_hash
from spark_analog.llm.labelled import label_share, training_ids, training_texts

WORDS, SHAPES, MARKS = 1500, 500, 48
TERMS = WORDS + SHAPES + MARKS


@dataclass(frozen=True)
class Settings:
    """``sample`` bounds the labelled rows of the fit (as many of each label at most as
    its half allows), ``most_bytes`` their texts: one longer than its equal share of them (44,739
    bytes) is not learned from. Every text is scored whole. ``block`` is how many documents are
    compared at once."""
    sample: int = 6000
    most_bytes: int = 1 << 28
    rank: int = 64
    neighbours: int = 25
    sharpness: float = 4.0
    threshold: float = 0.3
    folds: int = 5
    seed: int = 7
    block: int = 256


_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: _case(m.group())), (re.compile(r"\d+"), "0"))
_SAME = re.compile(r"(.)\1+")


def _case(letters: str) -> str:
    if letters.islower():
        return "a"
    if letters.isupper():
        return "A" if len(letters) > 1 else "X"
    return "Xa" if letters[0].isupper() and letters[1:].islower() else "xX"


def word_shape(word: str) -> str:
    for pattern, by in _SHAPES:
        word = pattern.sub(by, word)
    return _SAME.sub(r"\1\1", word)[:12]


def term_code(word: bytes) -> int:
    """Three numbers in one: word term, shape term, and 32 bits of the word's own hash."""
    text = word.decode("utf-8", "replace")
    shape = word_shape(text)
    bare = text.strip(".,;:!?\"'()[]|#*$%&<>").lower().encode()
    return (word_hash(bare) % WORDS | (word_hash(shape.encode()) % SHAPES) << 12
            | (word_hash(word) >> 32) << 32)


def terms(text: bytes | None, codes: Codes) -> tuple[np.ndarray, np.ndarray]:
    """(terms, counts) of a whole text."""
    found = text.split() if text else []
    if not found:
        return np.empty(0, np.int64), np.empty(0)
    c = codes.of(found)
    low = c & np.uint64(0xFFFFFFFF)
    count = np.bincount((low & np.uint64(0xFFF)).astype(np.int64), minlength=TERMS)
    count += np.bincount((low >> np.uint64(12)).astype(np.int64) + WORDS, minlength=TERMS)
    base = WORDS + SHAPES
    count[base] = (c[1:] == c[:-1]).sum()  # a word right after itself
    runs = chain(c, 4)
    if len(runs):
        _, times = np.unique(runs, return_counts=True)
        count[base + 1] = (times[times > 1]).sum()  # words that start a repeated run
        share = count[base + 1] / len(runs)
        count[base + 2 + min(9, int(share * 10))] = len(found) if share > 0.05 else 0
    at = np.flatnonzero(count)
    return at, count[at].astype(float)


def weights(rows: list[tuple[np.ndarray, np.ndarray]], idf: np.ndarray) -> np.ndarray:
    """Unit tf-idf rows."""
    x = np.zeros((len(rows), TERMS), np.float32)
    for i, (at, count) in enumerate(rows):
        x[i, at] = (1 + np.log(count)) * idf[at]
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 0, norm, 1)


@dataclass
class Model:
    idf: np.ndarray
    axes: np.ndarray      # terms x rank
    vectors: np.ndarray   # sample x rank, unit rows
    votes: np.ndarray     # label
    importance: np.ndarray  # undoes the sampling by label
    prior: float
    settings: Settings

    def score(self, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        s = self.settings
        out = np.full(len(rows), self.prior)
        if not len(self.votes):
            return out
        k = min(s.neighbours, len(self.votes))
        for i in range(0, len(rows), s.block):
            near = unit(weights(rows[i:i + s.block], self.idf) @ self.axes) @ self.vectors.T
            if k < near.shape[1]:
                # the sample is in a fixed order; a tiny slope makes the earlier of equals win
                near = near - np.arange(near.shape[1], dtype=np.float32) * 1e-9
                at = np.argpartition(-near, k - 1, axis=1)[:, :k]
            else:
                at = np.broadcast_to(np.arange(k), (len(near), k))
            w = np.clip(np.take_along_axis(near, at, 1), 0, None).astype(float) ** s.sharpness
            w *= self.importance[at]
            rest = 1e-3
            out[i:i + s.block] = ((w * self.votes[at]).sum(1) + rest * self.prior) / (w.sum(1) + rest)
        return np.clip(out, 0, 1)


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(norm > 1e-12, norm, 1)


def leading_axes(x: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Right singular vectors by randomised subspace iteration."""
    rank = min(rank, *x.shape)
    rng = np.random.default_rng(seed)
    q = rng.standard_normal((x.shape[1], rank + 8)).astype(np.float32)
    for _ in range(6):
        q, _ = np.linalg.qr(x.T @ (x @ q))
    _, _, vt = np.linalg.svd(x @ q, full_matrices=False)
    return (q @ vt.T[:, :rank]).astype(np.float32)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality",
        settings: Settings = Settings(), text: str = "text", doc_id: str = "doc_id") -> Model:
    s = settings
    ids = training_ids(labels, label, {0: s.sample // 2, 1: s.sample // 2}, s.folds, doc_id)
    rows = training_texts(docs, ids, s.most_bytes // s.sample, doc_id, text)

    def counted(batches):
        codes = Codes(term_code)
        for batch in batches:
            found = [terms(t, codes) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_pydict({
                "id": batch.column("id").cast(pa.string()), "y": batch.column("y"),
                "at": pa.array([a.astype(np.uint16).tobytes() for a, _ in found], pa.binary()),
                "n": pa.array([c.astype(np.float32).tobytes() for _, c in found], pa.binary())})

    sparse = (rows.withColumn("text", rows["text"].cast("binary"))
              .mapInArrow(counted, "id string, y int, at binary, n binary").collect())
    sparse.sort(key=lambda r: (r.id, bytes(r.at), bytes(r.n)))
    base = [(np.frombuffer(r.at, np.uint16).astype(np.int64), np.frombuffer(r.n, np.float32))
            for r in sparse]
    y = np.array([r.y for r in sparse], float)
    share = label_share(labels, label, s.folds, doc_id)
    if not len(y):
        return Model(np.ones(TERMS), np.zeros((TERMS, 1)), np.zeros((0, 1)), y, y, 0.5, s)
    df = np.zeros(TERMS)
    for at, _ in base:
        df[at] += 1
    idf = np.log((1 + len(base)) / (1 + df)) + 1
    x = weights(base, idf)
    axes = leading_axes(x, s.rank, s.seed)
    # as many votes for a label as it has in the labelled rows, though sampled by label
    have = max(1e-9, y.mean()), max(1e-9, 1 - y.mean())
    importance = np.where(y > 0, share / have[0], (1 - share) / have[1])
    return Model(idf, axes, unit(x @ axes), y, importance, float(share), s)


FIELDS = T.StructType([T.StructField("score", T.DoubleType()),
                       T.StructField("predicted", T.IntegerType())])


def classify(docs: DataFrame, model: Model, text: str = "text",
             keep: list[str] | None = None) -> tuple[DataFrame, str]:
    """``docs`` with a struct of score and predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        known, codes = shared.value, Codes(term_code)

        def run(texts):
            score = known.score([terms(t, codes) for t in texts])
            return {"score": score, "predicted": (score >= known.settings.threshold).astype(np.int32)}
        return run

    return annotate(docs, make, FIELDS, text, "quality", keep)
