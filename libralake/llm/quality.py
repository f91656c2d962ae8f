"""Quality classifier: random-indexing vectors pooled per document, a two-layer network, calibrated.

Tokens are white-space separated runs of bytes, read in two ways: the lower-cased word and
its shape (letters and digits as classes, runs collapsed, whether it repeats the
word before).  Each reading is hashed to a bounded number of entries.  An entry's index
vector is a fixed random sparse vector; its context vector is the sum of the index
vectors of its neighbours over the fitting sample, scaled to unit length.  A
document is the mean of its tokens' context vectors, with counts of words and characters
and the share of distinct words.  A network with one hidden layer gives a logit, whose
temperature is fitted on rows kept out of the training.

The model is fitted on a bounded sample (``max_fit`` labelled rows, those with the least hash of
the key) and has a fixed size, whatever the corpus holds; scoring reads every whole text in one
scan, without a shuffle.  Null texts are empty; an empty text has a score too; repeated rows give
repeated scores; keys with several labels count as good where the mean is at least a half;
null labels are left out.  Without any labelled row, or with labels of one kind, all scores are
that kind's share (0.5 without rows).  Other columns are not looked at.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrow import slices, utf8
from ._words import TOKEN, mix, word_hashes

WORDS, SHAPES, DIMS, HIDDEN = 1 << 15, 1 << 11, 32, 32
#: Labelled rows that the model is fitted on, at most.
MAX_FIT = 6000
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] = ord("A")
_CLASS[97:123] = _CLASS[128:] = ord("a")
_CLASS[48:58] = ord("0")
_CLASS[[10, 11, 12, 13, 9]] = 32


def _index_vectors(n: int, seed: int) -> np.ndarray:
    rng = np.random.default_rng(seed)
    out = np.zeros((n, DIMS), np.float32)
    for _ in range(4):
        out[np.arange(n), rng.integers(0, DIMS, n)] += rng.choice([-1.0, 1.0], n).astype(np.float32)
    return out


def tokens(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word entry and shape entry of every token, and for each text the index of its first token."""
    words, at = word_hashes(raw, offs)
    if not len(words):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), at
    kind = _CLASS[raw]
    keep = np.ones(len(raw), bool)
    keep[1:] = (kind[1:] != kind[:-1]) | ~TOKEN[raw[1:]]
    heads = offs[:-1][offs[:-1] < len(raw)]
    keep[heads] = True
    shape, shape_at = word_hashes_cased(kind[keep], np.concatenate([[0], np.cumsum(keep)])[offs])
    again = np.zeros(len(words), np.uint64)
    again[1:] = words[1:] == words[:-1]
    again[at[:-1][at[:-1] < len(words)]] = 0
    return (words % np.uint64(WORDS)).astype(np.int64), (mix(shape + again) % np.uint64(SHAPES)).astype(np.int64), at


def word_hashes_cased(kind: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes where upper case counts: capitals are moved to a byte that is not folded."""
    moved = kind.copy()
    moved[kind == ord("A")] = 1
    return word_hashes(moved, offs)


def _pairs(entries: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pairs of entries that stand one or two places apart in a text, and how often."""
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = [np.zeros(0, np.int64)]
    for d in (1, 2):
        if len(entries) > d:
            same = own[d:] == own[:-d]
            found.append(entries[d:][same] * n + entries[:-d][same])
    return np.unique(np.concatenate(found), return_counts=True)


def _context(pairs: list[tuple[np.ndarray, np.ndarray]], n: int, index: np.ndarray) -> np.ndarray:
    """Context vectors of all entries from the pairs of all slices; memory follows the distinct pairs."""
    pair, part = np.unique(np.concatenate([p for p, _ in pairs]), return_inverse=True)
    many = np.bincount(part, weights=np.concatenate([c for _, c in pairs]), minlength=len(pair))
    out = np.zeros((n, DIMS), np.float32)
    for i in range(0, len(pair), 50_000):
        a, b = pair[i : i + 50_000] // n, pair[i : i + 50_000] % n
        w = np.log1p(many[i : i + 50_000]).astype(np.float32)[:, None]
        np.add.at(out, a, index[b] * w)
        np.add.at(out, b, index[a] * w)
    out += 0.5 * index
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-6)


def _pool(vectors: np.ndarray, entries: np.ndarray, at: np.ndarray) -> np.ndarray:
    n = np.diff(at)
    out = np.zeros((len(n), vectors.shape[1]), np.float32)
    some = n > 0
    if some.any():
        out[some] = np.add.reduceat(vectors[entries], at[:-1][some], axis=0) / n[some][:, None]
    return out


def _distinct(words: np.ndarray, at: np.ndarray) -> np.ndarray:
    own = np.repeat(np.arange(len(at) - 1), np.diff(at))
    seen = np.unique(own * WORDS + words) // WORDS
    return np.bincount(seen, minlength=len(at) - 1)


@dataclass
class Model:
    word: np.ndarray | None = None
    shape: np.ndarray | None = None
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    w1: np.ndarray | None = None
    b1: np.ndarray | None = None
    w2: np.ndarray | None = None
    b2: float = 0.0
    temperature: float = 1.0
    prior: float = 0.5

    def features(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        w, s, at = tokens(raw, offs)
        n = np.diff(at)
        counts = np.stack([np.log1p(n), np.log1p(np.diff(offs)), _distinct(w, at) / np.maximum(n, 1), np.diff(offs) / np.maximum(n, 1), n < 16], axis=1)
        return np.concatenate([_pool(self.word, w, at), _pool(self.shape, s, at), counts.astype(np.float32)], axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh(((x - self.mean) / self.scale) @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, raw: np.ndarray, offs: np.ndarray) -> np.ndarray:
        if self.w1 is None:
            return np.full(len(offs) - 1, self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.features(raw, offs)) / self.temperature, -30, 30).astype(np.float64)))


def fit(texts: pa.Array, labels: np.ndarray, seed: int = 11, epochs: int = 120) -> Model:
    """The model of a sample of texts with labels 0 and 1."""
    if not len(labels) or labels.min() == labels.max():
        return Model(prior=float(labels.mean()) if len(labels) else 0.5)
    parts = list(slices(iter([pa.record_batch([texts], ["text"])]), "text", 1 << 20))
    words, shapes = [], []
    for part in parts:
        w, s, at = tokens(*utf8(part.column(0)))
        words.append(_pairs(w, at, WORDS))
        shapes.append(_pairs(s, at, SHAPES))
    m = Model(word=_context(words, WORDS, _index_vectors(WORDS, seed)), shape=_context(shapes, SHAPES, _index_vectors(SHAPES, seed + 1)))
    x = np.concatenate([m.features(*utf8(part.column(0))) for part in parts]).astype(np.float64)
    y = labels.astype(np.float64)
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(y))
    held, use = order[: len(y) // 5], order[len(y) // 5 :]
    m.mean, m.scale = x[use].mean(0), x[use].std(0) + 1e-3
    z = (x - m.mean) / m.scale
    p = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m1, m2 = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    step = 0
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(use), max(1, len(use) // 1024)):
            h = np.tanh(z[part] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -30, 30))) - y[part]) / len(part)
            back = np.outer(d, p[2]) * (1 - h * h)
            grad = [z[part].T @ back + 1e-4 * p[0], back.sum(0), h.T @ d + 1e-4 * p[2], np.array([d.sum()])]
            step += 1
            for i, g in enumerate(grad):
                m1[i] = 0.9 * m1[i] + 0.1 * g
                m2[i] = 0.999 * m2[i] + 0.001 * g * g
                p[i] = p[i] - 0.005 * (m1[i] / (1 - 0.9**step)) / (np.sqrt(m2[i] / (1 - 0.999**step)) + 1e-8)
    m.w1, m.b1, m.w2, m.b2 = p[0], p[1], p[2], float(p[3][0])
    if len(held):
        logit = m.logits(x[held])
        grid = np.exp(np.linspace(np.log(0.25), np.log(8), 61))
        loss = [np.mean(np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / t)) for t in grid]
        m.temperature = float(grid[int(np.argmin(loss))])
    m.word, m.shape = m.word.astype(np.float32), m.shape.astype(np.float32)
    return m


def train(docs: DataFrame, labels: DataFrame, use: Column, key: str = "doc_id", text: str = "text", label: str = "quality", max_fit: int = MAX_FIT) -> Model:
    """A model of at most ``max_fit`` labelled rows for which ``use`` (over the label table's key) holds."""
    mean = labels.where(use & labels[label].isNotNull() & labels[key].isNotNull()).groupBy(labels[key].cast("long").alias("_lk")).agg((F.avg(label) >= 0.5).cast("int").alias("_y"))
    picked = mean.orderBy(F.xxhash64("_lk"), "_lk").limit(max_fit)
    # At most max_fit rows of two numbers each: small enough to send to every task.
    rows = docs.select(docs[key].cast("long").alias("_lk"), F.coalesce(docs[text].cast("string"), F.lit("")).alias("_t")).join(F.broadcast(picked), "_lk").orderBy("_lk", "_t").limit(max_fit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        table = pa.Table.from_batches(held) if held else None
        if table is not None and table.num_rows:
            model = fit(table.column("_t").combine_chunks(), table.column("_y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    # The sample is one bounded partition: it is fitted in a task, and only the model comes to the driver.
    got = rows.select("_t", "_y").mapInArrow(run, "model binary").collect()
    return pickle.loads(bytes(got[0].model)) if got else Model()


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key and score of every row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "_text", 1 << 20):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(held.value.scores(*utf8(b.column("_text"))), pa.float64())], names=[key, "score"])

    src = docs.select(docs[key].cast("long").alias(key), docs[text].cast("string").alias("_text"))
    return src.mapInArrow(run, f"{key} long, score double")


def good(docs: DataFrame, model: Model, least: float = 0.7, text: str = "text") -> DataFrame:
    """The documents with a score of ``least`` or more, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, text, 1 << 20):
            yield b.filter(pa.array(held.value.scores(*utf8(b.column(text))) >= least))

    return docs.mapInArrow(run, docs.schema)
