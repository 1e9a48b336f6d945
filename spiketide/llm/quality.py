"""Quality classifier: random-indexing word vectors pooled per document, a two-layer network, temperature calibration.

Words are hashed into a fixed number of buckets. A bucket has a sparse random index vector; its context vector is the
sum of the index vectors of the words around it, over every document. A document's features are the means of its
words' index vectors and normalised context vectors, the mean squares of the latter, and how much it repeats itself.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import prepare

#: Buckets of words and dimensions of their vectors. They fix the size of what is collected and broadcast: 2 MB.
BUCKETS, DIMS, WINDOW = 1 << 14, 32, 2
#: Labelled rows that the network is fitted on at most: those of least hash of their id.
MAX_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 3

_WORD = re.compile(rb"[A-Za-z0-9\x80-\xff]+|[^\sA-Za-z0-9\x80-\xff]+")


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = bucket = zlib.crc32(word) % BUCKETS
        return bucket


def _index_vectors() -> np.ndarray:
    """Two non-zero entries of +1 or -1 for each bucket."""
    rng = np.random.default_rng(SEED)
    out = np.zeros((BUCKETS, DIMS), np.float32)
    for _ in range(2):
        out[np.arange(BUCKETS), rng.integers(0, DIMS, BUCKETS)] += rng.choice([-1, 1], BUCKETS)
    return out


def _tokens(text: bytes, buckets: _Buckets) -> np.ndarray:
    return np.array(list(map(buckets.__getitem__, _WORD.findall(text))), np.int64)


def context_vectors(docs: DataFrame, text_col: str = "text") -> np.ndarray:
    """The context vector of every bucket, summed over all documents."""
    prepare(docs.sparkSession)

    def run(batches):
        index, buckets = _index_vectors(), _Buckets()
        at = [np.nonzero(index != 0)]
        places = [(np.full(BUCKETS, -1), np.zeros(BUCKETS)) for _ in range(2)]
        for b, d in zip(*at[0], strict=True):
            slot = 0 if places[0][0][b] < 0 else 1
            places[slot][0][b], places[slot][1][b] = d, index[b, d]
        total = np.zeros(BUCKETS * DIMS)
        for batch in batches:
            ids = [_tokens(text.as_py(), buckets) for text in batch.column(0) if text.is_valid]
            gap = np.full(WINDOW, -1)
            flat = np.concatenate([x for pair in ((i, gap) for i in ids) for x in pair]) if ids else gap
            for step in range(1, WINDOW + 1):
                for word, near in ((flat[step:], flat[:-step]), (flat[:-step], flat[step:])):
                    both = (word >= 0) & (near >= 0)
                    word, near = word[both], near[both]
                    for dims, signs in places:
                        have = dims[near] >= 0
                        w, n = word[have], near[have]
                        total += np.bincount(w * DIMS + dims[n], weights=signs[n], minlength=len(total))
        rows = total.reshape(BUCKETS, DIMS)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), *(pa.array(rows[used, d].astype(np.int64)) for d in range(DIMS))], ["bucket", *(f"d{d}" for d in range(DIMS))])

    schema = "bucket int, " + ", ".join(f"d{d} long" for d in range(DIMS))
    parts = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, schema)
    summed = parts.groupBy("bucket").agg(*[F.sum(f"d{d}").alias(f"d{d}") for d in range(DIMS)])
    out = np.zeros((BUCKETS, DIMS))
    for row in summed.toLocalIterator():
        out[row[0]] = row[1:]
    return out


class Features:
    """Text bytes -> feature vector."""

    SIZE = 3 * DIMS + 3

    def __init__(self, context: np.ndarray):
        scale = np.linalg.norm(context, axis=1, keepdims=True)
        self.vectors = np.concatenate([_index_vectors(), np.divide(context, scale, out=np.zeros_like(context), where=scale > 0)], axis=1).astype(np.float32)
        self.buckets = _Buckets()

    def __call__(self, text: bytes) -> np.ndarray:
        ids = _tokens(text, self.buckets)
        out = np.zeros(self.SIZE, np.float32)
        if len(ids):
            kinds, counts = np.unique(ids, return_counts=True)
            share = (counts / len(ids)).astype(np.float32)
            rows = self.vectors[kinds]
            out[: 2 * DIMS] = share @ rows
            out[2 * DIMS : 3 * DIMS] = share @ rows[:, DIMS:] ** 2
            out[-3:] = np.log1p(len(ids)) / 10, len(kinds) / len(ids), (ids[1:] == ids[:-1]).mean() if len(ids) > 1 else 0
        return out


class Network:
    """Two layers, tanh and logistic, fitted by Adam; probabilities are calibrated by a temperature on a held-back fifth."""

    def fit(self, x: np.ndarray, y: np.ndarray) -> Network:
        self.constant = None
        if not len(y) or y.min() == y.max():
            self.constant = float(y.mean()) if len(y) else 0.5
            return self
        self.mean, self.spread = x.mean(0), x.std(0) + 1e-6
        rng = np.random.default_rng(SEED)
        order = rng.permutation(len(y))
        held, rest = order[: len(y) // 5], order[len(y) // 5 :]
        z, y = (x - self.mean) / self.spread, y.astype(np.float64)
        self.w = [rng.normal(0, z.shape[1] ** -0.5, (z.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        m, v, t = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w], 0
        self.temperature = 1.0
        for epoch in range(EPOCHS):
            rate = 0.01 * (1 - epoch / EPOCHS)
            for batch in np.array_split(rng.permutation(rest), max(1, len(rest) // 128)):
                a, t = z[batch], t + 1
                hidden = np.tanh(a @ self.w[0] + self.w[1])
                error = (self._sigmoid(hidden @ self.w[2] + self.w[3]) - y[batch]) / len(batch)
                back = np.outer(error, self.w[2]) * (1 - hidden**2)
                for k, g in enumerate((a.T @ back + 1e-4 * self.w[0], back.sum(0), hidden.T @ error + 1e-4 * self.w[2], error.sum(keepdims=True))):
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    self.w[k] -= rate * m[k] / (1 - 0.9**t) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)
        if len(held):
            logit = self._logit(z[held])
            loss = lambda s: np.logaddexp(0, np.where(y[held] > 0, -logit, logit) / s).mean()
            self.temperature = float(min(np.geomspace(0.3, 10, 60), key=loss))
        return self

    @staticmethod
    def _sigmoid(x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x, -60, 60)))

    def _logit(self, z: np.ndarray) -> np.ndarray:
        return np.tanh(z @ self.w[0] + self.w[1]) @ self.w[2] + self.w[3]

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return self._sigmoid(self._logit((x - self.mean) / self.spread) / self.temperature)


def held_out(doc_id: Column) -> Column:
    """Rows that no label is learnt from: CRC-32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", max_labelled: int = MAX_LABELLED) -> tuple[np.ndarray, Network]:
    """Context vectors from all documents and a network from at most max_labelled labelled ones that are not held out.

    Null labels are none; of several labels of an id the least counts. Without labels, or with labels of one class,
    the network answers a constant: the share of label 1, or a half.
    """
    context = context_vectors(docs, text_col)
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).cast("long").alias("label_id")).agg(F.min(label).cast("double").alias("y"))
    chosen = known.orderBy(F.xxhash64("label_id"), "label_id").limit(max_labelled)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(chosen), F.col("id") == F.col("label_id")).select("id", "text", "y")
    shared = docs.sparkSession.sparkContext.broadcast(context)

    def run(batches):
        features = Features(shared.value)
        for batch in batches:
            found = [features(text.as_py() or b"").tolist() for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.float32())), batch.column(2)], ["id", "x", "y"])

    table = rows.mapInArrow(run, "id long, x array<float>, y double").toArrow().combine_chunks().sort_by("id")
    x = np.array(table.column("x").to_pylist(), np.float64).reshape(table.num_rows, Features.SIZE)
    return context, Network().fit(x, table.column("y").to_numpy() if table.num_rows else np.zeros(0))


def score(docs: DataFrame, model: tuple[np.ndarray, Network], text_col: str = "text") -> DataFrame:
    """(row struct of all columns, score double): the probability of label 1 for every whole text. Null texts are empty."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"))
    schema = source.select("row", F.lit(0.0).alias("score")).schema

    def run(batches):
        context, network = shared.value
        features = Features(context)
        for batch in batches:
            x = np.array([features((text.as_py() or "").encode()) for text in batch.column(0).field(text_col)], np.float64).reshape(-1, Features.SIZE)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(network.predict(x), pa.float64())], ["row", "score"])

    return source.mapInArrow(run, schema)


def keep(docs: DataFrame, model: tuple[np.ndarray, Network], least: float, text_col: str = "text") -> DataFrame:
    """The rows whose score is at least `least`, columns as they were."""
    return score(docs, model, text_col).filter(F.col("score") >= least).select("row.*")
