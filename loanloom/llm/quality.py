"""Quality classifier on random-indexing word vectors.

1. Every word has a sparse random index vector; its word vector is the sum of the index vectors
   of its neighbours, over every document.  Words share a vector by hash bucket, so the table of
   vectors has the same bounded size for any corpus.
2. A document is the mean and the spread of its words' vectors, how alike neighbours' vectors
   are, and its length.
3. A two-layer network learns the label from a bounded sample of labelled documents; a
   temperature fitted on a part of them calibrates its probabilities.
4. Every document is scored where it lies; none is shuffled.
"""

from __future__ import annotations

from zlib import crc32

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import gather, map_texts

BUCKETS = 1 << 14
DIMENSIONS = 32
#: Non-zero entries of an index vector, and neighbours to either side.
NONZERO, NEIGHBOURS = 4, 2
#: At most so many labelled documents are learned from: those with the least hash of doc_id.
MOST_LABELLED = 20_000
HIDDEN, EPOCHS, SEED = 32, 60, 7
THRESHOLD = 0.7
FEATURES = 2 * DIMENSIONS + 2
#: Words whose vectors are in memory at a time.
_STEP = 1 << 17


def _buckets(text: str | None) -> np.ndarray:
    words = text.encode().split() if text else []
    return np.fromiter(map(crc32, words), np.int64, len(words)) & (BUCKETS - 1)


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Dimension and sign of each non-zero entry, by bucket."""
    rng = np.random.default_rng(SEED)
    places = rng.integers(0, DIMENSIONS, (BUCKETS, NONZERO))
    return places, rng.choice([-1.0, 1.0], (BUCKETS, NONZERO))


def _add_contexts(batches):
    """Sums of neighbours' index vectors over the task's documents: a row for each bucket seen."""
    places, signs = index_vectors()
    total = np.zeros(BUCKETS * DIMENSIONS)
    for batch in batches:
        parts = [_buckets(t) for t in batch.column(0).to_pylist()]
        own = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
        words = np.concatenate(parts) if parts else own
        for start in range(0, len(words), _STEP * 4):
            seen = words[start : start + _STEP * 4 + NEIGHBOURS]
            doc = own[start : start + _STEP * 4 + NEIGHBOURS]
            for gap in range(1, NEIGHBOURS + 1):
                last = min(_STEP * 4, len(seen) - gap)
                together = np.flatnonzero(doc[:last] == doc[gap : gap + last]) if last > 0 else []
                if not len(together):
                    continue
                left, right = seen[together], seen[together + gap]
                for word, near in ((left, right), (right, left)):
                    for k in range(NONZERO):
                        at = word * DIMENSIONS + places[near, k]
                        total += np.bincount(at, signs[near, k], len(total))
    rows = total.reshape(BUCKETS, DIMENSIONS)
    used = np.flatnonzero(rows.any(axis=1))
    yield [used, list(rows[used].astype(np.int64))]


def _add_up(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        for bucket, values in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            row = values.values.to_numpy()
            total[bucket] = total[bucket] + row if bucket in total else row
    yield [list(total), list(total.values())]


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Unit word vectors by bucket, from all documents; BUCKETS x DIMENSIONS numbers."""
    fields = "bucket int, v array<bigint>"
    texts = docs.select(docs[f"`{text}`"].cast("string").alias("text"))
    sums = gather(texts, fields, lambda: _add_contexts).repartition("bucket")
    out = np.zeros((BUCKETS, DIMENSIONS))
    for row in gather(sums, fields, lambda: _add_up).collect():
        out[row["bucket"]] = row["v"]
    size = np.linalg.norm(out, axis=1, keepdims=True)
    return (out / np.where(size > 0, size, 1)).astype(np.float32)


def pooled(texts: list, vectors: np.ndarray) -> np.ndarray:
    """Per text the mean and spread of the words' vectors, the mean cosine of neighbours, and the
    logarithm of the number of words."""
    out = np.zeros((len(texts), FEATURES))
    for k, text in enumerate(texts):
        words = _buckets(text)
        first, second, alike = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0.0
        for start in range(0, len(words), _STEP):
            v = vectors[words[start : start + _STEP + 1]]
            alike += np.einsum("ij,ij->", v[1:], v[:-1], dtype=np.float64)
            v = v[:_STEP]
            first += v.sum(axis=0, dtype=np.float64)
            second += np.einsum("ij,ij->j", v, v, dtype=np.float64)
        n = max(1, len(words))
        mean = first / n
        out[k, :DIMENSIONS] = mean
        out[k, DIMENSIONS:-2] = np.sqrt(np.maximum(second / n - mean**2, 0))
        out[k, -2] = alike / max(1, len(words) - 1)
        out[k, -1] = np.log1p(len(words))
    return out


class Network:
    """Two layers: tanh, then a logit divided by the temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        rng = np.random.default_rng(SEED)
        self.base = (y.sum() + 1) / (len(y) + 2)
        self.weights = None
        if len(set(y.tolist())) < 2 or len(y) < 10:
            return
        self.shift, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        check = np.arange(len(y)) % 5 == 0
        self._learn((x[~check] - self.shift) / self.scale, y[~check].astype(float), rng)
        logits, known = self._logits(x[check]), y[check]
        loss = lambda t: np.logaddexp(0, np.where(known == 1, -1, 1) * logits / t).mean()
        self.temperature = min(np.geomspace(0.25, 16, 121), key=loss)

    def _learn(self, x, y, rng):
        w = [
            rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], HIDDEN)),
            np.zeros(HIDDEN),
            rng.normal(0, HIDDEN**-0.5, HIDDEN),
            np.zeros(1),
        ]
        mean, square, step = [0.0] * 4, [0.0] * 4, 0
        for _ in range(EPOCHS):
            order = rng.permutation(len(y))
            for start in range(0, len(y), 128):
                pick = order[start : start + 128]
                hidden = np.tanh(x[pick] @ w[0] + w[1])
                error = 1 / (1 + np.exp(-(hidden @ w[2] + w[3]))) - y[pick]
                back = np.outer(error, w[2]) * (1 - hidden**2)
                grads = [x[pick].T @ back, back.sum(axis=0), hidden.T @ error, error.sum()[None]]
                step += 1
                for k, g in enumerate(grads):
                    g = g / len(pick) + 1e-4 * w[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * g
                    square[k] = 0.999 * square[k] + 0.001 * g**2
                    rate = 0.005 * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                    w[k] = w[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)
        self.weights = w

    def _logits(self, x):
        w = self.weights
        return np.tanh((x - self.shift) / self.scale @ w[0] + w[1]) @ w[2] + w[3]

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.base)
        z = np.clip(self._logits(x) / self.temperature, -50, 50)
        return 1 / (1 + np.exp(-z))


def held_out(doc_id):
    """Rows that are never learned from."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def score_quality(
    docs: DataFrame,
    labels: DataFrame,
    keep: tuple[str, ...] | None = None,
    most_labelled: int = MOST_LABELLED,
) -> DataFrame:
    """``row`` (kept columns) and ``score`` from 0 to 1, higher where label 1 is likelier.

    Learns from ``labels(doc_id, quality)`` rows outside the held-out part, only the least label
    where a document has several.  Rows without an id or label teach nothing.  One row per input
    row; null and empty texts are scored like any other, with no words.  Without labels of both
    kinds every score is the share of label 1, with one more row of each kind.
    """
    vectors = word_vectors(docs)
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    # At most most_labelled rows of two numbers: small enough for every executor.
    known = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(
        F.broadcast(taught), "doc_id"
    )
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    def features():
        table = shared.value
        return lambda texts: [list(pooled(texts, table))]

    sample = (
        map_texts(known, "x array<double>", features, keep=("doc_id", "label"))
        .select("row.doc_id", "row.label", "x")
        .orderBy(F.xxhash64("doc_id"), "doc_id", "x")
        .limit(most_labelled)
        .collect()
    )
    x = np.array([r["x"] for r in sample]).reshape(len(sample), FEATURES)
    network = Network(x, np.array([int(r["label"] == 1) for r in sample]))

    def scores():
        table = shared.value
        return lambda texts: [network(pooled(texts, table))]

    return map_texts(docs, "score double", scores, keep=keep)


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, columns unchanged, whose score reaches the threshold."""
    return score_quality(docs, labels).where(F.col("score") >= threshold).select("row.*")
