"""Toxicity classifier on subword embeddings.

1. A word is the bag of its character n-grams, marked at its ends, and of itself.  Each has an
   embedding by hash; the word's vector is their mean, so a misspelling that was never seen lies
   near the words it shares most n-grams with.
2. A document is cut into passages.  The vectors of a passage's different words are averaged over
   the places of a full passage, empty places counting as zero, and go through a linear softmax.
   The document's score is that of its most toxic passage, so that an insult weighs the same in a
   long text as in a short one, and a word said a hundred times no more than one said once.
3. Embeddings and softmax are learned together, in numpy, from a bounded sample of labelled
   documents.
4. A mean followed by a linear map is a mean of numbers: for scoring, each hash bucket holds one
   number, and every document is scored where it lies, all of it; none is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .quality import held_out
from .texts import map_texts, written

#: Sizes of n-grams, buckets that they share by hash, and dimensions of an embedding.
GRAMS, BUCKETS, DIMENSIONS = (3, 4, 5), 1 << 17, 8
#: Words of a passage at most.
PASSAGE = 32
#: Labelled documents learned from at most, those with the least hash of doc_id; of these, whole
#: texts of each label up to so many characters together, none above the last number.
MOST_LABELLED, MOST_CHARS, LONGEST = 20_000, 12_000_000, 200_000
#: Passes over the documents, and steps, both at least.
EPOCHS, STEPS, BATCH = 16, 600, 128
RATE, DECAY, SEED = 0.05, 1e-6, 11
THRESHOLD = 0.3

#: Words whose part in the logit a task remembers.
MOST_WORDS = 1 << 18

#: ASCII that is neither letter nor digit stands in no word.
_SEPARATE = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256))
_END = 1  # Marks both ends of a word; a separator, so no text holds it.
_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Characters hashed at a time.
_STEP = 1 << 20


def words_of(text: str | None) -> list[bytes]:
    return text.lower().encode().translate(_SEPARATE).split() if text else []


def grams(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words' n-grams and of the words, and the word each belongs to."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    mark = bytes([_END])
    text = (mark + mark.join(words) + mark).decode()
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == _END)
    owner = np.cumsum(codes == _END) - 1  # A mark belongs to the word after it.
    buckets, owners = [], []
    for size in GRAMS:
        last = len(codes) - size
        if last < 0:
            continue
        value = np.zeros(last + 1, np.uint64)
        for k in range(size):
            value = (value ^ codes[k : k + last + 1]) * _MIX
            value ^= value >> np.uint64(29)
        # Within one word: the next mark after the first character is the last one, if any.
        at = np.arange(last + 1)
        following = ends[np.minimum(np.searchsorted(ends, at, "right"), len(ends) - 1)]
        inside = following >= at + size - 1
        buckets.append(value[inside])
        owners.append(owner[:-size + 1][inside])
    # The word itself: a sum of its characters' hashes by place.
    place = np.arange(len(codes)) - ends[owner]
    mixed = (codes + place.astype(np.uint64) * np.uint64(0x100000001B3)) * _MIX
    mixed ^= mixed >> np.uint64(31)
    mixed *= _MIX
    whole = np.add.reduceat(mixed[:-1], ends[:-1])
    buckets.append(whole)
    owners.append(np.arange(len(words)))
    hashed = np.concatenate(buckets) * _MIX
    return (hashed >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64), np.concatenate(
        owners
    )


def passages(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words, passage by passage, each once a passage, and where passages begin."""
    most = int(words.max()) + 1
    keys = np.unique(np.arange(len(words)) // PASSAGE * most + words)
    return (keys % most).astype(words.dtype), np.flatnonzero(np.diff(keys // most, prepend=-1))


@dataclass
class Model:
    """One number a bucket and a bias: what embeddings and softmax come to."""

    weights: np.ndarray
    bias: float

    def words(self, words: list[bytes]) -> np.ndarray:
        """Each word's part in the logit."""
        out, start = np.zeros(len(words)), 0
        while start < len(words):
            end, size = start, 0
            while end < len(words) and (size < _STEP or end == start):
                size += len(words[end]) + 1
                end += 1
            bucket, owner = grams(words[start:end])
            n = end - start
            total = np.bincount(owner, self.weights[bucket], n)
            out[start:end] = total / np.bincount(owner, minlength=n)
            start = end
        return out

    def scorer(self) -> Callable[[list], np.ndarray]:
        """A function from texts to probabilities; words met before are not hashed again."""
        number: dict[bytes, int] = {}
        own = np.zeros(0)

        def score(texts: list) -> np.ndarray:
            nonlocal own
            split = [words_of(t) for t in texts]
            met = dict.fromkeys(chain.from_iterable(split))
            if len(number) + len(met) > MOST_WORDS:
                number.clear()
                own = own[:0]
            new = [w for w in met if w not in number]
            number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
            own = np.concatenate([own, self.words(new)])
            logits = np.full(len(texts), self.bias)
            for k, words in enumerate(split):
                if words:
                    at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    at, begins = passages(at)
                    logits[k] += np.add.reduceat(own[at], begins).max() / PASSAGE
            return 1 / (1 + np.exp(-np.clip(logits, -50, 50)))

        return score


def learn(texts: list[str], toxic: np.ndarray, weights: np.ndarray) -> Model:
    """Embeddings and softmax, learned together by Adam; ``weights`` count each document.

    Every document is represented by its passage that now looks most toxic; the loss is the
    cross-entropy of that passage's softmax and the document's label.
    """
    known = weights.sum()
    base = (weights @ toxic + 1) / (known + 2)
    flat = Model(np.zeros(BUCKETS), float(np.log(base / (1 - base))))
    number: dict[bytes, int] = {}
    docs = []
    for text in texts:
        words = words_of(text)
        docs.append(
            np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words))
        )
    if len(set(toxic.tolist())) < 2 or not number:
        return flat
    bucket, owner = grams(list(number))
    order = np.argsort(owner, kind="stable")
    bucket, owner = bucket[order].astype(np.int32), owner[order]
    size = np.bincount(owner, minlength=len(number))
    first = np.concatenate([[0], np.cumsum(size)])
    cut = [passages(d) if len(d) else (d, d) for d in docs]
    usable = np.array([k for k, d in enumerate(docs) if len(d)])
    del docs

    rng = np.random.default_rng(SEED)
    embeddings = rng.uniform(-0.1, 0.1, (BUCKETS, DIMENSIONS))
    softmax = rng.normal(0, 1, (DIMENSIONS, 2))
    bias = np.array([0.0, float(np.log(base / (1 - base)))])
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (embeddings, softmax, bias)]
    share = weights / weights.mean()
    step, parts = 0, -(-len(usable) // BATCH)
    for epoch in range(max(EPOCHS, -(-STEPS // parts))):
        # The most toxic passage of every document, by the model as it is now.
        linear = embeddings @ (softmax[:, 1] - softmax[:, 0])
        value = np.bincount(owner, linear[bucket], len(number)) / size
        chosen = {}
        for k in usable:
            words, begins = cut[k]
            # At first any passage may do: the start is random.
            best = int(rng.integers(len(begins)))
            if epoch:
                best = int(np.add.reduceat(value[words], begins).argmax())
            chosen[k] = np.split(words, begins[best : best + 2])[1]
        for pick in np.array_split(rng.permutation(usable), parts):
            lists = [chosen[k] for k in pick]
            length = np.array([len(w) for w in lists])
            word, place = np.unique(np.concatenate(lists), return_inverse=True)
            row = np.repeat(np.arange(len(pick)), length)
            # Word vectors are means of embeddings, passages means of word vectors.
            span = size[word]
            at = np.repeat(first[word] - np.cumsum(span) + span, span) + np.arange(span.sum())
            used = bucket[at]
            starts = np.cumsum(span) - span
            vectors = np.add.reduceat(embeddings[used], starts) / span[:, None]
            begins = np.cumsum(length) - length
            hidden = np.add.reduceat(vectors[place], begins) / PASSAGE
            logits = hidden @ softmax + bias
            logits -= logits.max(axis=1, keepdims=True)
            p = np.exp(logits)
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(len(pick)), toxic[pick]] -= 1
            error = p * share[pick, None] / len(pick)
            back = error @ softmax.T / PASSAGE
            on_word = np.zeros((len(word), DIMENSIONS))
            for d in range(DIMENSIONS):
                on_word[:, d] = np.bincount(place, back[row, d], len(word))
            on_gram = np.repeat(on_word / span[:, None], span, axis=0)
            touched, spot = np.unique(used, return_inverse=True)
            gradient = np.zeros((len(touched), DIMENSIONS))
            for d in range(DIMENSIONS):
                gradient[:, d] = np.bincount(spot, on_gram[:, d], len(touched))
            step += 1
            _adam(embeddings, touched, gradient, state[0], step)
            _adam(softmax, slice(None), hidden.T @ error, state[1], step)
            _adam(bias, slice(None), error.sum(axis=0), state[2], step)
    return Model(
        (embeddings @ (softmax[:, 1] - softmax[:, 0])).astype(np.float32),
        float(bias[1] - bias[0]),
    )


def _adam(values, at, gradient, state, step) -> None:
    """One step of Adam, on the touched rows alone."""
    mean, square = state
    gradient = gradient + DECAY * values[at]
    mean[at] = 0.9 * mean[at] + 0.1 * gradient
    square[at] = 0.999 * square[at] + 0.001 * gradient**2
    rate = RATE * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
    values[at] -= rate * mean[at] / (np.sqrt(square[at]) + 1e-8)


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    keep: tuple[str, ...] | None = None,
    most_labelled: int = MOST_LABELLED,
    most_chars: int = MOST_CHARS,
) -> DataFrame:
    """``row`` (kept columns) and ``score`` from 0 to 1, higher where label 1 is likelier.

    Learns from ``labels(doc_id, toxic)`` rows outside the held-out part, only the greatest label
    where a document has several.  Rows without an id or label teach nothing.  One row per input
    row; null, empty and blank texts are scored like any other, with no words.  Very long texts
    are scored whole; those above ``LONGEST`` characters do not teach.  Without labels of both
    kinds every score is the share of label 1, with one more row of each kind.
    """
    taught = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg((F.max("toxic") == 1).cast("int").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most_labelled)
    )
    # At most most_labelled rows of two numbers: small enough for every executor.
    known = written(
        docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
        .join(F.broadcast(taught), "doc_id")
        .withColumn("size", F.length("text")),
        "taught",
    )
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.xxhash64("text")]
    places = Window.partitionBy("label").orderBy(*order)
    total = F.sum("size").over(places.rowsBetween(Window.unboundedPreceding, 0))
    # The window sees a few numbers of each labelled row; texts are fetched for the chosen ones.
    rows = known.select("doc_id", "label", "size", F.xxhash64("text").alias("text"))
    chosen = (
        rows.where(F.col("size") <= LONGEST)
        .withColumns({"total": total, "place": F.row_number().over(places)})
        .where((F.col("total") <= most_chars) & (F.col("place") <= most_labelled))
        .select("doc_id")
        .distinct()
    )
    sample = (
        known.where(F.col("size") <= LONGEST)
        .join(chosen, "doc_id", "left_semi")
        .orderBy(*order)
        .limit(2 * most_labelled)
        .select("text", "label")
        .collect()
    )
    counted = dict(known.groupBy("label").count().collect())
    toxic = np.array([r["label"] for r in sample], np.int64)
    seen = np.bincount(toxic, minlength=2)
    share = np.array([counted.get(k, 0) / max(1, seen[k]) for k in (0, 1)])
    model = learn([r["text"] for r in sample], toxic, share[toxic])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def scores():
        score = shared.value.scorer()
        return lambda texts: [score(texts)]

    return map_texts(docs, "score double", scores, keep=keep)


def keep_civil(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents, columns unchanged, whose score stays under the threshold."""
    return score_toxicity(docs, labels).where(F.col("score") < threshold).select("row.*")
