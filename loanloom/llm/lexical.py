"""Ranked lexical search over norm buckets of impact vectors.

1. The items' terms are the vocabulary.  One pass over the documents counts each document's terms
   and those of the vocabulary; document frequencies follow from the counts.
2. A document is an impact vector: for each term of the vocabulary, the score it would give.  An
   item is the sum of its terms' unit vectors, and a score is an inner product.
3. Documents are ordered by the length of their vectors, longest first, and cut into buckets of
   like length.  The longest give every item a floor for its worst wanted score.
4. By Cauchy-Schwarz no score in a bucket exceeds its longest vector times the item's length:
   buckets, and rows in the scan, under an item's floor are dropped.
5. Inside a bucket the item's heaviest coordinates are the focus: a document that has none of them
   is bounded by the largest values of the rest; one that has some by its sum over the focus and
   the length of what remains of its vector.
6. What survives is scored again in integers.
"""

from __future__ import annotations

import math
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import _slices, gather, written

K = 50
#: Documents in a bucket, and in a range of like length that is written together.
BUCKET, RANGE = 4096, 32_768
#: Bytes of the terms of items that are searched for together.
TOGETHER = 4_000_000

#: A to Z become lower case; ASCII that is neither letter nor digit separates.
_FOLD = bytes(
    c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return text.encode().translate(_FOLD).split() if text else []


def item_terms(items: DataFrame) -> DataFrame:
    """``item_id`` and its different ``terms``; rows of one id are one item, also without an id."""

    def split(batches):
        for batch in batches:
            yield [batch.column(0),
                   [sorted({t.decode() for t in terms_of(x)}) for x in batch.column(1).to_pylist()]]

    texts = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")
    )
    rows = gather(texts, "item_id bigint, terms array<string>", lambda: split)
    return rows.groupBy("item_id").agg(
        F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms")
    )


def _counts(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """``doc_id``, number of terms ``n``, and the vocabulary's terms (by place) and their counts;
    documents without any term are left out."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocabulary)
    schema = "doc_id bigint, n bigint, term array<int>, tf array<int>"

    def run(batches):
        place = {t.encode(): k for k, t in enumerate(shared.value)}
        size = max(1, len(place))
        for batch in batches:
            for part in _slices(batch):
                words = [terms_of(t) for t in part.column(1).to_pylist()]
                n = np.fromiter(map(len, words), np.int64, len(words))
                at = np.fromiter(
                    map(place.get, chain.from_iterable(words), repeat(-1)), np.int64, n.sum()
                )
                row = np.repeat(np.arange(len(n)), n)[at >= 0]
                key, tf = np.unique(row * size + at[at >= 0], return_counts=True)
                ends = np.searchsorted(key, np.arange(len(n) + 1) * size).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(ends), pa.array(v.astype(np.int32)))
                    for v in (key % size, tf)
                ]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(n), *lists], names=["doc_id", "n", "term", "tf"]
                ).filter(pa.array(n > 0))
        pa.default_memory_pool().release_unused()

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")
    )
    return texts.mapInArrow(run, schema)


def term_weights(found: np.ndarray, n_docs: int) -> np.ndarray:
    """floor(1000 * ln((2N + 2) / (2df + 1))) for each document frequency."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) for df in found.tolist()],
        np.int64,
    )


def damping(n: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """100 - 50 + ((50 * n * N) div L) for documents of n terms."""
    if 50 * int(n.max(initial=0)) * n_docs < 1 << 63:
        return 50 + 50 * n * n_docs // n_terms
    return np.array([50 + 50 * v * n_docs // n_terms for v in n.tolist()], np.int64)


def impacts(tf: np.ndarray, m: np.ndarray, weights: np.ndarray) -> np.ndarray:
    tf = tf.astype(np.int64)
    return weights * (1_000_000_000 * tf // (1000 * tf + 20 * m))


class Bucket:
    """Documents of like length, by row and by term."""

    def __init__(self, batch: pa.RecordBatch, weights: np.ndarray):
        self.ids = batch.column("doc_id").to_numpy()
        self.lengths = batch.column("length").to_numpy()
        lists = batch.column("term")
        size = lists.value_lengths().to_numpy()
        self.ends = np.concatenate([[0], np.cumsum(size)])
        self.term = lists.flatten().to_numpy()
        rows = np.repeat(np.arange(len(size)), size)
        self.impact = impacts(
            batch.column("tf").flatten().to_numpy(), batch.column("m").to_numpy()[rows],
            weights[self.term],
        )
        order = np.argsort(self.term, kind="stable")
        self.rows, self.by_term = rows[order], self.impact[order].astype(np.float64)
        present, self.starts = np.unique(self.term[order], return_index=True)
        self.stops = np.append(self.starts[1:], len(order))
        self.largest = np.maximum.reduceat(self.by_term, self.starts)
        self.column = np.full(len(weights), -1)
        self.column[present] = np.arange(len(present))
        self.asked = np.zeros(len(weights), bool)

    def survivors(self, terms: np.ndarray, floor: float, k: int) -> np.ndarray:
        """Rows whose score for these terms may reach the floor, or the best k if there are that
        many; none of the others does."""
        columns = self.column[terms]
        columns = columns[columns >= 0]
        columns = columns[np.argsort(-self.largest[columns], kind="stable")]
        # After j focus coordinates a row without any of them scores rest[j] at most.
        rest = np.append(np.cumsum(self.largest[columns][::-1])[::-1], 0.0)
        by_length = self.lengths.max() * np.sqrt(np.arange(len(columns), -1, -1))
        rest = np.minimum(rest, by_length * (1 + 1e-9))
        focus = int(np.argmax(rest < max(floor, 1.0)))
        if not focus:
            return np.zeros(0, np.int64)
        at = np.concatenate([np.arange(self.starts[c], self.stops[c]) for c in columns[:focus]])
        rows, value = self.rows[at], self.by_term[at]
        total = np.bincount(rows, value, len(self.ids))
        if len(total) > k:
            # Sums over the focus are never above the scores, so their k-th best is a floor too.
            floor = max(floor, np.partition(total, -k)[-k])
        squares = np.bincount(rows, value**2, len(self.ids))
        remains = np.sqrt(np.maximum(self.lengths**2 * (1 + 1e-9) - squares, 0))
        left = np.minimum(rest[focus], remains * math.sqrt(len(columns) - focus))
        return np.flatnonzero((total > 0) & ((total + left) * (1 + 1e-9) >= floor))

    def scores(self, rows: np.ndarray, terms: np.ndarray) -> np.ndarray:
        """Exact scores of some rows, in integers."""
        size = self.ends[rows + 1] - self.ends[rows]
        starts = np.cumsum(size) - size
        at = np.repeat(self.ends[rows] - starts, size) + np.arange(size.sum())
        self.asked[terms] = True
        value = np.where(self.asked[self.term[at]], self.impact[at], 0)
        self.asked[terms] = False
        return np.add.reduceat(value, starts)


class Best:
    """The best k documents of every item so far; ties go to the smaller id."""

    def __init__(self, floors: np.ndarray, k: int):
        self.k, self.floors = k, floors.astype(np.int64)
        self.scores = [np.zeros(0, np.int64)] * len(floors)
        self.ids = [np.zeros(0, np.int64)] * len(floors)

    def add(self, item: int, scores: np.ndarray, ids: np.ndarray) -> None:
        scores = np.concatenate([self.scores[item], scores])
        ids = np.concatenate([self.ids[item], ids])
        good = scores >= self.floors[item]
        scores, ids = scores[good], ids[good]
        order = np.lexsort((ids, -scores))[: self.k]
        self.scores[item], self.ids[item] = scores[order], ids[order]
        if len(order) == self.k:
            self.floors[item] = scores[order[-1]]


def search(batches, weights: np.ndarray, items: list[np.ndarray], floors: np.ndarray, k: int):
    """Item, document and score of the best documents for each item in length-ordered batches."""
    best = Best(floors, k)
    size = np.sqrt([len(t) for t in items])
    for batch in batches:
        for start in range(0, batch.num_rows, BUCKET):
            part = batch.slice(start, BUCKET)
            longest = float(np.max(part.column("length").to_numpy()))
            reached = np.flatnonzero(size * longest * (1 + 1e-9) >= best.floors)
            if not len(reached):
                continue
            bucket = Bucket(part, weights)
            for item in reached.tolist():
                rows = bucket.survivors(items[item], float(best.floors[item]), k)
                if len(rows):
                    best.add(item, bucket.scores(rows, items[item]), bucket.ids[rows])
    item = np.repeat(np.arange(len(items)), [len(s) for s in best.scores])
    return [item, np.concatenate(best.ids), np.concatenate(best.scores)]


def _lengths(counts: DataFrame, weights: np.ndarray, n_docs: int, n_terms: int) -> DataFrame:
    """Adds ``m`` and the ``length`` of the impact vector; rows that score nothing go."""
    fields = "doc_id bigint, m bigint, length double, term array<int>, tf array<int>"

    def run(batches):
        for batch in batches:
            n, lists = batch.column("n").to_numpy(), batch.column("term")
            size = lists.value_lengths().to_numpy()
            m = damping(n, n_docs, n_terms)
            row = np.repeat(np.arange(len(n)), size)
            value = impacts(
                batch.column("tf").flatten().to_numpy(), m[row], weights[lists.flatten().to_numpy()]
            ).astype(np.float64)
            length = np.sqrt(np.bincount(row, value**2, len(n)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(m), pa.array(length), lists, batch.column("tf")],
                names=["doc_id", "m", "length", "term", "tf"],
            ).filter(pa.array(length > 0))

    return counts.where(F.size("term") > 0).mapInArrow(run, fields)


def _search_block(docs: DataFrame, items: list, k: int) -> DataFrame:
    """Best documents for some items; ``items`` are rows of item_id and terms."""
    spark = docs.sparkSession
    vocabulary = sorted({t for r in items for t in r["terms"]})
    counts = written(_counts(docs, vocabulary), "counts")
    n_docs, n_terms = counts.agg(F.count("*"), F.sum("n")).first()
    # One number for each term of the block.
    found = np.zeros(len(vocabulary), np.int64)
    for r in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():
        found[r["term"]] = r["count"]
    weights = term_weights(found, n_docs)
    place = {t: k for k, t in enumerate(vocabulary)}
    wanted = [np.array(sorted(place[t] for t in r["terms"]), np.int64) for r in items]

    # Documents without an id count above, but a result could not name them.
    ordered = _lengths(counts.where("doc_id IS NOT NULL"), weights, n_docs, n_terms or 1)
    ranges = max(1, -(-n_docs // RANGE))
    rows = written(
        ordered.repartitionByRange(ranges, F.desc("length"), F.xxhash64("doc_id"))
        .sortWithinPartitions(F.desc("length"), F.xxhash64("doc_id"))
        .withColumn("part", F.spark_partition_id()),
        "lengths",
    )
    shared = spark.sparkContext.broadcast((weights, wanted))

    def found_in(part: DataFrame, floors: np.ndarray) -> DataFrame:
        def run():
            return lambda batches: iter([search(batches, *shared.value, floors, k)])

        fields = "item int, doc_id bigint, score bigint"
        return gather(part.select("doc_id", "m", "length", "tf", "term"), fields, run)

    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    rank = F.row_number().over(best)
    # A score is 1 at least; the range of longest vectors raises that.
    floors = np.ones(len(items), np.int64)
    head = written(found_in(rows.where("part = 0"), floors), "head")
    for r in head.withColumn("rank", rank).where(F.col("rank") == k).collect():
        floors[r["item"]] = r["score"]
    # Cauchy-Schwarz for the scan: below this length no item is reached.
    least = min((f / math.sqrt(len(t)) for f, t in zip(floors, wanted, strict=True) if len(t)),
                default=math.inf)
    rest = rows.where((F.col("part") > 0) & (F.col("length") >= least * (1 - 1e-9)))
    names = spark.createDataFrame(
        [(n, r["item_id"]) for n, r in enumerate(items)], "item int, item_id bigint"
    )
    return (
        head.unionByName(found_in(rest, floors))
        .withColumn("rank", rank)
        .where(F.col("rank") <= k)
        .join(F.broadcast(names), "item")
        .select("item_id", "rank", "doc_id", "score")
    )


def rank_documents(
    docs: DataFrame, items: DataFrame, k: int = K, together: int = TOGETHER
) -> DataFrame:
    """``item_id``, ``rank`` from 1, ``doc_id`` and ``score``: the ``k`` documents of
    ``docs(doc_id, text)`` that score highest for each of ``items(item_id, text)``.

    Only scores above 0 count; equal scores go by ascending doc_id.  Null, empty and blank texts
    have no terms.  Rows of one item_id are one item; items without an id are one, too.  Documents
    without a doc_id count in all statistics and are not returned; each row of a repeated doc_id
    is a document.  Other columns are ignored.  Items are searched for in blocks of ``together``
    bytes of terms, each block in all documents.  Empty tables give no rows.
    """
    spark = docs.sparkSession
    terms = item_terms(items).where(F.size("terms") > 0)
    total = terms.agg(F.sum(F.octet_length(F.concat_ws("", "terms")))).first()[0] or 0
    blocks = max(1, -(-total // together))
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for block in range(blocks):
        part = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        # Bounded by ``together``, and one item's text where that is longer.
        rows = part.orderBy("item_id").collect()
        if rows:
            out = out.unionByName(_search_block(docs, rows, k))
    return out
