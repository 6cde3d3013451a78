"""Substring dedup by level-wise doubling.

A window of ``window`` words repeats only if its halves do, so windows of half the length are
looked at first and only places that repeat there are extended to twice the length.

Level 1 needs one half from every window, not all: the one with the least hash among those
inside, which is the same one wherever the window occurs.  Halves seen at more than one place
(of different texts, or twice in one) go into a bit table of bounded size; a full table lets
more candidates through, never fewer.  Level 2 hashes the windows around repeated halves to 128
bits, finds the first place of each and marks the others.  Of equal windows in one batch all but
the first are marked at once and only that one is compared further, so that a window which many
texts share costs one row a batch in the shuffle.  No candidates at a level end the search.

Whole copies of a text are settled by its hash alone: every window of a later copy also starts
in the first, so it loses all its words.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import bit_table, gather, in_table, written

WINDOW = 20
_LAST = (1 << 63) - 1
_hash_a = xxhash.xxh3_64_intdigest
_hash_b = partial(xxhash.xxh3_64_intdigest, seed=1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Words are cut at blanks, tabs and line ends only."""
    return text.encode().split() if text else []


def _join(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The hash of two neighbouring pieces from theirs."""
    x = (left ^ (left >> np.uint64(29))) * _MIX + right
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _levels(hashes: np.ndarray, length: int) -> np.ndarray:
    """Hashes of all runs of ``length`` words: those of half the length, joined."""
    if length == 1:
        return hashes
    half = (length + 1) // 2
    part = _levels(hashes, half)
    n = len(hashes) - length + 1
    return _join(part[:n], part[length - half : length - half + n])


def _content(words: list[bytes]) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(b" ".join(words))
    return tuple(int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))


def _halves(words: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all halves, and for each window the place of its least half."""
    half = (window + 1) // 2
    hashes = np.fromiter(map(_hash_a, words), np.uint64, len(words))
    parts = _levels(hashes, half)
    inside = np.lib.stride_tricks.sliding_window_view(parts, window - half + 1)
    least = np.empty(len(inside), np.int64)
    for at in range(0, len(inside), 1 << 20):
        least[at : at + (1 << 20)] = inside[at : at + (1 << 20)].argmin(axis=1)
    return parts, least + np.arange(len(inside))


def repeated_spans(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Starts of the windows of ``docs(doc_id, tag, text)`` whose words also start earlier.

    ``doc_id``, ``tag`` (which of several texts with that id) and ``starts``, for texts that
    are no whole copies; see :func:`dedup_substrings` for the rest.
    """
    make = lambda: partial(_emit_halves, window=window)
    texts = docs.select("doc_id", "tag", "text")
    seen = gather(texts, "half bigint, place bigint", make)
    repeated = written(
        seen.groupBy("half")
        .agg(F.min("place").alias("a"), F.max("place").alias("b"))
        .where("a <> b")
        .select("half"),
        "halves",
    )
    filled = bit_table(repeated)
    if filled is None:
        schema = "doc_id bigint, tag bigint, starts array<int>"
        return docs.sparkSession.createDataFrame([], schema)
    shared = docs.sparkSession.sparkContext.broadcast(filled)
    make = lambda: partial(_emit_windows, shared=shared, window=window)
    fields = "a bigint, b bigint, doc_id bigint, spot bigint, later boolean"
    places = gather(texts, fields, make).repartition("a", "b").sortWithinPartitions(
        "a", "b", "doc_id", "spot"
    )
    later = gather(places, "doc_id bigint, spot bigint", lambda: _later)
    return later.groupBy("doc_id", F.expr("spot & 4294967295").alias("tag")).agg(
        F.collect_list(F.shiftright("spot", 32).cast("int")).alias("starts")
    )


def _emit_halves(batches, window):
    for batch in batches:
        keys, places = [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            if len(words) >= window:
                parts, least = _halves(words, window)
                at = np.unique(least)
                keys.append(parts[at].view(np.int64))
                own = np.array([_content(words)[0]]).view(np.uint64)
                places.append((own ^ (at.astype(np.uint64) * _MIX)).view(np.int64))
        if keys:
            yield [np.concatenate(keys), np.concatenate(places)]


def _emit_windows(batches, shared, window):
    table = shared.value
    for batch in batches:
        out: list[list] = [[], [], [], []]
        for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            if len(words) < window:
                continue
            parts, least = _halves(words, window)
            at = np.unique(least)
            starts = np.flatnonzero(np.isin(least, at[in_table(table, parts[at])]))
            if len(starts):
                other = np.fromiter(map(_hash_b, words), np.uint64, len(words))
                half = (window + 1) // 2
                n = len(words) - window + 1
                # Twice the length from the halves; the second lane from its own words.
                whole = _join(parts[:n], parts[window - half : window - half + n])
                out[0].append(whole[starts].view(np.int64))
                out[1].append(_levels(other, window)[starts].view(np.int64))
                out[2].append(np.full(len(starts), doc))
                out[3].append((starts.astype(np.int64) << 32) | tag)
        if out[0]:
            a, b, docs, spots = (np.concatenate(c) for c in out)
            order = np.lexsort((spots, docs, b, a))
            a, b, docs, spots = a[order], b[order], docs[order], spots[order]
            later = _not_first(a, b, docs, spots)
            # What is settled goes along under a key of its own.
            yield [np.where(later, docs, a), np.where(later, spots, b), docs, spots, later]


def _not_first(a, b, docs, spots) -> np.ndarray:
    """Which sorted rows have another place than the first row of their key."""
    start = np.ones(len(a), bool)
    start[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    first = np.maximum.accumulate(np.where(start, np.arange(len(a)), 0))
    return (docs != docs[first]) | (spots != spots[first])


def _later(batches):
    """Places that are not the first of their key; rows come sorted by key and place."""
    held = None  # the first row of the key that may go on in the next batch
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = [c.to_numpy() for c in batch.columns[:4]]
        if held is not None:
            rows = [np.concatenate([[h], c]) for h, c in zip(held, rows, strict=True)]
        later = _not_first(*rows)
        first = len(later) - 1
        while first and rows[0][first - 1] == rows[0][-1] and rows[1][first - 1] == rows[1][-1]:
            first -= 1
        later_here = later[held is not None :]
        held = [c[first] for c in rows]
        docs, spots = (batch.column(k).to_numpy() for k in (2, 3))
        later_here = later_here | batch.column(4).to_numpy(zero_copy_only=False)
        yield [docs[later_here], spots[later_here]]


def dedup_substrings(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Remove every word in a window of words that also starts earlier.

    Earlier is a smaller ``doc_id`` or, in one document, an earlier start; windows are judged on
    the input.  Returns ``doc_id``, ``n_words``, ``n_removed``, ``kept`` (the kept words joined
    by blanks; null where nothing was removed) and ``kept_sha256``, one row per input row.

    Null and empty texts have no words; texts with fewer than ``window`` words keep them all.  A
    null id counts as larger than any other.  Equal rows are one document; different texts under
    one id are told apart by place first, then by content.
    """
    text = F.col("text").cast("string")
    texts = docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("doc_id"),
        (F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF))).alias("tag"),
        text.alias("text"),
    )
    fields = "doc_id bigint, tag bigint, n_words bigint, a bigint, b bigint, kept_sha256 string"
    known = written(gather(texts, fields, lambda: _emit_contents), "contents")
    first = known.groupBy("a", "b").agg(F.min("doc_id").alias("first"))
    marked = known.join(first, ["a", "b"]).withColumn(
        "copy", (F.col("n_words") >= window) & (F.col("doc_id") > F.col("first"))
    )
    spans = repeated_spans(texts, window)
    joined = texts.join(spans, ["doc_id", "tag"]).select("doc_id", "tag", "starts", "text")
    fields = "doc_id bigint, tag bigint, n_removed bigint, kept string, sha string"
    make = lambda: partial(_emit_kept, window=window)
    edited = gather(joined, fields, make).dropDuplicates(["doc_id", "tag"])
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    return (
        marked.join(edited, ["doc_id", "tag"], "left")
        .select(
            F.nullif("doc_id", F.lit(_LAST)).alias("doc_id"),
            "n_words",
            F.when(F.col("copy"), F.col("n_words"))
            .otherwise(F.coalesce("n_removed", F.lit(0)))
            .alias("n_removed"),
            F.when(F.col("copy"), F.lit("")).otherwise(F.col("kept")).alias("kept"),
            F.when(F.col("copy"), nothing)
            .otherwise(F.coalesce("sha", "kept_sha256"))
            .alias("kept_sha256"),
        )
    )


def _emit_contents(batches):
    for batch in batches:
        rows = []
        for doc, tag, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            sha = hashlib.sha256(b" ".join(words)).hexdigest()
            rows.append((doc, tag, len(words), *_content(words), sha))
        yield list(zip(*rows, strict=True)) if rows else [[]] * 6


def _emit_kept(batches, window):
    for batch in batches:
        rows = []
        for doc, tag, starts, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = words_of(text)
            edges = np.zeros(len(words) + 1, np.int64)
            np.add.at(edges, starts, 1)
            np.add.at(edges, np.array(starts) + window, -1)
            keep = np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()
            kept = b" ".join([words[k] for k in keep])
            rows.append((doc, tag, len(words) - len(keep), kept.decode(),
                         hashlib.sha256(kept).hexdigest()))
        if rows:
            yield list(zip(*rows, strict=True))
