"""Benchmark decontamination as a prefix-filtered set join.

An item is a set of windows of ``window`` consecutive words (an item with fewer words is one
window).  A document contains a window only if it contains all of its shingles, so one of them is
enough to find it: shingles are ordered by how rare they are in the corpus and each window is
joined on its rarest.  The shingle's place gives where the window would have to lie; windows that
would not fit into the document are out, and the rest are compared word by word.

Documents are never shuffled: the windows go to them, in blocks of bounded size.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import gather, map_texts

WINDOW = 10
#: Words in a shingle, or fewer in a window with fewer words.
SHINGLE = 3
#: Item text in a block, in characters; an index takes about 30 times as many bytes.
BLOCK_CHARS = 4_000_000

#: Words are of the characters outside 00-2F, 3A-60 and 7B-7F, after A-Z are lower-cased.
_WORDS_ONLY = bytes(
    c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in bytes(range(256)).lower()
)


def words_of(text: str | None) -> list[bytes]:
    """Words with A-Z in lower case, as UTF-8."""
    return text.encode().translate(_WORDS_ONLY).split() if text else []


class Windows:
    """The distinct windows of a block of items, and which shingle finds each."""

    def __init__(self, items: list[tuple], window: int):
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple, set] = {}
        for item, text in items:
            ids = [
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(text)
            ]
            for at in range(max(1, len(ids) - window + 1) if ids else 0):
                found.setdefault(tuple(ids[at : at + window]), set()).add(str(item))
        self.base = len(self.vocabulary) + 1
        self.windows = [np.array(w, np.int64) for w in found]
        self.items = [sorted(x) for x in found.values()]
        #: Shingle size -> (sorted codes, window and offset of each).
        self.probes: dict[int, tuple] = {}

    @classmethod
    def of(cls, parts: dict) -> Windows:
        """Put together again from ``vars()``; broadcasts hold plain data only."""
        out = cls.__new__(cls)
        vars(out).update(parts)
        return out

    def ids(self, words: list[bytes]) -> np.ndarray:
        """Numbers of the words; 0 for those of no item."""
        return np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.int64, len(words))

    def stream(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The words of many texts in one row, a 0 after each text, and where texts start."""
        words: list[bytes] = []
        starts = [0]
        for text in texts:
            words += text
            words.append(b"")
            starts.append(len(words))
        return self.ids(words), np.array(starts)

    def codes(self, ids: np.ndarray, size: int) -> np.ndarray:
        """A number for the ``size`` words from each place on; 0 if one is of no item."""
        n = max(0, len(ids) - size + 1)
        out, known = np.zeros(n, np.int64), np.ones(n, bool)
        for k in range(size):
            part = ids[k : n + k]
            out = out * self.base + part
            known &= part > 0
        return out * known

    @staticmethod
    def places(codes: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``own`` that are in the sorted ``codes``, and where there (first)."""
        at = np.flatnonzero(own)
        first = np.searchsorted(codes, own[at])
        same = codes[np.minimum(first, len(codes) - 1)] == own[at]
        return at[same], first[same]

    def shingles(self) -> dict[int, np.ndarray]:
        """All codes by shingle size."""
        by: dict[int, list] = {}
        for w in self.windows:
            size = min(SHINGLE, len(w))
            by.setdefault(size, []).append(self.codes(w, size))
        return {size: np.unique(np.concatenate(parts)) for size, parts in by.items()}

    def order(self, seen: dict[tuple[int, int], int]) -> None:
        """Choose for each window its shingle with the fewest documents."""
        by: dict[int, list] = {}
        for k, w in enumerate(self.windows):
            size = min(SHINGLE, len(w))
            codes = self.codes(w, size).tolist()
            at = min(range(len(codes)), key=lambda i: (seen.get((size, codes[i]), 0), i))
            by.setdefault(size, []).append((codes[at], k, at))
        for size, rows in by.items():
            rows.sort()
            codes, which, offsets = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            self.probes[size] = codes, which, offsets

    def find(self, texts: list[list[bytes]]) -> list[tuple[list[int], list[str]]]:
        """For each text the positions of hit words and the ids of the items, both sorted."""
        ids, starts = self.stream(texts)
        hit = np.zeros(len(ids), bool)
        items: list[set] = [set() for _ in texts]
        for size, (codes, which, offsets) in self.probes.items():
            own = self.codes(ids, size)
            for at, k in zip(*(x.tolist() for x in self.places(codes, own)), strict=True):
                while k < len(codes) and codes[k] == own[at]:
                    window = self.windows[which[k]]
                    start = at - offsets[k]
                    end = start + len(window)
                    # A window never fits across the 0 between two texts.
                    if start >= 0 and end <= len(ids) and (ids[start:end] == window).all():
                        hit[start:end] = True
                        text = np.searchsorted(starts, start, "right") - 1
                        items[text].update(self.items[which[k]])
                    k += 1
        out = []
        for k, found in enumerate(items):
            place = np.flatnonzero(hit[starts[k] : starts[k + 1]]).tolist() if found else []
            out.append((place, sorted(found)))
        return out


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    text: str = "text",
    keep: tuple[str, ...] | None = None,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """``row`` (kept columns), ``n_words``, ``hits`` (positions of words) and ``item_ids``.

    One row per input row.  Null or wordless texts have no words and no hits.  Items without an
    id or without words take no part; repeated items count once by id.
    """
    spark = docs.sparkSession
    bench = items.select(F.col("item_id"), F.col("text").cast("string").alias("text")).where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_chars))
    block_of = F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks))
    columns = tuple(docs.columns) if keep is None else keep
    state = docs
    if blocks > 1:  # rows carry what earlier blocks found, beside the text for later ones
        state = docs.select(
            F.struct(*[docs[f"`{c}`"] for c in columns]).alias("row"),
            docs[f"`{text}`"].alias("text"),
            F.array().cast("array<int>").alias("hits"),
            F.array().cast("array<string>").alias("item_ids"),
        )
    for block in range(blocks):
        index = Windows(
            [tuple(r) for r in bench.where(block_of == block).distinct().collect()], window
        )
        index.order(_document_counts(docs, index, text))
        shared = spark.sparkContext.broadcast(vars(index))
        if blocks == 1:
            return _probe(docs, shared, text, columns)
        state = _probe(state, shared, "text", None).select(
            "row.row",
            "row.text",
            "n_words",
            F.array_sort(F.array_union("row.hits", "hits")).alias("hits"),
            F.array_sort(F.array_union("row.item_ids", "item_ids")).alias("item_ids"),
        )
    return state.drop("text")


def _document_counts(docs: DataFrame, index: Windows, text: str) -> dict:
    """In how many documents each shingle of the block occurs; at most a row per shingle."""
    known = index.shingles()
    shared = docs.sparkSession.sparkContext.broadcast((vars(index), known))

    def make():
        own, codes_of = Windows.of(shared.value[0]), shared.value[1]

        def count(batches):
            counts = {size: np.zeros(len(codes), np.int64) for size, codes in codes_of.items()}
            for batch in batches:
                texts = [words_of(t) for t in batch.column(0).to_pylist()]
                ids, starts = own.stream(texts)
                for size, codes in codes_of.items():
                    at, which = own.places(codes, own.codes(ids, size))
                    text = np.searchsorted(starts, at, "right")
                    once = np.unique(text * len(codes) + which) % len(codes)
                    counts[size] += np.bincount(once, minlength=len(codes))
            for size, n in counts.items():
                at = np.flatnonzero(n)
                yield [np.full(len(at), size), codes_of[size][at], n[at]]

        return count

    texts = docs.select(docs[f"`{text}`"].cast("string").alias("text"))
    rows = (
        gather(texts, "size int, code bigint, n bigint", make)
        .groupBy("size", "code")
        .agg(F.sum("n").alias("n"))
        .collect()
        if known
        else []
    )
    return {(r["size"], r["code"]): r["n"] for r in rows}


def _probe(docs: DataFrame, shared, text: str, keep: tuple[str, ...] | None) -> DataFrame:
    def make():
        index = Windows.of(shared.value)

        def kernel(texts):
            words = [words_of(t) for t in texts]
            found = index.find(words)
            return [[len(w) for w in words], [f[0] for f in found], [f[1] for f in found]]

        return kernel

    fields = "n_words bigint, hits array<int>, item_ids array<string>"
    return map_texts(docs, fields, make, text, keep)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents, columns unchanged, in which no window of any item occurs."""
    return find_passages(docs, items, window).where(F.size("hits") == 0).select("row.*")
