"""Token counts of a unigram tokenizer, without making the tokens.

An Aho-Corasick automaton enumerates all vocabulary pieces in a text; dynamic programming over
their ends carries the best score and the number of pieces.  Rules, those of the library whose
model files are read: a piece beats another with the same end only by a strictly better total,
starts being tried from the left; a character that is no piece itself is an unknown one, at the
least score minus 10; unknown characters count as their bytes with byte fallback, otherwise a
run of them as one token.

No piece has a space mark behind another character (checked), so the best path of a text is that
of its space-separated parts, and parts are looked up in a bounded cache.
"""

from __future__ import annotations

import re

import ahocorasick
from pyspark.sql import DataFrame

from .texts import map_texts

MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Parts remembered in a task by each of two generations, and the longest of them.
CACHED, CACHED_CHARS = 500_000, 64
#: Between parts that are searched together; no piece and no part has it.
_BREAK = "\x00"

_PART = re.compile(f"{MARK}*[^{MARK}]*")


class Vocabulary:
    """Pieces with scores, and how text is prepared for them; plain data, small enough to send."""

    def __init__(self, pieces: dict[str, float], byte_fallback: bool, dummy_prefix: bool = True):
        self.pieces, self.byte_fallback, self.dummy_prefix = pieces, byte_fallback, dummy_prefix

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        """Of a model file whose spaces become marks one by one and are not normalised else."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ordinary = [
            k
            for k in range(model.get_piece_size())
            if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k))
        ]
        pieces = {model.id_to_piece(k): model.get_score(k) for k in ordinary}
        byte_fallback = any(model.is_byte(k) for k in range(model.get_piece_size()))
        return cls(pieces, byte_fallback)


class Counter:
    def __init__(self, vocabulary: Vocabulary):
        self.own = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary.pieces.items():
            if piece:
                self.automaton.add_word(piece, (len(piece), score))
        self.unknown = min(vocabulary.pieces.values(), default=0.0) - UNKNOWN_PENALTY
        self.whole = any(re.search(f"[^{MARK}]{MARK}", p) for p in vocabulary.pieces)
        if len(self.automaton):
            self.automaton.make_automaton()
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}

    def count_all(self, texts: list[str | None]) -> list[int]:
        """Pieces on the best path of each text; 0 for null and empty ones."""
        split = [self.parts(t) for t in texts]
        known = self.known({p for parts in split for p in parts})
        if self.own.byte_fallback:
            return [sum(map(known.__getitem__, parts)) for parts in split]
        return [self.fused(map(known.__getitem__, parts)) for parts in split]

    @staticmethod
    def fused(parts) -> int:
        """A run of unknown characters goes on across parts."""
        total, joined = 0, 0
        for value in parts:
            total += (value >> 2) - (joined and value >> 1 & 1)
            joined = value & 1
        return total

    def parts(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.replace(" ", MARK)
        if self.own.dummy_prefix:
            text = MARK + text
        if self.whole:
            return [text]
        if text[0] != MARK or text[-1] == MARK or MARK in text[1:2] or MARK * 2 in text:
            return [p for p in _PART.findall(text) if p]
        return text.replace(MARK, " " + MARK)[1:].split(" ")

    def known(self, parts: set[str]) -> dict[str, int]:
        """Pieces of each part; without byte fallback times four, plus two if the first is an
        unknown character and one if the last is."""
        found = {}
        for part in parts:
            value = self.young.get(part)
            if value is None:
                value = self.old.get(part)
            if value is not None:
                found[part] = value
        new = list(parts - found.keys())
        chunk, size = [], 0
        for k, part in enumerate(new):
            chunk.append(part)
            size += len(part)
            if size > 100_000 or k == len(new) - 1:
                found.update(zip(chunk, self.viterbi(chunk), strict=True))
                chunk, size = [], 0
        if len(self.young) + len(parts) > CACHED:
            self.old, self.young = self.young, {}
        for part, value in found.items():
            if len(part) <= CACHED_CHARS:
                if len(self.young) >= CACHED:
                    break
                self.young[part] = value
        return found

    def viterbi(self, parts: list[str]) -> list[int]:
        """One search for all parts, which stand one break apart; paths start anew after each."""
        text = _BREAK.join(parts)
        size = len(text)
        best, pieces = [0.0] * (size + 1), [0] * (size + 1)
        first, last = bytearray(size + 1), bytearray(size + 1)  # unknown at the path's ends
        ends, at = [], -1
        for part in parts:
            at += len(part) + 1
            ends.append(at)
        fresh = bytearray(size + 2)  # places where a path starts
        fresh[0] = 1
        for end in ends:
            fresh[end + 1] = 1

        def unknown(end):
            """The last character is no piece."""
            start = end - 1
            best[end] = best[start] + self.unknown
            more = 1 if not last[start] or fresh[start] else 0
            if self.own.byte_fallback:
                more = len(text[start].encode())
            pieces[end] = pieces[start] + more
            first[end] = 1 if fresh[start] else first[start]
            last[end] = 1

        def step(end, top, start, length):
            """Nothing or the best piece ends here; ``length`` is of the shortest that does."""
            if fresh[end]:
                return
            if top is None or length != 1 and best[end - 1] + self.unknown > top:
                unknown(end)
            else:
                best[end], pieces[end] = top, pieces[start] + 1
                first[end] = 0 if fresh[start] else first[start]

        here, top, start, length = 0, None, 0, 0
        for end, (size_of, score) in self.automaton.iter(text) if len(self.automaton) else ():
            end += 1
            if end != here:
                if here:
                    step(here, top, start, length)
                for between in range(here + 1, end):
                    step(between, None, 0, 0)
                here, top = end, None
            # Longest first, so the leftmost start is tried first and ties stay with it.
            total = best[end - size_of] + score
            if top is None or total > top:
                top, start = total, end - size_of
            length = size_of
        if here:
            step(here, top, start, length)
        for between in range(here + 1, size + 1):
            step(between, None, 0, 0)
        if self.own.byte_fallback:
            return [pieces[e] for e in ends]
        return [pieces[e] << 2 | first[e] << 1 | last[e] for e in ends]


def count_tokens(
    docs: DataFrame,
    vocabulary: Vocabulary,
    text: str = "text",
    keep: tuple[str, ...] | None = None,
) -> DataFrame:
    """``row`` (kept columns) and ``n_tokens``, one row per input row; null and empty give 0."""
    parts = (vocabulary.pieces, vocabulary.byte_fallback, vocabulary.dummy_prefix)
    shared = docs.sparkSession.sparkContext.broadcast(parts)

    def make():
        counter = Counter(Vocabulary(*shared.value))
        return lambda texts: [counter.count_all(texts)]

    return map_texts(docs, "n_tokens bigint", make, text, keep)
