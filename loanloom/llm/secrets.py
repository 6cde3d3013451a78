"""Secret scan: fixed patterns, and a randomness test battery for what they miss.

Candidates are runs of token characters.  For each the alphabet of its encoding is inferred, and
two things must hold for it to be reported:

* it passes for a random draw from that alphabet: chi-squared uniformity, a runs test about the
  alphabet's middle and lag-one serial correlation, Bonferroni-corrected;
* it cannot pass for text: the likelihood ratio of a random draw against a character-pair model
  of the corpus is an e-value, so its inverse is a p-value for "ordinary text"; a
  Benjamini-Hochberg step within each length class bounds the share of false discoveries, so
  that many short words do not hide behind few long keys or the other way round.

The pair counts and the p-values are of all documents.  The first are a table of fixed size, the
second a histogram by length class and whole bits.
"""

from __future__ import annotations

import math
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import gather, map_texts, written

#: Kinds in the order in which ties are listed; the last is what the battery adds.
KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)",
    re.IGNORECASE | re.ASCII,
)
_ACCESS = re.compile("AKIA[A-Z0-9]{14,}")
_HEX = re.compile("[0-9a-f]{16,}")
LEAST_VALUE = 12

LEAST_CANDIDATE = 16
_CANDIDATE = re.compile(f"[A-Za-z0-9+/_-]{{{LEAST_CANDIDATE},}}")
#: Share of false discoveries in a length class, and level of the battery.
FALSE_SHARE, LEVEL = 0.01, 0.001
#: Length classes go by powers of two from LEAST_CANDIDATE on; the last is open.
CLASSES, MOST_BITS = 6, 512

#: Token characters in the order of their code in the pair model; any other byte is code 0.
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+/-_"
_CODES = bytes(ALPHABET.find(chr(b)) + 1 if b < 128 else 0 for b in range(256))
_PAIRS = len(ALPHABET) + 1
#: Inferred encodings: name and alphabet, the narrowest that holds all characters counts.
ENCODINGS = (
    ("hex", "0123456789abcdef"),
    ("hex", "0123456789ABCDEF"),
    ("base32", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
    ("base36", "0123456789abcdefghijklmnopqrstuvwxyz"),
    ("base62", ALPHABET[:62]),
    ("base64", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"),
    ("base64url", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"),
    ("mixed", ALPHABET),
)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """``(start, kind, end)`` of the fixed patterns, in code points."""
    out = []
    if "=" in text or ":" in text:
        for m in _ASSIGN.finditer(text):
            if len(m[2]) >= LEAST_VALUE:
                out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def _pair_counts(batches):
    counts = np.zeros(_PAIRS * _PAIRS, np.int64)
    for batch in batches:
        for text in batch.column(0).to_pylist():
            if text:
                codes = np.frombuffer(text.encode().translate(_CODES), np.uint8).astype(np.int64)
                counts += np.bincount(codes[:-1] * _PAIRS + codes[1:], minlength=len(counts))
    used = np.flatnonzero(counts)
    yield [used, counts[used]]


def pair_model(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Bits that each character costs after each other one, in the text of the corpus."""
    texts = docs.select(docs[f"`{text}`"].cast("string").alias("text"))
    counted = gather(texts, "pair int, n bigint", lambda: _pair_counts)
    counts = np.full(_PAIRS * _PAIRS, 0.5)
    for row in counted.groupBy("pair").agg(F.sum("n").alias("n")).collect():
        counts[row["pair"]] += row["n"]
    counts = counts.reshape(_PAIRS, _PAIRS)
    return -np.log2(counts / counts.sum(axis=1, keepdims=True))


def encoding(token: str) -> tuple[str, str]:
    seen = set(token)
    return next(e for e in ENCODINGS if seen <= set(e[1]))


def battery(token: str, alphabet: str) -> float:
    """Bonferroni-corrected p-value of "drawn uniformly from the alphabet"."""
    n, k = len(token), len(alphabet)
    place = np.array([alphabet.index(c) for c in token], float)
    seen = np.bincount(place.astype(int), minlength=k)
    chi = ((seen - n / k) ** 2).sum() / (n / k)
    df = k - 1
    z = ((chi / df) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df))
    uniform = math.erfc(z / math.sqrt(2)) / 2
    high = place >= k / 2
    above, below = high.sum(), n - high.sum()
    runs = 1 + (high[1:] != high[:-1]).sum()
    mean = 1 + 2 * above * below / n
    spread = max((mean - 1) * (mean - 2) / (n - 1), 1e-9)
    crossing = math.erfc(abs(runs - mean) / math.sqrt(2 * spread)) if above and below else 0.0
    gap = place - place.mean()
    whole = (gap**2).sum()
    lag = (gap[1:] * gap[:-1]).sum() / whole if whole else 1.0
    serial = math.erfc(abs(lag) * math.sqrt(n / 2))
    return min(1.0, 3 * min(uniform, crossing, serial))


def _bits(tokens: list[str], model: np.ndarray) -> np.ndarray:
    """How many bits likelier each token is as a random draw than as text."""
    codes = np.frombuffer("".join(tokens).encode().translate(_CODES), np.uint8).astype(np.int64)
    sizes = np.array([len(t) for t in tokens])
    starts = np.cumsum(sizes) - sizes
    before = np.concatenate([[0], codes[:-1]])
    before[starts] = 0
    cost = np.add.reduceat(model[before, codes], starts)
    has = lambda low, high: np.logical_or.reduceat((codes >= low) & (codes <= high), starts)
    digit, upper, lower, marks = has(1, 10), has(11, 36), has(37, 62), has(63, 66)
    beyond = has(17, 36) | has(43, 62)  # a letter that is no hex digit
    one_case = ~(upper & lower)
    size = np.select(
        [marks, ~digit & ~upper & ~lower, one_case & ~beyond, one_case], [64, 1, 16, 36], 62
    )
    digits_only = digit & ~upper & ~lower & ~marks
    return np.where(digits_only, -1.0, cost - sizes * np.log2(size))


def _class(size: int) -> int:
    return min(CLASSES - 1, (size // LEAST_CANDIDATE).bit_length() - 1)


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] | None = None) -> DataFrame:
    """``row`` (kept columns) and ``spans``, an array of kind, start, end (code points, end
    exclusive), encoding and bits, by start and then kind.

    One row per input row; null and empty texts have no spans.  What the battery adds lies in no
    span of the fixed patterns.  Numbers (digits only) are no candidates for it.
    """
    shared = docs.sparkSession.sparkContext.broadcast(pair_model(docs, text))

    def make():
        model = shared.value

        def kernel(texts):
            spans, likely, unlikely = [], [], []
            found = []
            for k, t in enumerate(texts):
                base = base_spans(t) if t else []
                spans.append([(KINDS[kind], start, end) for start, kind, end in base])
                likely.append([])
                unlikely.append([0] * CLASSES)
                if t:
                    found += [(k, m.start(), m.end(), m[0]) for m in _CANDIDATE.finditer(t)]
            bits = _bits([f[3] for f in found], model) if found else []
            for (k, start, end, token), b in zip(found, bits, strict=True):
                name, alphabet = encoding(token) if b >= 1 else (None, None)
                if name and battery(token, alphabet) >= LEVEL:
                    bin_ = min(MOST_BITS, int(b))
                    likely[k].append((start, end, name, _class(end - start), bin_))
                else:
                    unlikely[k][_class(end - start)] += 1
            return [spans, likely, unlikely]

        return kernel

    fields = (
        "spans array<struct<kind:string,start:int,end:int>>, "
        "likely array<struct<start:int,end:int,encoding:string,cls:int,bits:int>>, "
        "unlikely array<bigint>"
    )
    found = written(map_texts(docs, fields, make, text, keep), "secrets")
    least = least_bits(found)
    inside = lambda c: F.exists(
        "spans", lambda s: (s["start"] <= c["start"]) & (s["end"] >= c["end"])
    )
    limit = F.array(*[F.lit(b) for b in least])
    added = F.filter(
        "likely", lambda c: (c["bits"] >= F.get(limit, c["cls"])) & ~inside(c)
    )
    span = lambda s, kind, encoding, bits: F.struct(
        s["start"].alias("start"), kind.alias("order"), s["end"].alias("end"),
        encoding.alias("encoding"), bits.alias("bits"),
    )
    kinds = F.array(*[F.lit(k) for k in KINDS])
    base = F.transform(
        "spans",
        lambda s: span(
            s, F.array_position(kinds, s["kind"]).cast("int"),
            F.lit(None).cast("string"), F.lit(None).cast("int"),
        ),
    )
    new = F.transform(added, lambda s: span(s, F.lit(len(KINDS)), s["encoding"], s["bits"]))
    return found.select(
        "row",
        F.transform(
            F.array_sort(F.concat(base, new)),
            lambda s: F.struct(
                F.get(kinds, s["order"] - 1).alias("kind"), s["start"].alias("start"),
                s["end"].alias("end"), s["encoding"].alias("encoding"), s["bits"].alias("bits"),
            ),
        ).alias("spans"),
    )


def least_bits(found: DataFrame) -> list[int]:
    """Benjamini-Hochberg by length class: the bits from which candidates are discoveries."""
    counts = (
        found.select(F.explode("likely").alias("c"))
        .groupBy(F.col("c.cls").alias("cls"), F.col("c.bits").alias("bits"))
        .agg(F.count("*").alias("n"))
        .collect()
    )
    low = found.agg(
        *[F.coalesce(F.sum(F.col("unlikely")[k]), F.lit(0)).alias(f"n{k}") for k in range(CLASSES)]
    ).first()
    out = []
    for cls in range(CLASSES):
        by = sorted(((r["bits"], r["n"]) for r in counts if r["cls"] == cls), reverse=True)
        total = low[cls] + sum(n for _, n in by)
        least, seen = MOST_BITS + 1, 0
        for bits, n in by:
            seen += n
            if 2.0**-bits <= FALSE_SHARE * seen / total:
                least = bits
        out.append(least)
    return out
