from __future__ import annotations

import random
from pathlib import Path

import pytest

from loanloom.llm import queries
from loanloom.llm.tokens import MARK, Counter, Vocabulary, count_tokens

needs_file = pytest.mark.skipif(
    not Path(queries.VOCABULARY).exists(), reason="needs the tokenizer files"
)


def reference(vocabulary):
    """The tokenizers library's own model over the same pieces."""
    tokenizers = pytest.importorskip("tokenizers")
    pieces = [("<unk>", -2e9)]
    if vocabulary.byte_fallback:
        pieces += [(f"<0x{b:02X}>", -2e9) for b in range(256)]
    model = tokenizers.models.Unigram(
        pieces + list(vocabulary.pieces.items()), unk_id=0, byte_fallback=vocabulary.byte_fallback
    )
    tool = tokenizers.Tokenizer(model)
    steps = [tokenizers.normalizers.Replace(" ", MARK)]
    if vocabulary.dummy_prefix:
        steps.insert(0, tokenizers.normalizers.Prepend(MARK))
    tool.normalizer = tokenizers.normalizers.Sequence(steps)
    return lambda text: len(tool.encode(text, add_special_tokens=False).ids) if text else 0


def brute(vocabulary, text):
    """Best path by plain dynamic programming over all substrings of the whole text."""
    if not text:
        return 0
    text = (MARK if vocabulary.dummy_prefix else "") + text.replace(" ", MARK)
    unknown = min(vocabulary.pieces.values()) - 10
    best = [(0.0, ())]
    for end in range(1, len(text) + 1):
        top = None
        for start in range(end):
            score = vocabulary.pieces.get(text[start:end])
            unk = score is None and start == end - 1
            if score is not None or unk:
                total = best[start][0] + (unknown if unk else score)
                if top is None or total > top[0]:
                    top = (total, (*best[start][1], (start, end, unk)))
        best.append(top)
    count, before = 0, False
    for start, end, unk in best[-1][1]:
        if unk and vocabulary.byte_fallback:
            count += len(text[start:end].encode())
        else:
            count += not (unk and before)
        before = unk
    return count


@pytest.mark.parametrize("byte_fallback", [True, False])
@pytest.mark.parametrize("prefix", [True, False])
@pytest.mark.parametrize("spanning", [True, False])
def test_random_vocabularies_with_many_ties(byte_fallback, prefix, spanning):
    rng = random.Random(5)
    for _ in range(30):
        letters = "abc" + MARK
        pieces = {
            "".join(rng.choice(letters) for _ in range(rng.randint(1, 4))): float(-rng.randint(1, 4))
            for _ in range(12)
        }
        if not spanning:
            pieces = {p: s for p, s in pieces.items() if MARK not in p.lstrip(MARK)}
        vocabulary = Vocabulary(pieces or {"a": -1.0}, byte_fallback, prefix)
        counter = Counter(vocabulary)
        texts = [
            "".join(rng.choice("aabbcc dé\n\x00" + MARK) for _ in range(rng.randint(0, 12)))
            for _ in range(40)
        ]
        expected = [brute(vocabulary, t) for t in texts]
        assert counter.count_all(texts) == expected
        assert counter.count_all(texts) == expected  # from the cache


@needs_file
def test_equals_the_library_on_the_given_documents(spark):
    vocabulary = Vocabulary.load(queries.VOCABULARY)
    count = reference(vocabulary)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = queries.op7_tokens(spark, "/root/testdata/sf0.001").collect()
    expected = {r.doc_id: count(r.text) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in found} == expected
    texts = ["a  b", " lead", "trail ", "\n\n\t", "日本 語", "🙂🙂 x", "a" * 5000, MARK, ""]
    assert Counter(vocabulary).count_all(texts) == [count(t) for t in texts]


def test_cache_generations(monkeypatch):
    from loanloom.llm import tokens

    monkeypatch.setattr(tokens, "CACHED", 3)
    vocabulary = Vocabulary({"a": -1.0, "b": -1.0, MARK: -1.0, "ab": -1.5}, True)
    counter = Counter(vocabulary)
    for text in ["a b ab", "ba ab aab", "c d e f", "a b ab"]:
        assert counter.count_all([text]) == [brute(vocabulary, text)]


def test_odd_rows(spark, odd, empty):
    vocabulary = Vocabulary({"word": -1.0, "o": -3.0, "n": -3.0, MARK: -2.0}, True)
    found = {(r.row.doc_id, r.row.text): r.n_tokens for r in count_tokens(odd, vocabulary).collect()}
    assert found[(1, None)] == 0 and found[(2, "")] == 0
    assert found[(8, "word " * 30_000)] == 60_001
    assert found[(4, "one")] == 4
    assert count_tokens(odd, vocabulary).count() == odd.count()
    assert count_tokens(empty, vocabulary).count() == 0
