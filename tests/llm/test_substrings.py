from __future__ import annotations

import hashlib
import random

import numpy as np
import pytest

from loanloom.llm import queries, substrings, texts
from loanloom.llm.substrings import dedup_substrings


def brute(docs, window=20):
    """Every window against every earlier one."""
    split = {d: (t or "").encode().split() for d, t in docs}
    seen, out = set(), {}
    for doc in sorted(split):
        words, gone = split[doc], set()
        for k in range(len(words) - window + 1):
            key = tuple(words[k : k + window])
            if key in seen:
                gone.update(range(k, k + window))
            seen.add(key)
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone)
        out[doc] = (len(words), len(gone), hashlib.sha256(kept).hexdigest())
    return out


def random_docs(seed, count=150):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(200)] + ["é", "日本", "a b"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(rng.choice([19, 20, 21, 39, 40, 60])) for _ in range(8)]
    docs = []
    for k in range(count):
        words = say(rng.randint(0, 60))
        for _ in range(rng.randint(0, 2)):
            at = rng.randint(0, len(words))
            words[at:at] = rng.choice(passages)
        if k and rng.random() < 0.2:
            words = docs[rng.randrange(k)][1].split()
            if rng.random() < 0.5 and words:
                words[rng.randrange(len(words))] = "changed"
        if rng.random() < 0.1:
            words = ["same"] * rng.randint(15, 60)
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(words)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2])
def test_query_equals_brute_force(spark, folder, seed):
    docs = random_docs(seed)
    path = folder(documents=spark.createDataFrame(docs, "doc_id long, text string"))
    rows = queries.op6_substrings(spark, path).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in rows} == brute(docs)


def test_full_table_changes_nothing(spark, monkeypatch):
    docs = random_docs(4)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    monkeypatch.setattr(texts, "MOST_BITS", 64)
    found = {
        r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in dedup_substrings(df).collect()
    }
    assert found == brute(docs)


@pytest.mark.parametrize("window", [2, 3, 7, 20])
def test_levels(window):
    rng = np.random.default_rng(0)
    hashes = rng.integers(0, 5, 300).astype(np.uint64)
    runs = substrings._levels(hashes, window)
    by = {}
    for k, h in enumerate(runs.tolist()):
        by.setdefault(h, set()).add(tuple(hashes[k : k + window].tolist()))
    assert len(runs) == 300 - window + 1 and all(len(v) == 1 for v in by.values())
    assert len(by) == len({tuple(hashes[k : k + window].tolist()) for k in range(len(runs))})


def test_odd_rows(spark, odd, empty):
    rows = dedup_substrings(odd).collect()
    assert len(rows) == odd.count()
    by = {(r.doc_id, r.n_words): r for r in rows}
    assert by[(1, 0)].n_removed == 0 and by[(None, 2)].n_removed == 0
    assert by[(8, 30_000)].n_removed == 30_000 - 1 and by[(8, 30_000)].kept == "word"
    assert dedup_substrings(empty).count() == 0


def test_rows_that_share_an_id(spark):
    text = " ".join(f"x{k}" for k in range(25))
    rows = [(1, text), (1, text), (1, "y " + text), (None, text), (2, text + " z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted(
        ((r.doc_id or 99, r.n_words, r.n_removed) for r in dedup_substrings(df).collect())
    )
    assert found == [(1, 25, 0), (1, 25, 0), (1, 26, 25), (2, 26, 25), (99, 25, 25)]


def test_first_places_across_batches():
    import pyarrow as pa

    keys = [1, 1, 1, 1, 2, 2, 3]
    docs, spots = [5, 5, 6, 6, 1, 1, 9], [0, 0, 0, 1, 4, 4, 0]
    settled = [False] * 6 + [True]
    for step in (1, 2, 3, 7):
        batches = [
            pa.RecordBatch.from_arrays(
                [pa.array(c[k : k + step]) for c in (keys, keys, docs, spots, settled)],
                names=["a", "b", "doc_id", "spot", "later"],
            )
            for k in range(0, 7, step)
        ]
        found = [p for part in substrings._later(iter(batches)) for p in zip(*part)]
        assert found == [(6, 0), (6, 1), (9, 0)]
