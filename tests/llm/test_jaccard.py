from __future__ import annotations

import random

import numpy as np
import pytest

from loanloom.llm import jaccard, queries
from loanloom.llm.jaccard import RTree, _enough, jaccard_groups, keep_one
from loanloom.llm.texts import connected


def sets_of(docs, size=4):
    out = {}
    for doc, text in docs:
        words = (text or "").encode().lower().split()
        out[doc] = {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}
        if not words:
            out[doc] = set()
    return out


def brute(docs):
    """Every pair of sets, then components by search."""
    sets = sets_of(docs)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    return {d: (len(sets[d]), root(d)) for d in ids}


def random_docs(seed, count=250, chain=0):
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and"] * 5 + [f"w{k}" for k in range(60)] + ["É", "b c"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage = say(30)
    docs = []
    for k in range(count):
        if k and rng.random() < 0.6:
            words = docs[rng.randrange(k)][1].split()
            for _ in range(rng.randint(0, 3)):
                if words:
                    words[rng.randrange(len(words))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                words = words[: int(len(words) * 0.9)]
        else:
            words = say(rng.choice([0, 1, 3, 4, 8, 9, 12, 40, 100]))
            if rng.random() < 0.3:
                words += passage
        text = " ".join(words)
        docs.append((k, text.upper() if rng.random() < 0.2 else text))
    # A chain of small steps: its ends are unlike but connected.
    words = say(chain and 80)
    for k in range(chain):
        docs.append((count + k, " ".join(words)))
        words[k % 80] = f"new{k}"
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_query_equals_brute_force(spark, folder, seed, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(jaccard, "TILE", 5)
        monkeypatch.setattr(jaccard, "NODE", 3)
        monkeypatch.setattr(jaccard, "TREE", 20)
    docs = random_docs(seed, chain=40 if seed == 3 else 0)
    path = folder(documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(6))
    rows = queries.op8_jaccard(spark, path).collect()
    assert len(rows) == len(docs)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == brute(docs)
    kept = keep_one(spark.read.parquet(f"{path}/documents.parquet"))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(
        d for d, (n, c) in brute(docs).items() if c == d
    )


def test_tree_finds_all_pairs_that_pass_the_bound():
    rng = np.random.default_rng(0)
    points = rng.integers(0, 12, (400, 64)).astype(np.uint8)
    points[200:300] = np.minimum(points[:100] + rng.integers(0, 2, (100, 64)), 255)
    points[:5, 0] = 255
    sizes = points.sum(axis=1, dtype=np.int64)
    pages = rng.integers(0, 30, 400)
    pages[200:300] = pages[:100]
    i, j = RTree(pages, points, sizes).pairs()
    found = {tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())}
    assert len(found) == len(i)
    expected = set()
    for a in range(400):
        for b in range(a + 1, 400):
            alike = 100 * min(sizes[a], sizes[b]) >= 85 * max(sizes[a], sizes[b])
            if pages[a] == pages[b] and alike and _enough(
                points[a : a + 1], points[b : b + 1], sizes[a : a + 1] + sizes[b], (100, 85)
            )[0]:
                expected.add((a, b))
    assert found == expected and len(expected) >= 90


def test_bound_never_loses_a_link():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n = rng.integers(6, 2000)
        a = np.unique(rng.integers(-(2**62), 2**62, n))
        b = np.unique(np.concatenate([a[rng.random(len(a)) > 0.08],
                                      rng.integers(-(2**62), 2**62, max(1, n // 15))]))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 85 * (len(a) + len(b) - both):
            p, q = (np.frombuffer(jaccard._point(x), np.uint8) for x in (a, b))
            for groups in (64, min(len(p), len(q))):
                x, y = (jaccard._fold(z, groups)[None] for z in (p, q))
                assert x.sum() == len(a) and y.sum() == len(b)
                assert _enough(x, y, np.array([len(a) + len(b)]), (100, 85))[0]


def test_components(spark):
    rng = random.Random(3)
    edges = [(k, k + 1) for k in range(0, 300) if k % 50 != 49]
    edges += [(1000, k) for k in range(1001, 1100)] + [(5, 5)]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in edges] * 2
    rng.shuffle(edges)
    df = spark.createDataFrame(edges, "a long, b long")
    found = {r.id: r.component for r in connected(df, "test").collect()}
    assert found == {k: k // 50 * 50 for k in range(300)} | {k: 1000 for k in range(1000, 1100)}
    assert connected(df.limit(0), "none").count() == 0


def test_odd_rows(spark, odd, empty):
    rows = jaccard_groups(odd).collect()
    assert len(rows) == odd.count()
    found = sorted({(r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in rows})
    assert found == [(0, 1, 0), (1, 0, 1), (2, 0, 2), (3, 0, 3), (4, 1, 4), (5, 2, 5), (6, 1, 6),
                     (7, 1, 6), (8, 1, 8)]
    assert jaccard_groups(empty).count() == 0 and keep_one(empty).count() == 0
    kept = keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6, 8]


def test_texts_under_one_id_hold_their_groups_together(spark):
    a, b = ("x%d " * 30) % tuple(range(30)), ("y%d " * 30) % tuple(range(30))
    rows = [(1, a), (5, a), (5, b), (7, b), (9, "z"), (9, ""), (9, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = sorted({(r.doc_id, r.component_id) for r in jaccard_groups(df).collect()})
    assert found == [(1, 1), (5, 1), (7, 1), (9, 9)]
    assert sorted((r.doc_id, len(r.text)) for r in keep_one(df).collect()) == [
        (1, len(a)), (9, 0), (9, 1)
    ]
