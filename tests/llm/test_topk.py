from __future__ import annotations

import math
import random

import numpy as np
import pytest

from loanloom.llm import queries, topk
from loanloom.llm.topk import Search, cover_tree, integers, top_k


def brute(rows, every=50, k=5):
    """Every query against every row with Python integers."""
    good = [
        (i, [math.floor(256 * float(np.float32(x))) for x in v])
        for i, v in rows
        if i is not None and v is not None
        and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in good:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in good if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def random_rows(count, dims, seed=1, clusters=6, spread=0.1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(clusters, dims))
    x = middle[rng.integers(0, clusters, count)] + spread * rng.normal(size=(count, dims))
    return [(k, [float(v) for v in row]) for k, row in enumerate(x.astype(np.float32))]


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>")


def test_query_equals_brute_force(spark, folder, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 120)
    monkeypatch.setattr(topk, "GROUP", 4)
    monkeypatch.setattr(topk, "TOGETHER", 3)
    rows = random_rows(1000, 8)
    rows += [(2000 + k, rows[0][1]) for k in range(20)]  # ties
    rows += [(3000, None), (3050, [1.0] * 7 + [None]), (3100, [1.0] * 7 + [float("nan")]),
             (3150, [float("inf")] * 8), (None, [9.0] * 8), (3200, [0.0] * 8)]
    path = folder(embeddings=embeddings(spark, rows))
    found = sorted(tuple(r) for r in queries.op1_topk(spark, path).collect())
    assert found == brute(rows)


@pytest.mark.parametrize("shape", ["clusters", "spread", "line", "same"])
def test_trees_prune_and_stay_exact(shape):
    rng = np.random.default_rng(3)
    x = {
        "clusters": rng.integers(-500, 500, (20, 16))[rng.integers(0, 20, 3000)]
        + rng.integers(-5, 6, (3000, 16)),
        "spread": rng.integers(-500, 500, (3000, 16)),
        "line": np.outer(np.arange(3000), np.ones(16, int)),
        "same": np.ones((3000, 16), int),
    }[shape].astype(np.int64)
    ids = rng.permutation(3000)
    rows, mine = cover_tree(x, ids), cover_tree(x[:100], ids[:100])
    for tree in (rows, mine):
        for k, (start, end) in enumerate(tree.bounds):
            away = np.sqrt(((tree.points[start:end] - tree.centers[k]) ** 2).sum(axis=1))
            assert away.max() <= tree.radii[k] + 1e-6
        assert sorted(tree.ids) == sorted(ids[: len(tree.ids)])
    search = Search(mine, np.full(100, -1e18), 5)
    scored = []
    plain = search._score
    search._score = lambda a, b, t, c, d: (scored.append((b - a) * (d - c)), plain(a, b, t, c, d))
    search.visit(rows)
    where = {int(i): k for k, i in enumerate(mine.ids)}
    product = x[:100] @ x.T
    for k in range(100):
        best = sorted((-s, i) for s, i in zip(product[k].tolist(), ids.tolist()) if i != ids[k])
        at = where[int(ids[k])]
        assert list(zip((-search.scores[at]).tolist(), search.found[at].tolist())) == best[:5]
    if shape == "clusters":
        assert sum(scored) < 0.5 * 100 * 3000


def test_few_and_odd_rows(spark):
    rows = [(0, [1.0, 2.0]), (1, [1.0]), (2, []), (50, [0.5, 0.5]), (50, [0.5, 0.5])]
    points = integers(embeddings(spark, rows))
    found = sorted(tuple(r) for r in top_k(points, points.where("vec_id % 50 = 0")).collect())
    one = 256 * 256
    assert found == [
        (0, 1, 50, one + one // 2), (0, 2, 50, one + one // 2), (0, 3, 1, one), (0, 4, 2, 0),
        (50, 1, 0, one + one // 2), (50, 2, 1, one // 2), (50, 3, 2, 0),
    ]
    assert top_k(points.limit(0), points).count() == 0
    assert top_k(points, points.limit(0)).count() == 0


def test_large_components_stay_exact(spark):
    rng = random.Random(4)
    rows = [(k, [rng.uniform(-1, 1) * 1e13 for _ in range(4)]) for k in range(60)]
    rows += [(k + 100, [*v[:3], v[3] + 1.0]) for k, v in rows[:30]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    points = integers(df)
    clip = lambda s: max(-(2**63), min(2**63 - 1, s))
    own = [(i, [math.floor(256 * x) for x in v]) for i, v in rows]
    expected = []
    for q, a in own:
        if q % 50 == 0:
            scores = sorted((-clip(sum(x * y for x, y in zip(a, b))), i) for i, b in own if i != q)
            expected += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:5])]
    found = sorted(tuple(r) for r in top_k(points, points.where("vec_id % 50 = 0")).collect())
    assert found == sorted(expected)
