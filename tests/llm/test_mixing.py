from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loanloom.llm import queries
from loanloom.llm.mixing import mix


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(8)
    common = [f"w{chr(97 + k)}x" for k in range(20)]
    own = {"clean": ["fine"], "toxic": ["vile", "awful"], "junk": ["###", "!!!"]}
    docs, labels = [], []
    for k in range(600):
        domain = rng.choices(["clean", "toxic", "junk"], [0.7, 0.2, 0.1])[0]
        words = rng.choices(common, k=rng.randint(10, 60))
        for _ in range(rng.randint(2, 5)):
            words.insert(rng.randrange(len(words)), rng.choice(own[domain]))
        docs.append((k, " ".join(words)))
        if k % 2:
            labels.append((k, int(domain != "junk"), int(domain == "toxic")))
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        {k: next(d for d, w in own.items() if any(x in t for x in w)) for k, t in docs},
    )


def test_posteriors_and_totals(spark, corpus, folder):
    docs, labels, truth = corpus
    path = folder(documents=docs, labels=labels)
    rows = queries.op5_mixing(spark, path).collect()
    assert len(rows) == 600
    p = np.array([(r.p_clean, r.p_junk, r.p_toxic) for r in rows])
    domains = np.array(["clean", "junk", "toxic"])[p.argmax(axis=1)]
    assert sum(d == truth[r.doc_id] for d, r in zip(domains, rows)) >= 590
    n, rate = np.array([r.n_tokens for r in rows]), np.array([r.rate for r in rows])
    assert (rate >= 0).all() and np.allclose(p.sum(axis=1), 1, atol=0.02)
    got = (n * rate) @ p / n.sum()
    want = np.array([queries.TARGETS[d] for d in ("clean", "junk", "toxic")])
    assert np.abs(got - want).max() < 0.01
    # Optimal: no rate can move either way to a smaller weighted sum of squares.
    gram = (p * n[:, None]).T @ p / n.sum()
    slope = p @ ((got - want) / np.diag(gram))
    assert np.abs(slope[rate > 0]).max() < 0.02 and slope[rate == 0].min(initial=0) > -0.02
    # Copies are the rate on average and its two neighbours in each case.
    copies = np.array([r.copies for r in rows])
    assert (np.abs(copies - rate) < 1 + 1e-9).all()
    assert abs((copies * n).sum() - (rate * n).sum()) < 0.05 * n.sum()


def test_brute_force_gradient_steps(spark, corpus):
    """The same projected steps, document by document, in plain numbers."""
    docs, labels, _ = corpus
    targets = {"clean": 0.5, "junk": 0.3, "toxic": 0.2}
    rows = mix(docs, queries.domains_of(labels), targets).collect()
    p = np.array([r.p for r in rows])
    n = np.array([r.n_tokens for r in rows], float)
    want = np.array([targets[d] for d in sorted(targets)])
    total = n.sum()
    gram = (p * n[:, None]).T @ p / total
    weight = 1 / np.diag(gram)
    steepest = (gram * np.sqrt(np.outer(weight, weight))).sum(axis=1).max()
    step, before, rate = np.zeros(3), np.inf, np.ones(len(n))
    for _ in range(100):
        missed = (n * rate) @ p / total - want
        loss = (weight * missed**2).sum()
        if np.abs(missed).max() < 1e-5 or loss > before * (1 - 0.005):
            break
        before = loss
        step += weight * missed / steepest
        rate = np.maximum(0, 1 - p @ step)
    assert np.allclose([r.rate for r in rows], rate, atol=1e-6)
    assert np.abs((n * rate) @ p / total - want).max() < 0.01


def test_exact_fit_reaches_the_optimum(spark, corpus):
    """No target is further off than after many plain steps, whose sum of squares is no lower."""
    docs, labels, _ = corpus
    targets = {"clean": 0.95, "junk": 0.05, "toxic": 0.0}
    rows = mix(docs, queries.domains_of(labels), targets, exact=True).collect()
    p = np.array([r.p for r in rows])
    n = np.array([r.n_tokens for r in rows], float)
    want, total = np.array([targets[d] for d in sorted(targets)]), n.sum()
    gram = (p * n[:, None]).T @ p / total
    weight = 1 / np.diag(gram)
    steepest = (gram * np.sqrt(np.outer(weight, weight))).sum(axis=1).max()
    step = np.zeros(3)
    for _ in range(20_000):
        missed = (n * np.maximum(0, 1 - p @ step)) @ p / total - want
        step += weight * missed / steepest
    got = (n * np.array([r.rate for r in rows])) @ p / total - want
    assert np.abs(got).max() < np.abs(missed).max() + 0.002
    assert (np.array([r.rate for r in rows]) >= 0).all()


def test_small_posteriors_count(spark, corpus):
    """A domain that is unlikely everywhere keeps its tokens and its target."""
    docs, labels, _ = corpus
    known = queries.domains_of(labels).where("domain <> 'junk'")
    rows = mix(docs, known, {"clean": 0.9, "junk": 0.1, "toxic": 0.0}).collect()
    p = np.array([r.p for r in rows])
    assert (p > 0).all() and np.allclose(p.sum(axis=1), 1, atol=1e-9)
    prior = 1 / (known.count() + 3)
    assert prior < 0.005 and np.allclose(p[:, 1], prior)
    assert len({r.rate for r in rows}) > 1


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, domain string")
    found = mix(odd, none, {"a": 0.5, "b": 0.5}).collect()
    assert len(found) == odd.count()
    by = {(r.row.doc_id, r.row.text): r for r in found}
    assert by[(1, None)].n_tokens == 0 and list(by[(1, None)].p) == [0.5, 0.5]
    assert by[(8, "word " * 30_000)].n_tokens == 30_000
    assert all(abs(r.rate - 1) < 1e-3 for r in found)
    labels = spark.createDataFrame([(None, "a"), (4, None), (6, "b"), (6, "a"), (5, "zzz")],
                                   "doc_id long, domain string")
    assert mix(odd, labels, {"a": 1.0, "b": 0.0}).count() == odd.count()
    assert mix(empty, labels, {"a": 1.0}).count() == 0


def test_no_python_runs(spark, corpus):
    docs, labels, _ = corpus
    plan = mix(docs, queries.domains_of(labels), {"clean": 1.0})
    plan = plan.withColumn("x", F.lit(1))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
