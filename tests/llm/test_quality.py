from __future__ import annotations

import random
import zlib

import pytest
from pyspark.sql import functions as F

from loanloom.llm import queries
from loanloom.llm.quality import index_vectors, keep_good, score_quality, word_vectors


@pytest.fixture(scope="module")
def taught(spark):
    """Documents of two kinds of words; labels for most of them."""
    rng = random.Random(3)
    good = [f"g{k}" for k in range(60)]
    bad = [f"B{k}###" for k in range(60)]
    docs = [
        (k, " ".join(rng.choice(bad if k % 3 == 0 else good) for _ in range(rng.randint(5, 40))))
        for k in range(400)
    ]
    labels = [(k, int(k % 3 != 0), 0) for k in range(300)]
    return (
        spark.createDataFrame(docs, "doc_id long, text string"),
        spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
    )


def test_learns_and_generalises(spark, taught, folder):
    docs, labels = taught
    path = folder(documents=docs, labels=labels)
    rows = queries.op9_quality(spark, path).collect()
    assert len(rows) == 400
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    assert sum(r.predicted == (r.doc_id % 3 != 0) for r in rows) >= 395


def test_held_out_labels_and_other_columns_change_nothing(spark, taught):
    docs, labels = taught
    wrong = F.when(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, 1 - F.col("quality"))
    other = labels.withColumn("quality", F.coalesce(wrong, F.col("quality")))
    score = lambda d, l: sorted(
        (r.row.doc_id, r.score) for r in score_quality(d, l, keep=("doc_id",)).collect()
    )
    assert score(docs, labels) == score(docs.withColumn("lang", F.lit("x")), other)


def test_word_vectors_are_neighbour_sums(spark):
    import numpy as np

    from loanloom.llm.quality import BUCKETS

    bucket = lambda w: zlib.crc32(w) & (BUCKETS - 1)
    docs = spark.createDataFrame([(1, "a b c d"), (2, "b")], "doc_id long, text string")
    places, signs = index_vectors()
    expected = np.zeros(32)
    for near in (b"a", b"b", b"d"):
        for k in range(4):
            expected[places[bucket(near), k]] += signs[bucket(near), k]
    found = word_vectors(docs)[bucket(b"c")]
    assert np.allclose(found, expected / np.linalg.norm(expected), atol=1e-6)


def test_odd_rows(spark, odd, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels = spark.createDataFrame(
        [(None, 1), (1, None), (6, 1), (6, 0), (99, 1)], "doc_id long, quality int"
    )
    assert {r.score for r in score_quality(odd, none).collect()} == {0.5}
    found = score_quality(odd, labels).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert score_quality(empty, labels).count() == 0
    assert keep_good(odd, labels).columns == odd.columns
