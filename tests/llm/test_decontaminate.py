from __future__ import annotations

import hashlib
import random
import re

from pyspark.sql import functions as F

from loanloom.llm import queries
from loanloom.llm.decontaminate import decontaminate, find_passages, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items, window=10):
    """Every window of every item against every place of every document."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: WORD.findall((t or "").translate(lower))
    out = {}
    for doc, text in docs:
        words, hit, found = split(text), set(), set()
        for item, passage in items:
            own = split(passage)
            size = min(window, len(own))
            for at in range(len(own) - size + 1 if own else 0):
                for k in range(len(words) - size + 1):
                    if words[k : k + size] == own[at : at + size]:
                        hit.update(range(k, k + size))
                        found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out[doc] = (len(words), len(hit), len(found), digest, bool(hit))
    return out


def random_tables(seed=1):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "of", "x1", "é", "Ω9", "zz"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, say(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for k in range(30)]
    docs = []
    for k in range(60):
        text = say(rng.randint(0, 40))
        for _ in range(rng.randint(0, 2)):
            words = rng.choice(items)[1].split()
            cut = rng.randint(0, len(words) - 1)
            text += ", " + " ".join(words[cut:]).upper().replace("É", "é") + "! " + say(3)
        docs.append((k, text))
    return docs, items


def test_words():
    found = [w.decode() for w in words_of("It's A-1 Ünï\x7f{é}")]
    assert found == ["it", "s", "a", "1", "Ünï", "é"]


def test_query_equals_brute_force(spark, folder):
    docs, items = random_tables()
    path = folder(
        documents=spark.createDataFrame(docs, "doc_id long, text string"),
        benchmark=spark.createDataFrame(items, "item_id long, text string"),
    )
    found = {r[0]: tuple(r)[1:] for r in queries.op3_decontaminate(spark, path).collect()}
    assert found == brute(docs, items)


def test_blocks_of_items_give_the_same(spark):
    docs, items = random_tables(2)
    docs = spark.createDataFrame(docs, "doc_id long, text string")
    items = spark.createDataFrame(items, "item_id long, text string")
    one = find_passages(docs, items, keep=("doc_id",)).select("row.doc_id", "hits", "item_ids")
    many = find_passages(docs, items, keep=("doc_id",), block_chars=200)
    many = many.select("row.doc_id", "hits", "item_ids")
    assert sorted(one.collect()) == sorted(many.collect())


def test_odd_rows(spark, odd, empty):
    items = spark.createDataFrame(
        [(1, None), (2, ""), (None, "one"), (3, "same text twice"), (3, "same text twice"),
         (4, "word " * 50)],
        "item_id long, text string",
    )
    found = find_passages(odd, items)
    hits = {(r.row.doc_id, r.row.text): (r.n_words, len(r.hits), r.item_ids) for r in found.collect()}
    assert hits[(1, None)] == (0, 0, []) and hits[(4, "one")] == (1, 0, [])
    assert hits[(6, "same text twice")] == (3, 3, ["3"])
    assert hits[(8, "word " * 30_000)] == (30_000, 30_000, ["4"])
    assert found.count() == odd.count()
    kept = decontaminate(odd, items)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 4
    assert find_passages(empty, items).count() == 0
    none = find_passages(odd, items.where(F.lit(False)))
    assert none.where(F.size("hits") > 0).count() == 0 and none.count() == odd.count()
