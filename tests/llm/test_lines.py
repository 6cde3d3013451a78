from __future__ import annotations

import hashlib
import random
import time

import pytest
from pyspark.sql import functions as F

from loanloom.llm import lines as module
from loanloom.llm import queries
from loanloom.llm.lines import (
    _alike,
    _letters,
    _same_start,
    _segment,
    dedup_lines,
    keep_lines,
    near_lines,
    within_edits,
)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, line, edits, alphabet):
    out = list(line)
    for _ in range(edits):
        at = rng.randrange(len(out) + 1)
        kind = rng.random()
        if kind < 0.34:
            out.insert(at, rng.choice(alphabet))
        elif out and kind < 0.67:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(alphabet)
    return "".join(out)


def brute(docs, edits=2, least=20):
    """Every line against every line of an earlier first occurrence."""
    first = {}
    for doc, text in sorted(docs):
        for at, line in enumerate((text or "").split("\n")):
            if len(line) >= least and line not in first:
                first[line] = (doc, at)
    order = sorted(first, key=first.get)
    near = {
        y for k, y in enumerate(order)
        if any(abs(len(x) - len(y)) <= edits and distance(x, y) <= edits for x in order[:k])
    }
    out = {}
    for doc, text in docs:
        own = text.split("\n") if text else []
        kept = [x for at, x in enumerate(own)
                if len(x) < least or (first[x] == (doc, at) and x not in near)]
        out[doc] = (len(own), len(own) - len(kept),
                    hashlib.sha256("\n".join(kept).encode()).hexdigest())
    return out


def random_docs(seed, count=60):
    rng = random.Random(seed)
    alphabet = "ab é日"
    say = lambda n: "".join(rng.choice(alphabet) for _ in range(n))
    known, docs = [], []
    for k in range(count):
        own = []
        for _ in range(rng.randint(0, 6)):
            if known and rng.random() < 0.5:
                own.append(edited(rng, rng.choice(known), rng.randint(0, 4), alphabet))
            else:
                own.append(say(rng.choice([0, 5, 19, 20, 21, 22, 24, 40])))
        known += [x for x in own if x]
        docs.append((k, "\n".join(own)))
    rng.shuffle(docs)
    return docs


@pytest.mark.parametrize("crowded", [64, 1])
def test_query_equals_brute_force(spark, folder, monkeypatch, crowded):
    monkeypatch.setattr(module, "CROWDED", crowded)
    docs = random_docs(crowded)
    path = folder(documents=spark.createDataFrame(docs, "doc_id long, text string").repartition(5))
    rows = queries.op2_lines(spark, path).collect()
    assert len(rows) == len(docs)
    found = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in rows}
    expected = brute(docs)
    assert found == expected and sum(e[1] for e in expected.values()) > 20


@pytest.mark.parametrize("edits", [1, 2, 3, 5])
def test_banded_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(400):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(edits + 1, 30)))
        b = edited(rng, a, rng.randint(0, edits + 2), "abé")
        a, b = sorted((a, b), key=len)
        if len(b) - len(a) <= edits and len(a) >= edits:
            pairs.append((a, b, distance(a, b) <= edits))
    df = spark.createDataFrame(pairs, "a string, b string, expected boolean")
    near = within_edits(F.split("a", ""), F.split("b", ""), edits)
    assert df.where(near != F.col("expected")).count() == 0
    assert {p[2] for p in pairs} == {True, False}


@pytest.mark.parametrize("edits", [0, 1, 2, 4])
def test_segments_cover_the_line(spark, edits):
    df = spark.range(edits + 1, 40).select(F.col("id").cast("int").alias("n"))
    parts = [_segment(F.col("n"), i, edits) for i in range(edits + 1)]
    flat = [c.alias(f"c{k}") for k, c in enumerate(x for p in parts for x in p)]
    for row in df.select("n", *flat).collect():
        at = 0
        for i in range(edits + 1):
            start, size = row[1 + 2 * i], row[2 + 2 * i]
            assert start == at and size >= 1
            at += size
        assert at == row.n


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_no_near_pair_is_missed(spark, edits, monkeypatch):
    rng = random.Random(9)
    stem = "".join(rng.choice("abcdef") for _ in range(30))
    known = sorted({edited(rng, stem, rng.randint(0, 4), "abcdef") for _ in range(60)})
    df = spark.createDataFrame(list(enumerate(known)), "id long, line string")
    expected = {
        (i, j) for i in range(len(known)) for j in range(i + 1, len(known))
        if distance(known[i], known[j]) <= edits
    }
    for crowded in (64, 0):
        monkeypatch.setattr(module, "CROWDED", crowded)
        assert {(r.x, r.y) for r in near_lines(df, edits).collect()} == expected


def test_near_copies_give_few_candidates(spark, monkeypatch):
    """Lines with four words of one line replaced share segments and are not near: pairs to verify
    stay close to the lines, and no near pair goes."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    stem = [word() for _ in range(60)]
    known = set()
    while len(known) < 400:
        own = list(stem)
        for at in rng.sample(range(60), 4):
            own[at] = word()
        known.add(" ".join(own))
    known = sorted(known)
    known += [known[k][:40] + known[k][42:] for k in range(0, 400, 50)]
    made, real = {}, module.written

    def counted(df, name):
        out = real(df, name)
        made[name] = out.count()
        return out

    monkeypatch.setattr(module, "written", counted)
    df = spark.createDataFrame(list(enumerate(known)), "id long, line string")
    found = {(r.x, r.y) for r in near_lines(df).collect()}
    # Like lines of one length or up to two less; distances are only taken of those.
    assert found == {
        (i, j) for i in range(len(known)) for j in range(i + 1, len(known))
        if sum(a != b for a, b in zip(known[i], known[j])) <= 2 and len(known[i]) == len(known[j])
        or len(known[i]) != len(known[j]) and distance(known[i], known[j]) <= 2
    }
    assert len(found) >= 8 and made["pairs"] <= 10 * len(known)


def test_letters_of_near_lines_are_alike(spark):
    rng = random.Random(8)
    alphabet = "abcdé日\U0001f600"
    rows = []
    for _ in range(300):
        a = "".join(rng.choice(alphabet) for _ in range(rng.randint(3, 30)))
        rows.append((a, edited(rng, a, 2, alphabet)))
    df = spark.createDataFrame(rows, "a string, b string")
    df = df.select("a", "b", _letters(F.col("a")).alias("l"), _letters(F.col("b")).alias("r"))
    assert df.where(~_alike("l", "r", 2)).count() == 0
    other = spark.createDataFrame([("a line of text", "quite another")], "a string, b string")
    other = other.select(_letters(F.col("a")).alias("l"), _letters(F.col("b")).alias("r"))
    assert other.where(_alike("l", "r", 2)).count() == 0


def test_same_start(spark):
    rows = [("", "a", 0), ("a", "b", 0), ("é日x", "é日y", 2), ("abc", "abcde", 3), ("a" * 500 + "b", "a" * 502, 500)]
    df = spark.createDataFrame(rows, "a string, b string, same int")
    assert df.where(_same_start("a", "b", F.length("a")) != F.col("same")).count() == 0


def test_lines_under_one_id_are_told_apart(spark):
    """Two different lines whose first 64 bits of hash agree: only the near one is a pair."""
    line = "the quick brown fox jumps over it"
    rows = [(1, 10, line), (1, 11, "something else altogether, as long"), (2, 20, line + "s")]
    found = near_lines(spark.createDataFrame(rows, "id long, id2 long, line string")).collect()
    assert [(r.x, r.x2, r.y, r.y2) for r in found] == [(1, 10, 2, 20)]


def test_odd_rows(spark, odd, empty):
    rows = dedup_lines(odd).collect()
    assert len(rows) == odd.count()
    found = {(r.row.doc_id, r.row.text): (r.n_lines, r.n_removed) for r in rows}
    assert found[(1, None)] == (0, 0) and found[(2, "")] == (0, 0)
    kept = keep_lines(odd)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert dedup_lines(empty).count() == 0
    long = "the same long line of text"
    rows = [(1, long), (1, long), (2, long + "\nx"), (None, long), (3, f"{long}!\n{long}")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    found = sorted((r.doc_id, r.text, r.n_chars) for r in keep_lines(df).collect())
    assert found == [(1, long, 26), (1, long, 26), (2, "x", 1)]


def test_no_python_runs(spark, odd):
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan


def test_a_text_is_split_once(spark):
    """Taking lines out of a long text grows with its lines, not with their square."""
    text = "\n".join(f"{k} is one of many lines of this text" for k in range(20_000))
    df = spark.createDataFrame([(text, [0, 19_999])], "text string, gone array<int>")
    begun = time.monotonic()
    kept = df.select(module._without("text", "gone").alias("kept")).first().kept
    assert kept == "\n".join(text.split("\n")[1:-1])
    assert time.monotonic() - begun < 15
