from __future__ import annotations

import random

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from loanloom.llm import queries

duckdb = pytest.importorskip("duckdb")


@pytest.fixture(scope="module")
def tables(spark, folder):
    """Clean documents, and one kind of fault for each stage."""
    rng = random.Random(12)
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(12) for j in range(12)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    docs, labels, kind = [], [], {}

    def add(text, what, label=None):
        doc = len(docs)
        docs.append((doc, text, "en", "src", len(text)))
        kind[doc] = what
        if label:
            labels.append((doc, *label))

    passage = say(40)
    for _ in range(150):
        add(say(60), "clean", (1, 0))
    for _ in range(40):
        add(" ".join(f"{w}###" for w in say(50).split()), "junk", (0, 0))
    for _ in range(30):
        add(say(30) + " vile awful " + say(30), "toxic", (1, 1))
    for k in range(10):
        add(docs[k][1], "copy")
    for k in range(10, 20):
        near = docs[k][1].split()
        near[5] = "changed"
        add(" ".join(near), "near")
    for _ in range(5):
        add(f"{say(20)} {passage[: passage.index(' w', 120)]} {say(20)}", "leak")
    for k in range(5):
        add(f"{say(60)}\n{docs[30 + k][1]}x", "line")
    kinds = "doc_id long, text string, lang string, source string, n_chars long"
    path = folder(
        documents=spark.createDataFrame(docs, kinds).repartition(3),
        labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"),
        benchmark=spark.createDataFrame([(1, passage), (2, None)], "item_id long, text string"),
    )
    return path, docs, kind


def test_faults_go_and_clean_documents_stay(spark, tables):
    path, docs, kind = tables
    found = {r.doc_id: r for r in corpus_pipeline.run(spark, path).collect()}
    kept = lambda what: [d for d, k in kind.items() if k == what and d in found]
    assert not kept("junk") and not kept("copy") and not kept("near") and not kept("leak")
    assert len(kept("clean")) >= 145 and len(kept("toxic")) <= 2
    lines = kept("line")
    assert len(lines) >= 4
    for d in lines:
        assert found[d].text == docs[d][1].split("\n")[0]
        assert found[d].n_chars == len(found[d].text)
    assert all(found[d].rate >= 1 for d in kept("clean"))


def test_stages_keep_the_columns(spark, tables):
    path, _, _ = tables
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, path).schema.simpleString() == docs.schema.simpleString(), name
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality", "lines", "near_duplicates", "decontaminate", "mix"
    ]


def test_all_are_registered():
    names = contract.queries()
    for n in range(1, 11):
        assert sum(q.startswith(f"op{n}_") for q in names) == 1
    assert "pipeline" in names


def test_sql_agrees(spark):
    folder = "/root/testdata/sf0.001"
    engine = duckdb.connect()
    engine.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{folder}/embeddings.parquet'")
    expected = sorted(engine.execute(queries.OP1_SQL).fetchall())
    assert sorted(tuple(r) for r in queries.op1_topk(spark, folder).collect()) == expected


@pytest.mark.parametrize("junk, toxic", [(0, 30), (2, 30), (0, 0)])
def test_mix_keeps_clean_documents_when_junk_is_gone(spark, folder, junk, toxic):
    """Domains that share their words, and next to no junk left to meet a target with."""
    rng = random.Random(junk + toxic)
    words = [f"w{chr(97 + k)}{chr(97 + j)}" for k in range(16) for j in range(16)]
    docs, labels, kind = [], [], {}
    for what, count, label in (("clean", 400, (1, 0)), ("junk", junk, (0, 0)), ("toxic", toxic, (1, 1))):
        for _ in range(count):
            doc = len(docs)
            text = rng.choices(words, k=rng.randint(20, 80))
            # A few clean documents hold a word of the toxic ones.
            if what == "toxic" or rng.random() < 0.05:
                text += ["vile", "awful"] if what == "toxic" else ["vile"]
            docs.append((doc, " ".join(text), "en", "src", 1))
            kind[doc] = what
            if doc % 2:
                labels.append((doc, *label))
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    path = folder(labels=spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    found = {r.doc_id: r for r in corpus_pipeline.mixed(spark, df, path).collect()}
    for d, what in kind.items():
        if what != "toxic":
            assert d in found and found[d].rate >= 1 and found[d].copies >= 1, (what, d)
    assert sum(kind[d] == "toxic" for d in found) <= 2


def test_near_duplicates_from_four_fifths_on(spark):
    """Pairs at, just above and just below a five-word similarity of 0.8."""
    docs, linked = [], set()

    def pair(words, other, near):
        docs.extend([(len(docs), " ".join(words)), (len(docs) + 1, " ".join(other))])
        if near:
            linked.add(len(docs) - 1)

    word = lambda pair, k: f"p{pair}w{k}"
    for n, (more, near) in enumerate([(20, True), (24, True), (25, False)]):
        base = [word(n, k) for k in range(100 + more)]
        pair(base[:100], base, near)
    for n, (size, near) in enumerate([(49, True), (52, True), (48, False)], 3):
        base = [word(n, k) for k in range(size)]
        pair(base, [*base[:24], "changed", *base[25:]], near)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {r.doc_id for r in corpus_pipeline.one_of_each(spark, df, "").collect()}
    assert kept == {d for d, _ in docs} - linked


def test_short_lines_that_repeat_go(spark):
    """Exact repeats of any length but blank ones; short lines within two edits both stay."""
    docs = [
        (1, "Menu\n\n \nHome\nfirst of the longer lines"),
        (2, "Menu\n\n \nHomes\nMenu\nx\nfirst of the longer linez"),
        (3, "x"),
        (4, "\n"),
        (5, "é" * 19 + "\nown words\n" + "é" * 19),
    ]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r.text for r in corpus_pipeline.new_lines(spark, df, "").collect()}
    assert found == {
        1: docs[0][1],
        2: "\n \nHomes\nx",
        4: "\n",
        5: "é" * 19 + "\nown words",
    }


def test_odd_rows_and_clashing_names(spark, odd, empty, folder):
    """Null, empty, repeated and very long texts and a null id pass all stages; without labels
    every document is as good as any, so a threshold above that rejects all of them."""
    labels = spark.createDataFrame(
        [(k, 1, 0) for k in range(9)] + [(20, 0, 0), (None, 1, 1)],
        "doc_id long, quality int, toxic int",
    )
    benchmark = spark.createDataFrame([(1, None), (2, "")], "item_id long, text string")
    clashing = odd.selectExpr("*", "1.5D AS rate", "'x' AS n_tokens", "lang" if "lang" in
                              odd.columns else "'en' AS lang", "length(text) AS n_chars")
    out = corpus_pipeline.run(
        spark, folder(documents=clashing, labels=labels, benchmark=benchmark))
    assert out.columns == [*clashing.columns, "copies"]
    rows = out.collect()
    assert all(r.rate == 1.5 and r.n_tokens == "x" for r in rows)
    assert len([r for r in rows if r.text == "same text twice"]) <= 1
    none = corpus_pipeline.run(
        spark, folder(documents=empty, labels=labels.limit(0), benchmark=benchmark.limit(0)))
    assert none.count() == 0
