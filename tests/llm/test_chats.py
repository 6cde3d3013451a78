from __future__ import annotations

import random
import re

from loanloom.llm import queries
from loanloom.llm.chats import format_chats, link_quotes, normalise, parse

SCHEMA = "conv_id long, turn long, role string, text string"


def test_nested_quotes():
    text = "Yes.\n\nOn Monday Ann wrote:\n> > First\n> >  part\n> Second\n>\n> Third\nDone\n>>x"
    assert parse(text) == (
        "Yes.\n\nDone",
        [(2, "First\npart"), (1, "Second"), (1, "Third"), (2, "x")],
    )
    assert parse(None) == (None, []) and parse("") == ("", [])
    assert parse("a > b\n-> c") == ("a > b\n-> c", [])
    assert parse("> only") == ("", [(1, "only")])


def test_order_and_links(spark, folder):
    rows = [
        (1, 0, "user", "Where is\nthe   file?\n\nAlso: hello"),
        (1, 1, "assistant", "Something else"),
        (1, 2, "user", "> WHERE is the file?\nIn the folder."),
        (1, 3, "assistant", "> something else\nNo."),
        (1, 4, "user", "On 1 May Bo wrote:\n> In the folder.\n>> where is the file?\nThanks"),
        (1, 5, "user", "> never said\nHm"),
        (2, 0, "user", "In the folder."),
        (2, 1, "assistant", "> Where is the file?\nother conversation"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    found = {(r.conv_id, r.turn): r for r in link_quotes(df).collect()}
    assert {k: (r.reply_to, r.opening, r.n_quotes, r.n_linked) for k, r in found.items()} == {
        (1, 0): (None, 0, 0, 0), (1, 1): (None, 1, 0, 0), (1, 2): (0, 0, 1, 1),
        (1, 3): (1, 1, 1, 1), (1, 4): (2, 0, 2, 2), (1, 5): (None, 5, 1, 0),
        (2, 0): (None, 0, 0, 0), (2, 1): (None, 1, 1, 0),
    }
    path = folder(conversations=df)
    chats = {r.conv_id: r for r in queries.op10_chats(spark, path).collect()}
    assert chats[1].chat == (
        "<|user|>\nWhere is\nthe   file?\n\nAlso: hello\n<|user|>\nIn the folder.\n"
        "<|user|>\nThanks\n<|assistant|>\nSomething else\n<|assistant|>\nNo.\n<|user|>\nHm"
    )
    assert (chats[1].n_messages, chats[1].n_quotes, chats[1].n_linked) == (6, 5, 4)


def brute(rows):
    """Links by comparing every quote with every passage of every earlier message."""
    out = {}
    for conv, turn, _, text in rows:
        own = [
            (t, {normalise(p) for p in re.split(r"\n[ \t]*\n", parse(x)[0])}
             | {normalise(parse(x)[0])})
            for c, t, _, x in rows if c == conv
        ]
        best = []
        for level, quote in parse(text)[1]:
            found = [t for t, passages in sorted(own, key=lambda o: o[0])
                     if normalise(quote) in passages]
            if quote.strip() and found and found[0] < turn:
                best.append((level, -found[0]))
        out[conv, turn] = -min(best)[1] if best else None
    opening = {}
    for conv, turn in sorted(out):
        to = out[conv, turn]
        opening[conv, turn] = turn if to is None else opening[conv, to]
    return {k: (out[k], opening[k]) for k in out}


def test_random_discussions(spark):
    rng = random.Random(6)
    rows = []
    for conv in range(12):
        said = []
        for turn in range(rng.randint(1, 40)):
            lines = []
            for _ in range(rng.randint(0, 2)):
                if said:
                    quote = rng.choice(said)
                    lines += [">" * rng.randint(1, 3) + " " + quote, ">"]
            own = f"Word{rng.randint(0, 25)}  {rng.choice('abc')}"
            said.append(rng.choice([own, own.upper().replace("  ", " ")]))
            rows.append((conv, turn, "user", "\n".join([*lines, own])))
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    found = {(r.conv_id, r.turn): (r.reply_to, r.opening) for r in link_quotes(df).collect()}
    assert found == brute(rows)
    for r in format_chats(df, part_turns=8).collect():
        turns = [m.turn for m in r.messages]
        place = {t: k for k, t in enumerate(turns)}
        assert r.n_messages == len(turns) <= 8
        assert all(place.get(m.reply_to, -1) < place[m.turn] for m in r.messages)


def test_odd_rows(spark):
    rows = [
        (None, 1, "user", "a"), (1, None, "user", "> a\nb"), (1, 1, None, None), (1, 2, "user", ""),
        (1, 3, "user", "same"), (1, 3, "user", "same"), (1, 3, "system", "same"),
        (1, 4, "user", "> same\nlong " * 10_000), (1, 5, "user", ">\n> \n"),
    ]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("role", "role").selectExpr(
        "*", "1 AS part", "'x' AS passages", "'y' AS own"
    )
    linked = link_quotes(df).collect()
    assert len(linked) == len(rows) - 1
    chats = format_chats(df).collect()
    assert sum(r.n_messages for r in chats) == len(rows) - 1 and len(chats) == 3
    assert format_chats(df.limit(0)).count() == 0
