"""Chat formatting by quotation linking.

1. A message is parsed into nested quote levels (leading ``>``) and its own text.  Quoted and own
   passages, paragraphs with blanks and case made even, are hashed to 128 bits.
2. A quoted passage is joined to the first message of the conversation that has it as its own
   text; originals are grouped by hash first, so the join never multiplies.
3. A message replies to the latest earlier message whose text it quotes on the shallowest level
   that links at all; following that to its end gives the message that opened the discussion.
4. A conversation is ordered by opening message and then by turn, so that discussions stay
   together and every reply comes after what it quotes; it is written without the quotes, in
   parts of bounded size.
"""

from __future__ import annotations

import re

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import map_texts, written

#: Turns whose messages share a part of a conversation.
PART_TURNS = 256

_QUOTE = re.compile(r"[ \t]*((?:>[ \t]?)+)(.*)", re.DOTALL)
#: Lines that introduce a quote: "On Monday Ann wrote:" and its like.
_INTRODUCES = re.compile(r"(On|Am|Le|El)\b.*\b(wrote|schrieb|écrit|escribió)\b.*:\s*")


def normalise(passage: str) -> str:
    return " ".join(passage.split()).casefold()


def _hash(passage: str) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(normalise(passage).encode())
    return tuple(int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))


def parse(text: str | None) -> tuple[str | None, list[tuple[int, str]]]:
    """The text without quotes, and the quoted passages as level (from 1) and text.

    A passage is a run of lines of one level without an empty line.  A line that introduces a
    quote goes with it, and an empty line takes the quote's place.
    """
    if not text:
        return text, []
    own: list[str] = []
    quotes: list[tuple[int, list[str]]] = []
    level = 0

    def drop_blank():
        while own and not own[-1].strip():
            own.pop()

    for line in text.split("\n"):
        m = _QUOTE.fullmatch(line)
        if not m:
            if line.strip() or not level:
                own.append(line)
                level = 0
            continue
        if level == 0:
            drop_blank()
            if own and _INTRODUCES.fullmatch(own[-1].strip()):
                own.pop()
                drop_blank()
            if own:
                own.append("")  # what stands before and after a quote are two paragraphs
        depth = m[1].count(">")
        if not m[2].strip():
            level = -depth  # an empty line ends the passage
        elif depth == level:
            quotes[-1][1].append(m[2].strip())
        else:
            quotes.append((depth, [m[2].strip()]))
            level = depth
    return "\n".join(own).strip("\n"), [(d, "\n".join(x)) for d, x in quotes]


def _make_parser():
    def kernel(texts):
        out = [[], [], []]
        for text in texts:
            own, quotes = parse(text)
            out[0].append(own)
            out[1].append([(level, *_hash(q)) for level, q in quotes if q.strip()])
            passages = {_hash(p) for p in re.split(r"\n[ \t]*\n", own or "") if p.strip()}
            if own and own.strip():
                passages.add(_hash(own))
            out[2].append([(0, *p) for p in sorted(passages)])
        return out

    return kernel


def link_quotes(messages: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` (without quotes), ``n_quotes``, ``n_linked``,
    ``reply_to`` (turn) and ``opening`` (turn of the message that opened the discussion).

    One row per distinct ``(conv_id, turn, role, text)``.  Rows without a conversation or turn
    are parsed but neither link nor are linked to.  Null texts stay null, empty ones empty.
    """
    kind = "array<struct<level:int,a:bigint,b:bigint>>"
    chosen = messages.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
    )
    parsed = map_texts(chosen, f"own string, quotes {kind}, passages {kind}", _make_parser)
    parsed = written(
        parsed.select(
            "row.conv_id", "row.turn", "row.role", F.xxhash64("row.text").alias("tag"),
            F.col("own").alias("text"), "quotes", "passages",
        ).dropDuplicates(["conv_id", "turn", "role", "tag"]),
        "messages",
    )
    placed = parsed.where("conv_id IS NOT NULL AND turn IS NOT NULL")
    originals = (
        placed.select("conv_id", "turn", F.explode("passages").alias("p"))
        .groupBy("conv_id", F.col("p.a").alias("a"), F.col("p.b").alias("b"))
        .agg(F.min("turn").alias("original"))
    )
    quoted = placed.select("conv_id", "turn", "role", "tag", F.explode("quotes").alias("q")).select(
        "conv_id", "turn", "role", "tag", "q.level", F.col("q.a").alias("a"), F.col("q.b").alias("b")
    )
    linked = quoted.join(originals, ["conv_id", "a", "b"]).where("original < turn")
    me = ["conv_id", "turn", "role", "tag"]
    replies = linked.groupBy(*me).agg(
        F.count("*").alias("n_linked"),
        F.max(F.struct(-F.col("level"), F.col("original"))).alias("best"),
    ).select(*me, "n_linked", F.col("best.original").alias("reply_to"))
    same = [F.col(f"m.{c}").eqNullSafe(F.col(f"r.{c}")) for c in me]
    out = parsed.alias("m").join(replies.alias("r"), same, "left").select(
        "m.conv_id", "m.turn", "m.role", "m.tag", "m.text",
        F.size("m.quotes").alias("n_quotes"),
        F.coalesce("r.n_linked", F.lit(0)).cast("int").alias("n_linked"),
        "r.reply_to",
    )
    return _with_opening(written(out, "replies")).drop("tag")


def _with_opening(messages: DataFrame) -> DataFrame:
    """Follow replies to their end; each round doubles how far a pointer reaches."""
    links = messages.where("reply_to IS NOT NULL").groupBy("conv_id", "turn").agg(
        F.max("reply_to").alias("to")  # several messages in a turn: the latest they reply to
    )
    while True:
        links = written(links, "openings")
        further = links.select("conv_id", F.col("turn").alias("to"), F.col("to").alias("next"))
        jumped = links.join(further, ["conv_id", "to"], "left")
        if jumped.where("next IS NOT NULL").isEmpty():
            break
        links = jumped.select("conv_id", "turn", F.coalesce("next", "to").alias("to"))
    return messages.join(links, ["conv_id", "turn"], "left").withColumn(
        "opening",
        F.when(F.col("reply_to").isNull(), F.col("turn")).otherwise(F.col("to")),
    ).drop("to")


def format_chats(messages: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """``conv_id``, ``part``, ``n_messages``, ``n_quotes``, ``n_linked``, ``messages`` (turn, role,
    text, reply_to in order) and ``chat``, the formatted text.

    A part holds the messages whose opening message and own turn lie in the same blocks of
    ``part_turns`` turns, so its size does not grow with the conversation; ``part`` orders them.
    A message without a conversation or turn is a chat of its own with a null part.
    """
    linked = link_quotes(messages)
    block = lambda c: F.floor(F.col(c) / part_turns).cast("long")
    placed = F.col("conv_id").isNotNull() & F.col("turn").isNotNull()
    own = F.when(~placed, F.xxhash64("turn", "role", "text"))
    keyed = linked.withColumns(
        {
            "part": F.when(placed, F.struct(block("opening").alias("opening"),
                                            block("turn").alias("turn"))),
            "alone": own,
            "message": F.struct(
                F.struct("opening", "turn", "role", F.xxhash64("text")).alias("place"),
                F.struct("turn", "role", "text", "reply_to").alias("said"),
            ),
        }
    )
    chats = keyed.groupBy("conv_id", "part", "alone").agg(
        F.count("*").alias("n_messages"),
        F.sum("n_quotes").alias("n_quotes"),
        F.sum("n_linked").alias("n_linked"),
        F.transform(F.array_sort(F.collect_list("message")), lambda m: m["said"]).alias("messages"),
    )
    line = lambda m: F.concat(
        F.lit("<|"), F.coalesce(m["role"], F.lit("user")), F.lit("|>\n"),
        F.coalesce(m["text"], F.lit("")),
    )
    return chats.drop("alone").withColumn(
        "chat", F.array_join(F.transform("messages", line), "\n")
    )
