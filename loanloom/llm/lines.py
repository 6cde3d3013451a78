"""Line dedup as a segment-partition edit join, in DataFrame functions only.

Two lines within k edits agree exactly on one of k + 1 segments of the shorter one, at a place
that the lengths and the segment's number bound.  So every distinct line is indexed by its k + 1
segments and probes the index with the substrings that could be a segment of a line as long or
up to k shorter.  Of many more, smaller segments k edits leave all but k in place too, so what
meets has to have those in common; what is left is verified by a bit-parallel edit distance over
the band of diagonals that k edits can reach.

Segments that many lines share are refined: within such a key the rest of the line, without the
segment, is again within k edits of the other's rest, so the same partition applies to it.

Lines are grouped by a 128-bit hash with map-side combine before anything else, so a line that
fills a third of the corpus is one line.  Only documents that lose a line are shuffled: the
others are told apart by a table of bits of fixed size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .texts import written

EDITS = 2
#: Shorter lines (in code points) are not compared within edits: a short line says little.  They
#: stay, or go where they repeat exactly if asked.
LEAST_CHARS = 20
#: Small segments of which all but ``edits`` have to be in place before a pair is verified.
SMALL = 16
#: Index entries of a key from which it is refined, and how often at most.  Neither drops a pair.
CROWDED, DEPTH = 16, 1
#: Bits of the table of documents, 64 to a row.
TABLE_BITS = 1 << 22

_LAST = (1 << 63) - 1


def _bind(value: Column, use) -> Column:
    """``use(value)`` with the value computed once."""
    return F.transform(F.array(value), use)[0]


def within_edits(left: Column, right: Column, edits: int) -> Column:
    """Whether two arrays of characters are within ``edits``, the first being no longer.

    Bit b of column j stands for row j - edits + b of the matrix, so a word of 2 * edits + 1 bits
    moves down the band.  ``dist`` follows the diagonal that ends in the last cell.  Along it values
    never fall, so beyond ``edits`` the columns that are left are passed over.  Needs at least
    ``edits`` characters and lengths that differ by no more.
    """
    width = 2 * edits + 1
    ones = (1 << width) - 1
    m, n = F.size(left), F.size(right)
    inverse = lambda x: x.bitwiseXOR(F.lit(ones))

    def column(state: Column, j: Column) -> Column:
        char = F.get(right, j - 1)
        hits = F.lit(0).cast("long")
        for b in range(width):
            same = F.get(left, j - edits + b - 1) == char
            hits = hits.bitwiseOR(F.when(same, F.lit(1 << b).cast("long")).otherwise(F.lit(0)))
        vp, vn = state["vp"], state["vn"]

        def deltas(x: Column) -> Column:
            carried = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseAND(F.lit(ones))
            return _bind(carried.bitwiseOR(x).bitwiseOR(vn), across)

        def across(d: Column) -> Column:
            up = vn.bitwiseOR(inverse(d.bitwiseOR(vp)))
            down = d.bitwiseAND(vp)
            return _bind(F.struct(d.alias("d"), up.alias("up"), down.alias("down")), after)

        def after(s: Column) -> Column:
            below = F.shiftright(s["d"], 1)
            level = F.call_function("shiftright", s["d"], edits - n + m).bitwiseAND(F.lit(1))
            return F.struct(
                s["down"].bitwiseOR(inverse(below.bitwiseOR(s["up"]))).alias("vp"),
                below.bitwiseAND(s["up"]).alias("vn"),
                (state["dist"] + F.when((j > n - m) & (level == 0), 1).otherwise(0)).alias("dist"),
            )

        return F.when(state["dist"] > edits, state).otherwise(_bind(hits, deltas))

    start = F.struct(
        F.lit(ones & ~((1 << edits) - 1)).cast("long").alias("vp"),
        F.lit(0).cast("long").alias("vn"),
        (n - m).alias("dist"),
    )
    return F.aggregate(F.sequence(F.lit(1), n), start, column, lambda s: s["dist"] <= edits)


def _segment(length: Column, i: int, edits: int) -> tuple[Column, Column]:
    """Start (from 0) and size of segment ``i``; later segments take the odd characters."""
    parts = edits + 1
    base = F.floor(length / parts).cast("int")
    plain = parts - length % parts
    return base * i + F.greatest(F.lit(i) - plain, F.lit(0)), base + (F.lit(i) >= plain).cast("int")


def _places(edits: int, probe: bool) -> list[tuple[int, int, int]]:
    """Which segments are indexed or probed: ``i`` of a line ``less`` shorter, moved by ``shift``."""
    out = []
    for less in range(edits + 1 if probe else 1):
        for i in range(edits + 1):
            low = max(-i, less - (edits - i)) if probe else 0
            high = min(i, less + (edits - i)) if probe else 0
            out += [(less, i, shift) for shift in range(low, high + 1)]
    return out


def _entries(lines: DataFrame, edits: int, probe: bool, rest: bool) -> DataFrame:
    """``key`` and ``id`` of index or probe entries; ``path`` is the key so far, ``part`` the text,
    four bytes a character, so that segments are cut out without counting characters.

    With ``rest`` also what is left of the text without the segment, for entries under ``keys``.
    """
    n, i = F.col("n"), range(edits + 1)
    starts = {
        f"start_{k}_{j}": _segment(n - k, j, edits)[0] if j <= edits else n - k
        for k in (i if probe else [0]) for j in range(edits + 2)
    }
    # Columns of their own, so that the code of a row stays short enough to be compiled.
    lines = _coded(lines).withColumn("n", _length("part")).withColumns(starts)

    def entry(less: int, i: int, shift: int) -> Column:
        length, start = n - less, F.col(f"start_{less}_{i}")
        size, at = F.col(f"start_{less}_{i + 1}") - start, start + shift
        key = F.xxhash64("path", length, F.lit(i), F.substring("part", at * 4 + 1, size * 4))
        # Texts too short for as many segments are found by their length alone.
        key = F.when(length > edits, key).otherwise(F.xxhash64("path", length, F.lit(-1)))
        if not rest:
            return key
        left = F.substring("part", F.lit(1), at * 4)
        right = F.substring("part", (at + size) * 4 + 1, (n - at - size) * 4)
        whole = F.when(length > edits, F.concat(left, right)).otherwise(F.col("part"))
        return F.struct(key.alias("key"), whole.alias("rest"))

    found = F.array_distinct(F.array(*[entry(*p) for p in _places(edits, probe)]))
    if rest:
        found = F.filter(found, lambda e: F.array_contains("keys", e["key"]))
        return lines.select("id", "letters", F.explode(found).alias("e")).select(
            "e.key", "id", "letters", "e.rest"
        )
    kept = [c for c in lines.columns if c in ("id", "letters")]
    return lines.select(F.explode(found).alias("key"), *kept)


def _coded(lines: DataFrame) -> DataFrame:
    if "part" in lines.columns:
        return lines
    return lines.withColumn("part", F.encode("line", "UTF-32")).drop("line")


def _length(part: str) -> Column:
    return (F.octet_length(part) / 4).cast("int")


def _letters(text: Column) -> Column:
    """Whether the number of characters is odd, for each of 64 classes of them (``one``) and of two
    that follow each other (``two``).  An edit changes two bits of the first at most, and four of
    the second."""

    def flipped(bits: Column, at: Column) -> Column:
        at = at.bitwiseAND(F.lit(63))
        return bits.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), at))

    def step(state: Column, c: Column) -> Column:
        code = F.ascii(c)
        return F.struct(
            flipped(state["one"], code).alias("one"),
            flipped(state["two"], state["last"] * 31 + code).alias("two"),
            code.bitwiseAND(F.lit(0xFFFF)).alias("last"),
        )

    start = F.struct(
        F.lit(0).cast("long").alias("one"), F.lit(0).cast("long").alias("two"),
        F.lit(0).alias("last"),
    )
    bits = lambda s: F.struct(s["one"].alias("one"), s["two"].alias("two"))
    return F.aggregate(F.split(text, ""), start, step, bits)


def _alike(letters: str, others: str, edits: int) -> Column:
    apart = lambda c: F.bit_count(F.col(f"{letters}.{c}").bitwiseXOR(F.col(f"{others}.{c}")))
    return (apart("one") <= 2 * edits) & (apart("two") <= 4 * edits)


def _met(indexed: DataFrame, probing: DataFrame, edits: int, depth: int = 0) -> DataFrame:
    """Candidate pairs ``x``, ``y`` of ids; both inputs have id, path and line, below a crowded key
    part instead and the ``letters`` of the whole line, which have to be as alike as edits leave
    them."""
    index = _entries(indexed, edits, probe=False, rest=False)
    probe = _entries(probing, edits, probe=True, rest=False)
    some = depth < DEPTH
    if some:
        # What is left of a text that is too short for segments can't be told apart any further.
        size = _length("part") if depth else F.length("line")
        counted = _entries(indexed.where(size > edits), edits, probe=False, rest=False)
        counted = counted.groupBy("key").agg(F.count("*").alias("n"))
        crowded = written(counted.where(F.col("n") > CROWDED).select("key"), "crowded")
        some = not crowded.isEmpty()
    if some:
        # A crowded key stands once without an id and meets the lines that have to be refined:
        # those that probe it, and so all that are indexed under it.
        index = index.join(crowded, "key", "left_anti").unionByName(
            crowded.select("key"), allowMissingColumns=True
        )
    other = [F.col(c).alias(f"other_{c}") for c in probe.columns if c != "key"]
    met = F.col("id") != F.col("other_id")
    if "letters" in index.columns:
        met = met & _alike("letters", "other_letters", edits)
    found = index.join(probe.select("key", *other), "key").where(F.col("id").isNull() | met)
    found = found.select(
        F.least("id", "other_id").alias("x"),
        F.greatest("id", "other_id").alias("y"),
        F.when(F.col("id").isNull(), F.col("key")).alias("crowded"),
    )
    if not some:
        return found.select("x", "y")
    found = written(found.distinct(), "met")
    keys = found.where("crowded IS NOT NULL").groupBy(F.col("x").alias("id"))
    keys = written(keys.agg(F.collect_set("crowded").alias("keys")), "refined")
    table = written(_bits(keys.select(F.xxhash64("id").alias("key"))), "refining")
    again = [indexed] if indexed is probing else [indexed, probing]
    again = [written(_lettered(_those(df, keys, table, "inner")), "crowding") for df in again]
    rests = [
        written(
            _entries(lines, edits, probe=side, rest=True)
            .select("id", F.col("key").alias("path"), F.col("rest").alias("part"), "letters"),
            "rest",
        )
        for lines, side in ((again[0], False), (again[-1], True))
    ]
    pairs = found.where("crowded IS NULL").select("x", "y")
    return pairs.unionByName(_met(*rests, edits, depth + 1))


def _lettered(lines: DataFrame) -> DataFrame:
    if "letters" in lines.columns:
        return lines
    return _coded(lines.withColumn("letters", _letters(F.col("line"))))


def _bits(keys: DataFrame) -> DataFrame:
    """``word`` and ``bits`` of the table in which all ``key`` values are; at most TABLE_BITS / 64
    rows, whatever the number of keys."""
    return keys.groupBy(_word("key").alias("word")).agg(F.bit_or(_bit()).alias("bits"))


def _word(key: str) -> Column:
    return F.pmod(F.shiftright(key, 6), F.lit(TABLE_BITS // 64))


def _bit() -> Column:
    place = F.pmod("key", F.lit(64)).cast("int")
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def _maybe_in(df: DataFrame, key: Column, table: DataFrame) -> DataFrame:
    """``df`` with a column ``maybe``: false only where the key is certainly not in the table."""
    keyed = df.withColumn("key", key)
    hit = F.col("bits").bitwiseAND(_bit())
    # The table has at most TABLE_BITS / 64 rows of two longs.
    return (
        keyed.withColumn("word", _word("key"))
        .join(F.broadcast(table), "word", "left")
        .withColumn("maybe", F.coalesce(hit != 0, F.lit(False)))
        .drop("word", "bits", "key")
    )


def _those(lines: DataFrame, ids: DataFrame, table: DataFrame, how="left_semi") -> DataFrame:
    """The lines with one of the ids, which the table holds: others are not shuffled."""
    some = _maybe_in(lines, F.xxhash64("id"), table).where("maybe")
    return some.select(*lines.columns).join(ids, "id", how)


def _mostly_in_place(short: Column, n: Column, long: Column, edits: int) -> Column:
    """Whether all but ``edits`` of the small segments of ``short``, ``n`` characters long, stand at
    most ``edits`` from their place."""

    def stands(k: Column) -> Column:
        start, end = F.floor(n * k / SMALL).cast("int"), F.floor(n * (k + 1) / SMALL).cast("int")
        near = F.substring(long, F.greatest(start - edits, F.lit(0)) + 1, end - start + 2 * edits)
        return F.instr(near, F.substring(short, start + 1, end - start)) > 0

    segments = F.array(*[F.lit(k) for k in range(SMALL)])
    return F.size(F.filter(segments, stands)) >= SMALL - edits


def _same_start(short: str, long: str, n: Column) -> Column:
    """How many of the first ``n`` characters are the same, by halving."""

    def further(at: Column, step: Column) -> Column:
        equal = F.substring(short, at + 1, step) == F.substring(long, at + 1, step)
        return F.when((at <= n - step) & equal, at + step).otherwise(at)

    return F.aggregate(F.array(*[F.lit(1 << b) for b in range(30, -1, -1)]), F.lit(0), further)


def near_lines(lines: DataFrame, edits: int = EDITS) -> DataFrame:
    """``x``, ``y``: ids of all pairs of different ``lines(id, line)`` within ``edits``.

    Lines may have a second id, ``id2``; then ``x2`` and ``y2`` tell those of one ``id`` apart.
    """
    second = [c for c in lines.columns if c == "id2"]
    parts = lines.select("id", F.lit(0).cast("long").alias("path"), "line")
    pairs = written(_met(parts, parts, edits).distinct(), "pairs")
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("id")).distinct()
    table = written(_bits(wanted.select(F.xxhash64("id").alias("key"))), "wanted")
    texts = _those(lines.select("id", *second, "line"), wanted, table)
    texts = written(texts.withColumn("n", F.length("line")), "candidates")
    side = lambda id_, name: texts.select(
        F.col("id").alias(id_),
        F.col("line").alias(name),
        F.col("n").alias(f"n_{id_}"),
        *[F.col(c).alias(f"{id_}2") for c in second],
    )
    ids = ["x", "y", *[f"{e}2" for e in ("x", "y") if second]]
    both = pairs.join(side("x", "left"), "x").join(side("y", "right"), "y")
    swapped = F.col("n_x") > F.col("n_y")
    short = F.when(swapped, F.col("right")).otherwise(F.col("left"))
    long = F.when(swapped, F.col("left")).otherwise(F.col("right"))
    # A line keeps the ``edits`` characters that the distance needs.
    same = F.least(_same_start("short", "long", F.col("n")), F.col("n") - edits)
    rest = lambda c: F.split(F.substring(c, F.col("same") + 1, F.length(c)), "")
    letters = F.struct(*[rest(c).alias(c) for c in ("short", "long")])
    return (
        both.where(F.abs(F.col("n_x") - F.col("n_y")) <= edits)
        .select(*ids, short.alias("short"), long.alias("long"), F.least("n_x", "n_y").alias("n"))
        .where(_mostly_in_place(F.col("short"), F.col("n"), F.col("long"), edits))
        .withColumn("same", same)
        # Bound, so that the characters are split once a pair and not once a column.
        .where(_bind(letters, lambda s: within_edits(s["short"], s["long"], edits)))
        .select(*ids)
    )


def dedup_lines(
    docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, short: bool = False
) -> DataFrame:
    """Remove lines that occur before, exactly or within ``edits`` insertions, deletions and
    substitutions of code points.

    Before is a smaller ``doc_id`` or, in one document, a lower line; a text counts from its first
    occurrence, and lines are judged on the input.  Lines are what newlines separate; those with
    fewer than ``least_chars`` code points stay, unless with ``short`` they are not blank and occur
    before exactly.  Returns ``row`` (a struct of the input's
    columns), ``n_lines``, ``n_removed`` and ``kept`` (the text that is left, null for null).

    Null and empty texts have no lines.  A null id counts as larger than any other.  Equal rows
    are one document; different texts under one id are told apart by line first, then by hash.
    """
    keyed = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row")).select(
        "row",
        F.coalesce(F.col("row.doc_id").cast("long"), F.lit(_LAST)).alias("doc"),
        F.xxhash64(F.col("row.text").cast("string")).alias("tag"),
        F.col("row.text").cast("string").alias("text"),
    )
    compared = F.length("line") >= max(least_chars, edits + 1)
    lines = (
        keyed.select("doc", "tag", F.posexplode(F.split("text", "\n")).alias("at", "line"))
        .where(compared | F.col("line").rlike("\\S") if short else compared)
        .withColumns({"id": F.xxhash64("line"), "id2": F.xxhash64(F.lit(1), "line")})
    )
    place = F.struct("doc", "at", "tag")
    known = written(
        lines.groupBy("id", "id2").agg(
            F.min(place).alias("first"), F.max(place).alias("last"), F.min("line").alias("line")
        ),
        "lines",
    )
    near = written(near_lines(known.where(compared), edits), "near")
    ids = known.select("id", "id2", "first")
    side = lambda n: ids.select(*[F.col(c).alias(c + n) for c in ids.columns])
    same = lambda a, b: F.col(a) == F.col(b)
    later = near.join(side("_x"), same("x", "id_x") & same("x2", "id2_x")).join(
        side("_y"), same("y", "id_y") & same("y2", "id2_y")
    )
    x_first = F.col("first_x") < F.col("first_y")
    later = later.select(
        F.when(x_first, F.col("id_y")).otherwise(F.col("id_x")).alias("id"),
        F.when(x_first, F.col("id2_y")).otherwise(F.col("id2_x")).alias("id2"),
    ).distinct()
    bad = known.join(later.withColumn("near", F.lit(True)), ["id", "id2"], "left").where(
        F.col("near") | (F.col("first") != F.col("last"))
    )
    gone = (
        lines.drop("line")
        .join(bad.select("id", "id2", "first", "near"), ["id", "id2"])
        .where(F.col("near").isNotNull() | (place != F.col("first")))
        .groupBy("doc", "tag")
        .agg(F.collect_set("at").alias("gone"))
    )
    gone = written(gone, "gone")
    table = written(_bits(gone.select(F.xxhash64("doc", "tag").alias("key"))), "losing")
    told = _maybe_in(keyed, F.xxhash64("doc", "tag"), table)
    breaks = F.octet_length("text") - F.octet_length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = F.when(F.octet_length("text") > 0, breaks + 1).otherwise(0)
    result = lambda df: df.select(
        "row",
        n_lines.cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_removed"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(_without("text", "gone"))
        .alias("kept"),
    )
    losing = told.where("maybe").join(gone, ["doc", "tag"], "left")
    rest = told.where("NOT maybe").withColumn("gone", F.lit(None).cast("array<int>"))
    return result(losing).unionByName(result(rest))


def _without(text: str, gone: str) -> Column:
    def joined(lines: Column) -> Column:
        keep = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
        return F.array_join(F.transform(keep, lambda k: F.get(lines, k)), "\n")

    # Bound, so that the text is split once and not once a line.
    return _bind(F.split(text, "\n"), joined)


def keep_lines(
    docs: DataFrame, edits: int = EDITS, least_chars: int = LEAST_CHARS, short: bool = False
) -> DataFrame:
    """The documents without repeated lines, columns unchanged; ``n_chars``, if there, follows the
    text.  Documents that lose every line go."""
    found = dedup_lines(docs, edits, least_chars, short).where("n_removed < n_lines OR n_lines = 0")
    changed = {"text": F.col("kept")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        own = F.when(F.col("n_removed") > 0, F.length("kept").cast(kind))
        changed["n_chars"] = own.otherwise(F.col("row.n_chars"))
    return found.select(
        *[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns]
    )
