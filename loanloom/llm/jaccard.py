"""N-gram Jaccard join over count vectors.

A document is the set of its word shingles.  Texts with the same set collapse to one class
before anything else.  The shingles of a class are hashed into groups; the counts of the groups
are a point, and the sum of the smaller counts of two points, coordinate by coordinate, is at
least the number of shingles they share.  That bounds a pair of points from their counts alone,
and a pair of R-tree boxes from the largest counts in them.  Boxes hold a fixed number of groups;
a pair that is left meets once more on points with groups in proportion to the set.

A link at similarity t also needs a common shingle among the first ``n - ceil(t n) + 1`` of each
side in any fixed order.  Classes with one such shingle are a page, and only points of a page
are searched together: the page is one more dimension of the R-tree, which is packed for many
pages at once.  Shingles that many documents share come last in the order, and pages with many
points are cut into tiles that meet pairwise.

Links, not pairs, are what counts: first every page joins its members to its least class.  What
these links connect is one component, and a page whose members are in one component by then
needs no more work; the R-trees look for pairs of different components only.  So a group of
thousands of like texts costs its size, not its square, and no link between two components is
lost.  Every pair that passes the bound is verified on the sets themselves.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .texts import bit_table, connected, gather, in_table, written

SHINGLE = 4
#: Two sets link when PARTS[0] * shared >= PARTS[1] * union: similarity 0.85.
PARTS = (100, 85)
#: Groups that shingles are hashed into, at least and at most for points of pairs; a count of
#: FULL stands for that many or more.
GROUPS, MOST_GROUPS, FULL = 64, 1 << 16, 255
#: Points in a tile, in a box of the R-tree, and in a tree of several pages.
TILE, NODE, TREE = 2048, 16, 1 << 16
#: Pages that a point names, the least of those it is in, so that a pair is given by one of them.
NAMED = 16
#: Low bits of a class key that hold the size of its set (or the largest number they can).
SIZE_BITS = 20

_LOWER = bytes(range(256)).lower()
_hash = xxhash.xxh3_64_intdigest


def shingles(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of the shingles; fewer words than a shingle has are one."""
    words = text.encode().translate(_LOWER).split() if text else []
    if not words:
        return np.empty(0, np.int64)
    runs = [b" ".join(words[k : k + size]) for k in range(max(1, len(words) - size + 1))]
    return np.unique(np.fromiter(map(_hash, runs), np.uint64, len(runs)).view(np.int64))


def _prefix(n: int, parts) -> int:
    """Of a set's shingles in the fixed order, one of the first so many is in any linked set."""
    return n - -(-parts[1] * n // parts[0]) + 1


def _point(own: np.ndarray) -> bytes:
    """Counts of the shingles by hash, in as many groups as there are shingles or more."""
    groups = min(MOST_GROUPS, max(GROUPS, 1 << max(0, len(own) - 1).bit_length()))
    counts = np.bincount(own & (groups - 1), minlength=groups)
    return np.minimum(counts, FULL).astype(np.uint8).tobytes()


def _fold(point: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """The same counts in fewer groups."""
    if len(point) == groups:
        return point
    folded = point.reshape(-1, groups).sum(axis=0, dtype=np.int64)
    folded[(point == FULL).reshape(-1, groups).any(axis=0)] = FULL
    return np.minimum(folded, FULL).astype(np.uint8)


def _digest(own: np.ndarray) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(own.tobytes())
    return tuple(int.from_bytes(digest[k : k + 8], "big", signed=True) for k in (0, 8))


def _key(first: int, n: int) -> int:
    """A class key: part of the digest and the size.  Keys only choose what is looked at."""
    most = (1 << SIZE_BITS) - 1
    return first & ~most | min(n, most)


def _emit_sets(batches, size):
    for batch in batches:
        rows = []
        for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            own = shingles(text, size)
            a, b = _digest(own)
            point = _point(own)
            coarse = _fold(np.frombuffer(point, np.uint8)).tobytes()
            rows.append((doc, len(own), a, b, _key(a, len(own)), coarse, point))
        if rows:
            yield list(zip(*rows, strict=True))


def _emit_prefixes(batches, size, parts, shared=None):
    """The shingles of each class that a linked class may share: first those that are not in
    the table of shared ones, then the others, by hash."""
    for batch in batches:
        keys, classes = [], []
        for text in batch.column(0).to_pylist():
            own = shingles(text, size)
            n = len(own)
            if n == 0 or parts[1] * (n + 1) > parts[0] * n:
                continue  # a set with one shingle more would not link any more
            if shared is not None:
                last = in_table(shared.value, own)
                own = np.concatenate([own[~last], own[last]])
            keys.append(own[: _prefix(n, parts)])
            classes.append(np.full(len(keys[-1]), _key(_digest(np.sort(own))[0], n)))
        if keys:
            yield [np.concatenate(keys), np.concatenate(classes)]


class RTree:
    """Packed boxes over points in order of page and size: the largest count in each group, and
    the ranges of pages and sizes.  Level 0 is the points."""

    def __init__(self, pages: np.ndarray, points: np.ndarray, sizes: np.ndarray):
        self.order = np.lexsort((points.argmax(axis=1), sizes, pages))
        box = [x[self.order] for x in (points, pages, pages, sizes, sizes)]
        self.levels = [box]
        reduce = (np.maximum, np.minimum, np.maximum, np.minimum, np.maximum)
        while len(box[0]) > NODE:
            at = np.arange(0, len(box[0]), NODE)
            box = [f.reduceat(x, at) for f, x in zip(reduce, box, strict=True)]
            self.levels.append(box)

    def pairs(self, parts=PARTS) -> tuple[np.ndarray, np.ndarray]:
        """Places of two points of one page that may link, each pair once."""
        a = b = np.zeros(1, np.int64)
        for level in range(len(self.levels), -1, -1):
            found = []
            for at in range(0, len(a), 2048):
                i, j = a[at : at + 2048], b[at : at + 2048]
                if level < len(self.levels):
                    i, j = self._near(level, i, j, parts)
                if level:
                    i, j = self._below(level - 1, i, j)
                found.append((i, j))
            a, b = (np.concatenate(x) for x in zip(*found, strict=True))
        return self.order[a], self.order[b]

    def _below(self, level: int, i: np.ndarray, j: np.ndarray):
        most = len(self.levels[level][0])
        steps = np.arange(NODE)
        i = (i[:, None, None] * NODE + steps[:, None] + 0 * steps).reshape(-1)
        j = (j[:, None, None] * NODE + 0 * steps[:, None] + steps).reshape(-1)
        low = level == 0
        good = (i < most) & (j < most) & ((i < j) if low else (i <= j))
        i, j = i[good], j[good]
        _, first, last, _, _ = self.levels[level]
        good = (first[i] <= last[j]) & (first[j] <= last[i])
        return i[good], j[good]

    def _near(self, level: int, i: np.ndarray, j: np.ndarray, parts):
        top, _, _, low, high = self.levels[level]
        good = (parts[0] * high[i] >= parts[1] * low[j]) & (
            parts[0] * high[j] >= parts[1] * low[i]
        )
        i, j = i[good], j[good]
        keep = np.zeros(len(i), bool)
        for at in range(0, len(i), 1 << 14):
            u, v = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
            keep[at : at + (1 << 14)] = _enough(top[u], top[v], low[u] + low[v], parts)
        return i[keep], j[keep]


def _enough(left: np.ndarray, right: np.ndarray, sizes: np.ndarray, parts) -> np.ndarray:
    """Whether summed coordinate minima reach what sets of the (summed) sizes have to share."""
    least = np.minimum(left, right)
    shared = least.sum(axis=1, dtype=np.int64)
    needed = -(-parts[1] * sizes // (parts[0] + parts[1]))
    return (shared >= needed) | (least == FULL).any(axis=1)


def _points(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, GROUPS)


def _by_pages(batches, work):
    """``work`` on tables of whole pages; rows come sorted by page."""
    held: list = []
    for batch in batches:
        held.append(batch)
        if sum(b.num_rows for b in held) >= TREE:
            whole, held = _cut(held)
            if whole is not None:
                yield work(whole)
    if held:
        yield work(_cut(held, last=True)[0])


def _pages(table) -> tuple[np.ndarray, np.ndarray]:
    """The columns that make a page, and a number for the page of each row."""
    pages = np.stack([table[n].to_numpy() for n in ("h", "first", "second")])
    change = (pages[:, 1:] != pages[:, :-1]).any(axis=0)
    return pages, np.concatenate([[0], change.cumsum()])


def _star_pairs(table, parts) -> list:
    """Every point of a page with the one nearest to the mean of the page."""
    _, page = _pages(table)
    ids, sizes, points = table["id"].to_numpy(), table["n"].to_numpy(), _points(table["point"])
    starts = np.flatnonzero(np.concatenate([[True], page[1:] != page[:-1]]))
    counts = np.bincount(page)
    mean = np.add.reduceat(points.astype(np.float32), starts) / counts[:, None]
    away = np.abs(points - mean[page]).sum(axis=1)
    first = np.lexsort((ids, away, page))[starts]  # sorting leaves the pages where they are
    center = first[page]
    good = (ids != ids[center]) & (parts[0] * np.minimum(sizes, sizes[center])
                                   >= parts[1] * np.maximum(sizes, sizes[center]))
    i = np.flatnonzero(good)
    j = center[i]
    near = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 14):
        u, v = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
        near[at : at + (1 << 14)] = _enough(points[u], points[v], sizes[u] + sizes[v], parts)
    return _distinct(ids[i[near]], ids[j[near]])


def _distinct(a: np.ndarray, b: np.ndarray) -> list:
    pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
    return [pairs[0], pairs[1]]


def _cut(held: list, last: bool = False):
    """All finished pages, and the rows of the one that may go on in the next batch."""
    import pyarrow as pa

    table = pa.Table.from_batches(held).combine_chunks()
    if last:
        return table, []
    pages = [table[n].to_numpy() for n in ("h", "first", "second")]
    change = np.zeros(table.num_rows, bool)
    for x in pages:
        change[1:] |= x[1:] != x[:-1]
    at = np.flatnonzero(change)
    if not len(at):
        return None, table.to_batches()
    return table.slice(0, at[-1]), table.slice(at[-1]).to_batches()


def _page_pairs(table, parts) -> list:
    pages, page = _pages(table)
    ids, tile = table["id"].to_numpy(), table["tile"].to_numpy()
    component = table["component"].to_numpy()
    tree = RTree(page, _points(table["point"]), table["n"].to_numpy())
    i, j = tree.pairs(parts)
    across = (pages[1][i] == pages[2][i]) | (tile[i] != tile[j])
    good = across & (component[i] != component[j])
    i, j = i[good], j[good]
    lists = table["named"].combine_chunks()
    named = np.full((len(ids), NAMED), np.iinfo(np.int64).max)
    named[np.arange(NAMED) < lists.value_lengths().to_numpy()[:, None]] = lists.flatten().to_numpy()
    first = ~_met_before(named, i, j, pages[0][i])
    return _distinct(ids[i[first]], ids[j[first]])


def _met_before(named: np.ndarray, i: np.ndarray, j: np.ndarray, page: np.ndarray) -> np.ndarray:
    """Whether two points are named to meet on a lesser page as well; the least one they have in
    common never says so."""
    out = np.zeros(len(i), bool)
    for at in range(0, len(i), 1 << 13):
        part = slice(at, at + (1 << 13))
        left, right = named[i[part]], named[j[part]]
        lesser = left < page[part, None]
        out[part] = ((left[:, :, None] == right[:, None, :]) & lesser[:, :, None]).any(axis=(1, 2))
    return out


def _keep_near(batches, parts):
    """Pairs that pass the bound in all groups of the smaller point."""
    for batch in batches:
        keep = []
        a, b, sizes, left, right = (c.to_pylist() for c in batch.columns)
        for n, x, y in zip(sizes, left, right, strict=True):
            x, y = (np.frombuffer(p, np.uint8) for p in (x, y))
            groups = min(len(x), len(y))
            x, y = _fold(x, groups), _fold(y, groups)
            keep.append(bool(_enough(x[None], y[None], np.array([n]), parts)[0]))
        at = np.flatnonzero(keep)
        yield [batch.column(0).take(at), batch.column(1).take(at)]


def _verified(pairs: DataFrame, texts: DataFrame, points: DataFrame, size: int, parts) -> DataFrame:
    """The ``pairs(a, b)`` of ids whose sets link.  Texts stay where they are: each task reads a
    bounded table of the ids wanted, and only sets of (about) those are shuffled."""
    end = lambda id_, n, point: points.select(
        F.col("id").alias(id_), F.col("n").alias(n), F.col("fine").alias(point)
    )
    both = pairs.distinct().join(end("a", "n_a", "p_a"), "a").join(end("b", "n_b", "p_b"), "b")
    both = both.select("a", "b", (F.col("n_a") + F.col("n_b")).alias("n"), "p_a", "p_b")
    near = gather(both, "a bigint, b bigint", lambda: partial(_keep_near, parts=parts))
    pairs = written(near.distinct(), "pairs")
    filled = bit_table(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    if filled is None:
        return pairs
    shared = pairs.sparkSession.sparkContext.broadcast(filled)

    def sets(batches):
        for batch in batches:
            at = np.flatnonzero(
                in_table(shared.value, batch.column(0).to_numpy(zero_copy_only=False))
            )
            part = batch.take(at)
            yield [part.column(0), [shingles(t, size) for t in part.column(1).to_pylist()]]

    known = written(gather(texts, "id bigint, own array<bigint>", lambda: sets), "sets")
    both = pairs.join(known.select(F.col("id").alias("b"), F.col("own").alias("right")), "b").join(
        known.select(F.col("id").alias("a"), F.col("own").alias("left")), "a"
    )
    shared_n = F.size(F.array_intersect("left", "right"))
    union = F.size("left") + F.size("right") - shared_n
    return both.where(parts[0] * shared_n >= parts[1] * union).select("a", "b").distinct()


def jaccard_groups(
    docs: DataFrame, size: int = SHINGLE, parts: tuple[int, int] = PARTS
) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``class_id`` (least id with the same set) and ``component_id``
    (least id reachable by links), one row per input row.

    Null, empty and blank texts have no shingles and are linked with nothing.  Rows without an
    id take no part and get null classes and components.  Texts under one id are one document
    for links, so their components are joined.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("id"),
                        F.col("text").cast("string").alias("text"))
    fields = "id bigint, n bigint, a bigint, b bigint, key bigint, point binary, fine binary"
    sets = written(gather(texts, fields, lambda: partial(_emit_sets, size=size)), "shingles")
    used = sets.where("id IS NOT NULL AND n > 0")
    least = used.groupBy("a", "b").agg(F.min("id").alias("class_id"))
    member = written(
        used.join(least, ["a", "b"])
        .select("id", "class_id", "key", "n", "point", "fine")
        .dropDuplicates(["id", "class_id", "key"]),
        "members",
    )
    classes = member.where("id = class_id").select("key", "id", "n", "point", "fine")
    links = _links(texts.where("id IS NOT NULL"), classes, size, parts)
    # Ids with several texts hold their classes together.
    several = member.groupBy("id").agg(F.min("class_id").alias("low"),
                                       F.max("class_id").alias("high"))
    several = member.join(several.where("low <> high"), "id").select(
        F.col("class_id").alias("a"), F.col("id").alias("b")
    ).unionByName(member.join(several.where("low <> high"), "id").select(
        F.col("class_id").alias("a"), F.col("low").alias("b")
    ))
    groups = connected(links.unionByName(several), "groups").select(
        F.col("id").alias("class_id"), F.col("component").alias("component_id")
    )
    of_class = sets.drop("point", "fine").join(least, ["a", "b"], "left").withColumn(
        "class_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("id"))
    )
    own = F.when(F.col("n") > 0, F.coalesce("component_id", "class_id")).otherwise(F.col("id"))
    return of_class.join(groups, "class_id", "left").select(
        F.col("id").alias("doc_id"),
        F.col("n").alias("n_shingles"),
        F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"),
        F.when(F.col("id").isNotNull(), own).alias("component_id"),
    )


def _links(texts: DataFrame, classes: DataFrame, size: int, parts) -> DataFrame:
    """Verified links between classes that connect whatever links connect."""
    spark = texts.sparkSession
    fields = "h bigint, key bigint"

    def prefixes(shared=None):
        make = lambda: partial(_emit_prefixes, size=size, parts=parts, shared=shared)
        return gather(texts.select("text"), fields, make)

    def several(found):
        pages = found.groupBy("h").agg(F.min("key").alias("least"), F.max("key").alias("most"))
        return pages.where("least <> most").select("h")

    filled = bit_table(written(several(prefixes()), "seen"))
    if filled is None:
        return spark.createDataFrame([], "a bigint, b bigint")
    found = written(prefixes(spark.sparkContext.broadcast(filled)), "prefixes")
    entries = written(found.join(several(found), "h").distinct(), "pages")

    known = classes.select("key", "id", "n", "point", F.col("id").alias("component"))
    make = lambda: partial(_by_pages, work=partial(_star_pairs, parts=parts))
    stars = gather(_open_pages(entries, known, across=False), "a bigint, b bigint", make)
    links = written(_verified(stars, texts, classes, size, parts), "links")

    groups = connected(links, "stars")
    known = written(
        known.drop("component").join(groups, "id", "left").withColumn(
            "component", F.coalesce("component", "id")
        ),
        "classes",
    )
    make = lambda: partial(_by_pages, work=partial(_page_pairs, parts=parts))
    pairs = gather(_open_pages(entries, known, across=True), "a bigint, b bigint", make)
    return links.unionByName(_verified(pairs, texts, classes, size, parts))


def _open_pages(entries: DataFrame, known: DataFrame, across: bool) -> DataFrame:
    """The points of pages with several components, sorted by page; a large page is cut into
    tiles, which also meet each other with ``across``.

    Documents that share one shingle mostly share many, so of the pages with the same members
    (by 128 bits of their ids and their number) only one is opened: the others hold no other pair.
    """
    marked = entries.join(known, "key")
    members = [F.count("*").alias("count"), F.bit_xor(F.xxhash64("id")).alias("one"),
               F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("two")]
    pages = (
        marked.groupBy("h")
        .agg(F.min("component").alias("low"), F.max("component").alias("high"), *members)
        .where("low <> high")
        .groupBy("count", "one", "two")
        .agg(F.min("h").alias("h"))
        .select("h", F.ceil(F.col("count") / TILE).cast("int").alias("tiles"))
    )
    tiled = marked.join(pages, "h").withColumn(
        "tile", F.pmod(F.xxhash64("id"), F.col("tiles")).cast("int")
    )
    every, named = F.array("tile"), []
    if across:
        every, named = F.sequence(F.lit(0), F.col("tiles") - 1), ["named"]
        tiled = written(tiled, "open")
        # At most as many pages as the document has shingles.
        least = F.slice(F.array_sort(F.collect_set("h")), 1, NAMED)
        tiled = tiled.join(tiled.groupBy("id").agg(least.alias("named")), "id")
    page = ["h", "first", "second"]
    return tiled.withColumn("other", F.explode(every)).select(
        "h", F.least("tile", "other").alias("first"), F.greatest("tile", "other").alias("second"),
        "tile", "id", "n", "component", *named, "point",
    ).repartition(*page).sortWithinPartitions(*page)


def keep_one(docs: DataFrame, size: int = SHINGLE, parts: tuple[int, int] = PARTS) -> DataFrame:
    """The documents, columns unchanged, with the least id of each component.

    Of several rows with that id the one with the least text stays.  Rows without shingles or
    without an id all stay.
    """
    groups = jaccard_groups(docs, size, parts).where("doc_id IS NOT NULL")
    least = F.min(F.when(F.col("n_shingles") > 0, F.col("component_id"))) == F.col("doc_id")
    by_id = written(
        groups.groupBy("doc_id").agg(
            F.coalesce(least, F.lit(True)).alias("least"),
            (F.count("*") > 1).alias("several"),
        ).where("several OR NOT least"),
        "kept",
    )
    left = docs.join(by_id, "doc_id", "left_anti").select(*docs.columns)
    if by_id.where("several").isEmpty():
        return left
    again = docs.join(by_id.where("several AND least"), "doc_id", "left_semi")
    blank = ~F.coalesce("text", F.lit("")).rlike("[^ \\t\\n\\x0B\\f\\r]")
    rest = again.where(~blank).groupBy("doc_id").agg(
        F.min_by(F.struct(*docs.columns), F.struct("text", F.xxhash64(*docs.columns))).alias("row")
    )
    empty = docs.where(blank).join(by_id, "doc_id", "left_semi")
    return left.unionByName(rest.select("row.*")).unionByName(empty)
