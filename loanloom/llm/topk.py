"""Exact top-k search by inner product: dual-tree search over cover trees.

1. Rows go to blocks around anchors (a bounded sample), a crowded anchor's rows to several
   blocks, so that blocks hold like vectors and none grows with the data.
2. Every query searches one block near it; its k-th score there is a floor for what it needs.
3. Blocks and groups of queries are balls.  For a group with centre q and radius r, and a block
   with centre p and radius s, no score exceeds <q,p> + r|p| + s|q| + rs; pairs whose bound is
   under the least floor in the group are dropped.
4. In each remaining pair a cover tree of the queries meets one of the block's rows.  Both
   descend together and node pairs are pruned by the same bound against the worst k-th score in
   the query node.  What is left is scored exactly.
5. Each pair gives at most k rows for a query; the best k of them are the result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .texts import gather, written

K = 5
#: Rows in a block, queries in a group, and anchors at most.
BLOCK, GROUP, ANCHORS = 4096, 512, 1024
#: Balls that are bounded against each other, and query groups that visit a block, in one task.
TOGETHER = 256
LEAF = 64

_EXACT = float(1 << 53)
_LONG = (1 << 63) - 1


@dataclass
class Tree:
    """Points in tree order; node k covers points start..end and has its children's numbers."""

    points: np.ndarray
    ids: np.ndarray
    centers: np.ndarray
    norms: np.ndarray
    radii: np.ndarray
    bounds: np.ndarray
    children: list[np.ndarray]


def cover_tree(points: np.ndarray, ids: np.ndarray, leaf: int = LEAF) -> Tree:
    """Every node's children are balls around its points, half as wide, that cover it."""
    x = points.astype(np.float64)
    order = np.arange(len(x))
    nodes: list[list] = []  # start, end, centre, radius, children
    todo = [(0, len(x), 0, None)]
    while todo:
        start, end, center, parent = todo.pop()
        own = order[start:end]
        away = np.sqrt(((x[own] - x[center]) ** 2).sum(axis=1))
        radius = away.max() if len(away) else 0.0
        number = len(nodes)
        nodes.append([start, end, center, radius, []])
        if parent is not None:
            nodes[parent][4].append(number)
        if end - start <= leaf or radius == 0:
            continue
        groups = [(center, own[away <= radius / 2])]
        left = own[away > radius / 2]
        while len(left):
            near = np.sqrt(((x[left] - x[left[0]]) ** 2).sum(axis=1)) <= radius / 2
            groups.append((left[0], left[near]))
            left = left[~near]
        # Lone points share a child, or spread-out data would make a node for each of them.
        alone = [g for g in groups if len(g[1]) == 1]
        if len(alone) > 1:
            groups = [g for g in groups if len(g[1]) > 1]
            members = np.array([g[0] for g in alone])
            for at in range(0, len(members), leaf):
                groups.append((members[at], members[at : at + leaf]))
        at = start
        for middle, members in groups:
            order[at : at + len(members)] = members
            todo.append((at, at + len(members), middle, number))
            at += len(members)
    centers = x[[n[2] for n in nodes]]
    return Tree(
        points[order],
        ids[order],
        centers,
        np.sqrt((centers**2).sum(axis=1)),
        np.array([n[3] for n in nodes]),
        np.array([n[:2] for n in nodes]),
        [np.array(n[4], int) for n in nodes],
    )


def _scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products as longs; sums beyond a long stop at its ends."""
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    most = float(np.abs(a.astype(float)).max()) * float(np.abs(b.astype(float)).max())
    if most * a.shape[1] < _EXACT:
        return (a.astype(np.float64) @ b.T.astype(np.float64)).astype(np.int64)
    wide = a.astype(object) @ b.T.astype(object)
    return np.clip(wide, -_LONG - 1, _LONG).astype(np.int64)


def _ceiling(dot, norm_a, radius_a, norm_b, radius_b):
    """No inner product across the two balls is larger; room is left for rounding."""
    reach = radius_a * norm_b + radius_b * norm_a + radius_a * radius_b
    return dot + reach + 1 + 1e-9 * (np.abs(dot) + reach + norm_a * norm_b)


class Search:
    """The best k rows so far of each query in a tree."""

    def __init__(self, queries: Tree, floors: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.floors = floors
        n = len(queries.ids)
        self.scores = np.full((n, k), -_LONG - 1)
        self.found = np.full((n, k), _LONG)
        self.filled = np.zeros((n, k), bool)
        self.kth = floors.astype(np.float64)

    def visit(self, rows: Tree) -> None:
        q = self.queries
        stack = [(0, 0, np.inf)]
        while stack:
            a, b, ceiling = stack.pop()
            start, end = q.bounds[a]
            if ceiling < self.kth[start:end].min():
                continue
            split_a = len(q.children[a]) > 0 and (
                not len(rows.children[b]) or q.radii[a] > rows.radii[b]
            )
            if not split_a and not len(rows.children[b]):
                self._score(start, end, rows, *rows.bounds[b])
                continue
            left = q.children[a] if split_a else np.array([a])
            right = np.array([b]) if split_a else rows.children[b]
            dot = q.centers[left] @ rows.centers[right].T
            top = _ceiling(dot, q.norms[left][:, None], q.radii[left][:, None],
                           rows.norms[right][None], rows.radii[right][None])
            # The most promising pair is on top of the stack: it raises the k-th scores early.
            for at in np.argsort(top, axis=None).tolist():
                i, j = divmod(at, len(right))
                stack.append((int(left[i]), int(right[j]), float(top[i, j])))

    def _score(self, start, end, rows, low, high):
        new = _scores(self.queries.points[start:end], rows.points[low:high])
        ids = np.broadcast_to(rows.ids[low:high], new.shape)
        own = ids == self.queries.ids[start:end, None]
        good = ~own & (new >= self.floors[start:end, None])
        scores = np.concatenate([self.scores[start:end], new], axis=1)
        found = np.concatenate([self.found[start:end], ids], axis=1)
        filled = np.concatenate([self.filled[start:end], good], axis=1)
        # ~score sorts like -score and cannot overflow.
        order = np.lexsort((found, ~scores, ~filled), axis=-1)
        order = order[:, : self.k]
        take = lambda values: np.take_along_axis(values, order, axis=1)
        self.scores[start:end], self.found[start:end] = take(scores), take(found)
        self.filled[start:end] = take(filled)
        full = self.filled[start:end, -1]
        last = self.scores[start:end, -1].astype(np.float64)
        self.kth[start:end] = np.where(full, last, self.floors[start:end])

    def rows(self):
        at, place = np.nonzero(self.filled)
        return self.queries.ids[at], self.found[at, place], self.scores[at, place]


def integers(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """``vec_id`` and ``v``, each component floor(scale * x); rows without an id or with a null,
    or non-finite component, or no vector, are left out."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return (
        vectors.select(
            F.col("vec_id").cast("long").alias("vec_id"),
            F.col("embedding").cast("array<double>").alias("x"),
        )
        .where("vec_id IS NOT NULL AND x IS NOT NULL")
        .where(~F.exists("x", bad))
        .select("vec_id", F.transform("x", lambda x: F.floor(x * scale).cast("long")).alias("v"))
    )


def _matrix(column, width: int) -> np.ndarray:
    """Lists as rows; shorter vectors are continued with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width)[None] < sizes[:, None]] = flat
    return out


def _place(points: DataFrame, anchors: np.ndarray, width: int) -> DataFrame:
    def place(batches):
        norms = (anchors**2).sum(axis=1)
        for batch in batches:
            x = _matrix(batch.column(1), width).astype(np.float64)
            yield [batch.column(0), (norms - 2 * x @ anchors.T).argmin(axis=1), batch.column(1)]

    return gather(points, "vec_id bigint, anchor int, v array<bigint>", lambda: place)


def _split(placed: DataFrame, most: int, spark) -> DataFrame:
    """Number blocks: an anchor with more than ``most`` rows has several, by hash of the id."""
    parts = placed.groupBy("anchor").agg(F.ceil(F.count("*") / most).alias("parts")).collect()
    # One entry for each of a bounded number of anchors.
    sizes = F.create_map(*[F.lit(x) for r in parts for x in (r["anchor"], int(r["parts"]))])
    salt = F.pmod(F.xxhash64("vec_id", "v"), sizes[F.col("anchor")]) if parts else F.lit(0)
    return placed.withColumn("block", salt * ANCHORS + F.col("anchor"))


def _ball(key, group: pa.Table, width: int) -> pa.Table:
    x = _matrix(group["v"], width).astype(np.float64)
    center = x.mean(axis=0)
    radius = np.sqrt(((x - center) ** 2).sum(axis=1)).max()
    floor = float(min(group["floor"].to_pylist()))
    return pa.table({"block": [key[0].as_py()], "center": [center], "radius": [radius],
                     "floor": [floor]})


def _balls(points: DataFrame, width: int) -> DataFrame:
    return points.groupBy("block").applyInArrow(
        lambda key, group: _ball(key, group, width),
        "block bigint, center array<double>, radius double, floor double",
    )


def _visit(rows: pa.Table, queries: pa.Table, k: int, width: int):
    """One block of rows and the query groups that come to it."""
    tree = cover_tree(_matrix(rows["v"], width), rows["vec_id"].to_numpy())
    out = []
    groups = queries["q_block"].to_numpy()
    vectors, floors = _matrix(queries["v"], width), queries["floor"].to_numpy()
    for group in np.unique(groups):
        own = np.flatnonzero(groups == group)
        # The tree carries places, so that floors follow its order; ids replace them after.
        mine = cover_tree(vectors[own], own)
        floor = floors[mine.ids]
        mine.ids = queries["vec_id"].to_numpy()[mine.ids]
        search = Search(mine, floor, k)
        search.visit(tree)
        out.append(search.rows())
    return [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[], [], []]


def _chunks(df: DataFrame, name: str, by: str, most: int) -> tuple[DataFrame, int]:
    count = df.select(by).distinct().count()
    parts = max(1, -(-count // most))
    return df.withColumn(name, F.pmod(F.xxhash64(by), F.lit(parts)).cast("int")), parts


def _each(df: DataFrame, name: str, parts: int) -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))


def top_k(points: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """The ``k`` rows of ``points(vec_id, v)`` with the highest inner product for each query.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``; ties go to the smaller vec_id.  Rows
    with the query's own id take no part for it.  Of several queries with one id the one with
    the least vector counts; other rows count as often as they occur.  Shorter vectors are
    continued with zeros.  Every query is compared with every row or pruned by a bound.
    """
    spark = points.sparkSession
    nothing = "query_id bigint, rank int, vec_id bigint, score bigint"
    shape = points.agg(F.max(F.size("v")), F.count("*")).first()
    if not shape[1]:
        return spark.createDataFrame([], nothing)
    width = shape[0]
    wanted = min(ANCHORS, max(1, -(-shape[1] // BLOCK)))
    seeds = points.orderBy(F.xxhash64("vec_id"), "vec_id", "v").limit(wanted).collect()
    anchors = np.zeros((len(seeds), width))
    for row, seed in zip(anchors, seeds, strict=True):
        row[: len(seed["v"])] = seed["v"]
    rows = written(_split(_place(points, anchors, width), BLOCK, spark), "points")
    asked = queries.groupBy("vec_id").agg(F.min("v").alias("v"))
    groups = written(_split(_place(asked, anchors, width), GROUP, spark), "queries")

    # Floors from the first block of the query's own anchor.
    home = _visit_blocks(
        rows.where(F.col("block") < ANCHORS),
        groups.select("vec_id", "v", F.col("anchor").cast("long").alias("block"),
                      F.lit(float(-_LONG)).alias("floor"), F.col("block").alias("q_block")),
        k, width,
    )
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    floors = floors.where(F.col("n") >= k).select(
        F.col("query_id").alias("vec_id"), F.col("kth").cast("double").alias("floor")
    )
    groups = written(
        groups.join(floors, "vec_id", "left").withColumn(
            "floor", F.coalesce("floor", F.lit(float(-_LONG)))
        ),
        "floors",
    )

    pairs = written(_pairs(rows, groups, width), "pairs")
    chunked, parts = _chunks(pairs, "chunk", "q_block", TOGETHER)
    places = chunked.select("block", "chunk").distinct()
    coming = chunked.join(
        groups.select("vec_id", "v", "floor", F.col("block").alias("q_block")), "q_block"
    )
    best = _visit_blocks(rows.join(places, "block"), coming, k, width, ["block", "chunk"])
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "rank", "vec_id", "score"
    )


def _visit_blocks(rows, coming, k, width, keys=("block",)) -> DataFrame:
    def visit(left: pa.Table, right: pa.Table) -> pa.Table:
        found = ([], [], [])
        if left.num_rows and right.num_rows:
            found = _visit(left, right, k, width)
        return pa.table(
            {n: pa.array(c, pa.int64())
             for n, c in zip(("query_id", "vec_id", "score"), found, strict=True)}
        )

    left = rows.select(*keys, "vec_id", "v").groupBy(*keys)
    to = [F.col(key).alias(f"to_{key}") for key in keys]
    right = coming.select(*to, "q_block", "vec_id", "v", "floor").groupBy(
        *[f"to_{key}" for key in keys]
    )
    return left.cogroup(right).applyInArrow(visit, "query_id bigint, vec_id bigint, score bigint")


def _pairs(rows: DataFrame, groups: DataFrame, width: int) -> DataFrame:
    """Query groups and blocks whose balls can hold a score that counts; only balls are met."""
    ball, parts = _chunks(
        _balls(rows.select("block", "v", F.lit(0.0).alias("floor")), width),
        "part", "block", TOGETHER,
    )
    asked, chunks = _chunks(_balls(groups.select("block", "v", "floor"), width),
                            "chunk", "block", TOGETHER)

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        a, b = (_matrix(t["center"], width) for t in (left, right))
        norm_a, norm_b = (np.sqrt((x**2).sum(axis=1)) for x in (a, b))
        top = _ceiling(a @ b.T, norm_a[:, None], left["radius"].to_numpy()[:, None],
                       norm_b[None], right["radius"].to_numpy()[None])
        i, j = np.nonzero(top >= left["floor"].to_numpy()[:, None])
        return pa.table({"q_block": left["block"].to_numpy()[i],
                         "block": right["block"].to_numpy()[j]})

    left = _each(asked, "part", parts).groupBy("part", "chunk")
    right = _each(ball, "chunk", chunks).groupBy("part", "chunk")
    return left.cogroup(right).applyInArrow(meet, "q_block bigint, block bigint")
