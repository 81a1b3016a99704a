"""Exact top-k search by inner product with M-trees.

Vectors are lifted to one common length (one more component takes up what is missing), so the largest inner product is
the smallest distance. A bounded sample of vectors serves as pivots; every vector goes to its nearest pivot, and each
pivot's vectors, in parts of bounded size, become an M-tree of pages. A page has entries with their distance to the
page's routing vector, and inner pages also a covering radius for each child. A query first searches the trees of its
nearest pivot, best page first; with the bound found there, it goes only to trees whose covering ball it reaches.
Entries that the triangle inequality rules out from stored distances are never compared.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import cut, map_arrow, ship

PAGE, FAN = 64, 16
#: Most vectors of a tree, most pivots, and most queries that are searched together.
TREE, MAX_PIVOTS, QUERY_BLOCK = 4096, 512, 4096
#: Scores are 64-bit integers, which hold every inner product of vectors whose squared lengths are below this.
MOST = float(1 << 62)

PAGES = "tree long, page int, leaf boolean, ids binary, vectors binary, apart binary, radii binary, children binary"
FOUND = "query_id long, vec_id long, score long, computed long"


def quantised(embeddings: DataFrame, scale: int = 1024) -> DataFrame:
    """``vec_id`` and ``x``, the components times ``scale`` rounded down, of the vectors that take part.

    A vector takes part if it has an id and components, and none is null, NaN or infinite. Of rows
    with one id, the smallest vector stays.
    """
    double = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
    good &= F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(double, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x")).groupBy("vec_id").agg(F.min("x").alias("x"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims), dtype=np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    places = np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    out[rows, places] = np.asarray(column.flatten())
    return out


def _dots(a: np.ndarray, b: np.ndarray, exact_floats: bool) -> np.ndarray:
    """Integer inner products; in floats where all sums stay below 2**53."""
    return np.rint(a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64) if exact_floats else a @ b.T


class Space:
    """Distances of the lifted vectors: ``most`` is no less than the squared length of any vector."""

    def __init__(self, dims: int, most: int):
        self.dims, self.most, self.exact = dims, most, most < 1 << 52

    def lifted(self, x: np.ndarray) -> np.ndarray:
        """The added component of stored vectors."""
        return np.sqrt(np.maximum(self.most - (x * x).sum(axis=1), 0).astype(np.float64))

    def between(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Distances of stored vectors."""
        dot = _dots(a, b, self.exact) + np.outer(self.lifted(a), self.lifted(b))
        return np.sqrt(np.maximum(2.0 * self.most - 2.0 * dot, 0))

    def to_query(self, scores: np.ndarray, square) -> np.ndarray:
        """Distances from a query (added component 0, squared length ``square``) by inner product."""
        return np.sqrt(np.maximum((self.most + square) * 1.0 - 2.0 * scores, 0))

    @property
    def slack(self) -> float:
        """Above the rounding error of a distance (the square root of a cancelled difference at worst)."""
        return 1e-6 * (1.0 + self.most**0.5)


def build_pages(ids: np.ndarray, x: np.ndarray, space: Space):
    """Pages of one M-tree, the root first: leaf flag, entry ids, vectors, distances to the routing vector, radii, children.

    Groups are split by up to ``FAN`` routing vectors, each the farthest from those before; equal vectors are split by count.
    """
    pages: list[list] = []

    def add(members: np.ndarray, router: np.ndarray | None) -> int:
        number = len(pages)
        pages.append([])
        if len(members) <= PAGE:
            apart = space.between(x[members], router[None])[:, 0] if router is not None else np.zeros(len(members))
            pages[number] = [True, ids[members], x[members], apart, np.zeros(len(members)), np.zeros(len(members), dtype=np.int64)]
            return number
        chosen = [members[0]]
        near = space.between(x[members], x[members[:1]])[:, 0]
        owner = np.zeros(len(members), dtype=np.int64)
        while len(chosen) < min(FAN, -(-len(members) // PAGE) + 1) and near.max() > 0:
            chosen.append(members[int(near.argmax())])
            away = space.between(x[members], x[chosen[-1:]])[:, 0]
            owner = np.where(away < near, len(chosen) - 1, owner)
            near = np.minimum(near, away)
        if len(chosen) == 1:
            owner = np.arange(len(members)) * FAN // len(members)
            chosen = [members[0]] * FAN
        routers = x[np.array(chosen)]
        kept, children, radii = [], [], []
        for i, r in enumerate(routers):
            own = members[owner == i]
            if len(own):
                kept.append(i)
                radii.append(space.between(x[own], r[None]).max())
                children.append(add(own, r))
        apart = space.between(routers[kept], router[None])[:, 0] if router is not None else np.zeros(len(kept))
        pages[number] = [False, np.array(chosen)[kept] * 0, routers[kept], apart, np.array(radii), np.array(children)]
        return number

    add(np.arange(len(ids)), None)
    return pages


def search(pages, query: np.ndarray, own: int, k: int, bound: float, space: Space):
    """Best ``k`` entries of a tree as (score, id), those with equal distance by id, and how many were compared.

    ``bound`` is a distance within which ``k`` entries are known already.
    """
    square = int((query * query).sum())
    best: list[tuple[int, int]] = []
    heap, compared = [(0.0, 0, None)], 0
    as_float = query.astype(np.float64)
    while heap:
        least, number, there = heapq.heappop(heap)
        if least > bound + space.slack:
            break
        leaf, ids, vectors, apart, radii, children, floats = pages[number]
        keep = np.arange(len(apart)) if there is None else np.flatnonzero(np.abs(there - apart) - radii <= bound + space.slack)
        if not len(keep):
            continue
        compared += len(keep)
        scores = np.rint(floats[keep] @ as_float).astype(np.int64) if space.exact else vectors[keep] @ query
        away = space.to_query(scores, square)
        if leaf:
            near = keep[away <= bound + space.slack]
            found = [(-int(s), int(i)) for s, i in zip(scores[away <= bound + space.slack], ids[near]) if i != own]
            if found:
                best = sorted(best + found)[:k]
                if len(best) == k:
                    bound = min(bound, float(space.to_query(np.array([-best[-1][0]]), square)[0]))
        else:
            for i, d in zip(keep, away):
                lower = max(d - radii[i], 0.0)
                if lower <= bound + space.slack:
                    heapq.heappush(heap, (lower, int(children[i]), float(d)))
    return [(-s, i) for s, i in best], compared


def _pivots(vectors: DataFrame, count: int, dims: int) -> np.ndarray:
    """The ``count`` vectors with the smallest hashes of their ids."""
    rows = vectors.orderBy(F.xxhash64("vec_id")).limit(count).select("x").toArrow().column("x").combine_chunks()
    rows = rows.chunk(0) if isinstance(rows, pa.ChunkedArray) else rows
    return np.unique(_matrix(rows, dims), axis=0)



def top_k(embeddings: DataFrame, is_query: F.Column, k: int = 10, scale: int = 1024) -> DataFrame:
    """``query_id``, ``rank`` (from 1), ``vec_id``, ``score`` and ``computed``: the ``k`` best vectors of every query.

    ``embeddings`` has ``vec_id`` and ``embedding``; other columns are not used. ``is_query`` is a condition on
    ``vec_id``. Scores are inner products of the components as :func:`quantised` gives them, the query's own id is no
    candidate, and equal scores go to the smaller id. Fewer than ``k`` candidates are all returned. A shorter vector
    counts as filled up with zeros. ``computed`` is how many vectors were compared with the query. Without vectors or
    queries the result is empty. A vector whose components make a squared length of 2**62 or more, so that scores might
    not fit in 64 bits, is a ValueError.
    """
    spark = embeddings.sparkSession
    ship(spark)
    vectors = cut(quantised(embeddings, scale), "vectors")
    square = F.aggregate("x", F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double"))
    total, dims, most = vectors.agg(F.count(F.lit(1)), F.max(F.size("x")), F.max(square)).first()
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long, computed long")
    bound = int(most) if most < 1 << 52 else int(most * (1 + 1e-9)) + 1  # above the rounding error of the sum
    if bound >= MOST:
        raise ValueError(f"a vector has the squared length {most:.4g} in units of 1/{scale}; scores from {MOST:.4g} on do not fit in 64 bits")
    space = Space(dims, bound)
    pivots = _pivots(vectors, min(max(-(-total // (TREE // 2)), 1), MAX_PIVOTS), dims)

    def assign(batches):
        for batch in batches:
            away = space.between(_matrix(batch.column("x"), dims), pivots)
            nearest = away.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), batch.column("x"), pa.array(nearest), pa.array(away[np.arange(len(away)), nearest])],
                ["vec_id", "x", "pivot", "apart"],
            )

    assigned = cut(map_arrow(vectors, assign, "vec_id long, x array<long>, pivot long, apart double"), "assigned")
    balls = assigned.groupBy("pivot").agg(F.max("apart").alias("radius"), F.ceil(F.count(F.lit(1)) / TREE).alias("parts"))
    balls = balls.orderBy("pivot").collect()  # one row for each of at most MAX_PIVOTS pivots
    known = spark.createDataFrame([(b.pivot, b.parts) for b in balls], "pivot long, parts long")
    rows = assigned.join(F.broadcast(known), "pivot")
    tree = F.col("pivot") * F.lit(1 << 32) + F.pmod(F.xxhash64("vec_id"), F.col("parts"))
    pages = cut(_indexed(rows.select(tree.alias("tree"), "vec_id", "x"), dims, space), "pages")
    asked = vectors.where(is_query)

    def nearest(batches):
        numbers, parts = np.array([b.pivot for b in balls]), np.array([b.parts for b in balls])
        for batch in batches:
            q = _matrix(batch.column("x"), dims)
            scores = _dots(q, pivots[numbers], space.exact)
            away = space.to_query(scores, (q * q).sum(axis=1)[:, None])
            trees = numbers[away.argmin(axis=1)] << 32
            yield pa.RecordBatch.from_arrays(
                [pa.array(trees), batch.column("vec_id"), batch.column("x"), pa.array(np.full(len(q), np.inf))], ["tree", "vec_id", "x", "bound"]
            )

    asks = "tree long, vec_id long, x array<long>, bound double"
    first = cut(_searched(pages, map_arrow(asked, nearest, asks), dims, space, k), "first")
    worst = first.groupBy("query_id").agg(F.min("score").alias("score"), F.count(F.lit(1)).alias("n"))
    bounded = asked.join(worst, asked["vec_id"] == worst["query_id"], "left").select("vec_id", "x", F.when(F.col("n") == k, F.col("score")).alias("score"))

    def reached(batches):
        numbers, radii = np.array([b.pivot for b in balls]), np.array([b.radius for b in balls])
        for batch in batches:
            q = _matrix(batch.column("x"), dims)
            squares = (q * q).sum(axis=1)
            away = space.to_query(_dots(q, pivots[numbers], space.exact), squares[:, None])
            known = np.array([np.nan if s is None else s for s in batch.column("score").to_pylist()], dtype=float)
            bound = np.where(np.isnan(known), np.inf, space.to_query(np.nan_to_num(known), squares))
            there = away - radii <= bound[:, None] + space.slack
            there_rows, balls_there = np.nonzero(there)
            done = numbers[away.argmin(axis=1)]
            trees, takes, bounds = [], [], []
            for row, ball in zip(there_rows, balls_there):
                for part in range(balls[ball].parts):
                    if numbers[ball] != done[row] or part:  # the first search was in part 0
                        trees.append((int(numbers[ball]) << 32) + part)
                        takes.append(row)
                        bounds.append(bound[row])
            for i in range(0, len(trees), 5000):
                taken = pa.array(takes[i : i + 5000], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(trees[i : i + 5000], pa.int64()), batch.column("vec_id").take(taken), batch.column("x").take(taken), pa.array(bounds[i : i + 5000])],
                    ["tree", "vec_id", "x", "bound"],
                )

    further = _searched(pages, map_arrow(bounded, reached, asks), dims, space, k)
    both = cut(first.unionByName(further), "found")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    compared = both.groupBy("query_id").agg(F.sum("computed").alias("computed"))
    return ranked.drop("computed").join(compared, "query_id").select("query_id", "rank", "vec_id", "score", "computed")


def _indexed(rows: DataFrame, dims: int, space: Space) -> DataFrame:
    """The pages of all trees; a tree has about ``TREE`` vectors at most."""

    def build(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        order = np.argsort(table.column("vec_id").to_numpy())
        x = _matrix(table.column("x").chunk(0), dims)[order]
        pages = build_pages(table.column("vec_id").to_numpy()[order], x, space)
        raw = lambda v, kind: np.ascontiguousarray(v, dtype=kind).tobytes()
        number = table.column("tree")[0].as_py()
        return pa.table(
            {
                "tree": pa.array([number] * len(pages), pa.int64()),
                "page": pa.array(range(len(pages)), pa.int32()),
                "leaf": pa.array([p[0] for p in pages]),
                "ids": pa.array([raw(p[1], "<i8") for p in pages], pa.binary()),
                "vectors": pa.array([raw(p[2], "<i8") for p in pages], pa.binary()),
                "apart": pa.array([raw(p[3], "<f8") for p in pages], pa.binary()),
                "radii": pa.array([raw(p[4], "<f8") for p in pages], pa.binary()),
                "children": pa.array([raw(p[5], "<i8") for p in pages], pa.binary()),
            }
        )

    return rows.groupBy("tree").applyInArrow(build, PAGES)


def _searched(pages: DataFrame, asks: DataFrame, dims: int, space: Space, k: int) -> DataFrame:
    """Best entries of each asked tree for each query; queries of a tree are searched in blocks."""
    asks = cut(asks, "asks")
    sizes = asks.groupBy("tree").agg(F.ceil(F.count(F.lit(1)) / QUERY_BLOCK).alias("blocks"))
    stored = pages.join(sizes, "tree").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    blocked = asks.join(sizes, "tree").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks"))).drop("blocks")

    def look(left: pa.Table, right: pa.Table) -> pa.Table:
        found = []
        if left.num_rows and right.num_rows:
            tree = {}
            for row in left.to_pylist():
                vectors = np.frombuffer(row["vectors"], dtype="<i8").reshape(-1, dims)
                tree[row["page"]] = (
                    row["leaf"], np.frombuffer(row["ids"], dtype="<i8"), vectors, np.frombuffer(row["apart"], dtype="<f8"),
                    np.frombuffer(row["radii"], dtype="<f8"), np.frombuffer(row["children"], dtype="<i8"), vectors.astype(np.float64),
                )
            right = right.combine_chunks()
            queries = _matrix(right.column("x").chunk(0), dims)
            for own, query, bound in zip(right.column("vec_id").to_pylist(), queries, right.column("bound").to_pylist()):
                best, compared = search(tree, query, own, k, bound, space)
                found += [(own, i, s, compared if j == 0 else 0) for j, (s, i) in enumerate(best)]
        columns = list(zip(*found)) if found else [[]] * 4
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score", "computed"), columns)})

    return stored.groupBy("tree", "block").cogroup(blocked.groupBy("tree", "block")).applyInArrow(look, FOUND)
