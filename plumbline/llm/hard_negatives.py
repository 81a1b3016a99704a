"""Hard negatives of anchors by slots: the highest-scoring rows of other labels below each positive's score.

An anchor's positives are its best rows of the same label. Their scores, as upper limits of the wanted negatives,
split all scores into disjoint slots. Each task keeps the best rows of each slot and anchor; merged from the lowest
slot up, the slots at and below a limit answer its window, however the windows overlap. Anchors meet all rows in
blocks, once for the positives and once for the negatives.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import cut, ship

#: Components of the rows, and of the anchors, that meet in one block (8 bytes each).
ROW_COMPONENTS, ANCHOR_COMPONENTS = 1 << 19, 1 << 22


def vectors(embeddings: DataFrame, label: Column, scale: int) -> DataFrame:
    """``vec_id``, ``label`` and ``x``, the components times ``scale`` rounded down, of the rows that take part."""
    double = F.col("embedding").cast("array<double>")
    good = F.col("vec_id").isNotNull() & label.isNotNull() & F.col("embedding").isNotNull()
    good &= F.forall(double, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    x = F.transform(double, lambda v: F.floor(v * F.lit(float(scale))).cast("long"))
    return embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), label.cast("long").alias("label"), x.alias("x"))


def _matrix(column, dims: int, floats: bool) -> np.ndarray:
    """Rows of an Arrow list column, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.diff(np.asarray(column.offsets))
    out = np.zeros((len(column), dims), dtype=np.float64 if floats else np.int64)
    rows = np.repeat(np.arange(len(column)), lengths)
    out[rows, np.arange(len(rows)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = np.asarray(column.flatten())
    return out


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by smaller id."""
    places = np.arange(len(scores))
    if len(scores) > k:
        places = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    return places[np.lexsort((ids[places], -scores[places]))][:k]


class Grid:
    """Blocks of rows and blocks of anchors, each pair of which meets in one group."""

    def __init__(self, rows: DataFrame, anchor: Column):
        sized = rows.agg(F.count(F.lit(1)), F.count_if(anchor), F.max(F.size("x")), F.max(F.aggregate("x", F.lit(0).cast("decimal(38,0)"), lambda s, v: (s + v.cast("decimal(19,0)") * v).cast("decimal(38,0)"))))
        n, anchors, dims, most = sized.first()
        if most is not None and most >= 1 << 56:
            raise ValueError("a squared length of 2**56 or more: scores may not fit in 64 bits")
        self.dims, self.floats = max(dims or 0, 1), (most or 0) < 1 << 52
        self.row_blocks = max(1, -(-n * self.dims // ROW_COMPONENTS))
        self.anchor_blocks = max(1, -(-anchors * self.dims // ANCHOR_COMPONENTS))
        number = F.monotonically_increasing_id()  # equal rows, however many, are dealt evenly
        numbered = rows.select(number.alias("row"), "*", F.pmod(F.xxhash64(number), F.lit(self.row_blocks)).alias("r"), anchor.alias("anchor"))
        self.rows = cut(numbered, "rows")
        self.anchors = self.rows.where("anchor").select(
            F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "x", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(self.anchor_blocks)).alias("a")
        )

    def meet(self, anchors: DataFrame, of_anchor, schema: str) -> DataFrame:
        """``of_anchor`` on each anchor, all rows of a block and their scores; it gives columns in the order of ``schema`` after the anchor's."""
        names = [f.split()[0] for f in schema.split(", ")]
        kinds = [pa.int64()] * len(names)
        dims, floats, each = self.dims, self.floats, lambda n, c: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias(c)

        def of_block(rows: pa.Table, left: pa.Table) -> pa.Table:
            out: list[list[np.ndarray]] = [[] for _ in names]
            if rows.num_rows and left.num_rows:
                ids, labels = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
                x, y = (_matrix(t.column("x"), dims, floats) for t in (rows, left))
                fixed = left.drop_columns(["x"]).to_pylist()
                for i in range(0, len(y), 64):
                    scores = np.rint(y[i : i + 64] @ x.T).astype(np.int64) if floats else y[i : i + 64] @ x.T
                    for row, score in zip(fixed[i : i + 64], scores):
                        for column, values in zip(out, of_anchor(row, ids, labels, score)):
                            column.append(values)
            return pa.table({n: pa.array(np.concatenate(c) if c else [], k) for n, c, k in zip(names, out, kinds)})

        ship(self.rows.sparkSession)
        right = self.rows.select("r", each(self.anchor_blocks, "a"), "vec_id", "label", "x")
        left = anchors.select(each(self.row_blocks, "r"), *[F.col(c).alias(c) for c in anchors.columns])  # columns of its own
        return right.groupBy("r", "a").cogroup(left.groupBy("r", "a")).applyInArrow(of_block, schema)


POSITIVES = "anchor long, anchor_id long, positive_id long, score long"
SLOTS = "anchor long, slot long, negative_id long, score long"


def positives(grid: Grid, k: int) -> DataFrame:
    """``anchor``, ``anchor_id``, ``positive_id``, ``score`` and ``place`` of the ``k`` best other rows of each anchor's label."""

    def of_anchor(row, ids, labels, scores):
        same = np.flatnonzero((labels == row["label"]) & (ids != row["anchor_id"]))
        best = same[_best(ids[same], scores[same], k)]
        return np.full(len(best), row["anchor"]), np.full(len(best), row["anchor_id"]), ids[best], scores[best]

    found = grid.meet(grid.anchors, of_anchor, POSITIVES)
    order = W.partitionBy("anchor").orderBy(F.desc("score"), "positive_id")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)


def slot_rows(grid: Grid, found: DataFrame, k: int, least: int) -> DataFrame:
    """``anchor``, ``slot``, ``negative_id`` and ``score``: the ``k`` best rows of other labels in each slot.

    Slot ``i`` ends at the ``i``-th of the anchor's distinct upper limits, highest first, and begins above the next.
    Scores above all limits or below all windows have no slot.
    """
    limits = found.groupBy("anchor").agg(F.sort_array(F.collect_set("score"), asc=False).alias("limits"))
    anchors = grid.anchors.join(limits, "anchor")

    def of_anchor(row, ids, labels, scores):
        limits = np.array(row["limits"], dtype=np.int64)
        inside = (labels != row["label"]) & (scores <= limits[0]) & (100 * scores >= least * limits.min(where=limits >= 0, initial=limits.max()))
        places = np.flatnonzero(inside)
        slots = len(limits) - 1 - np.searchsorted(limits[::-1], scores[places])
        kept, at = [], []
        for slot in np.unique(slots):
            own = places[slots == slot]
            kept.append(own[_best(ids[own], scores[own], k)])
            at.append(np.full(len(kept[-1]), slot))
        kept, at = (np.concatenate(z).astype(np.int64) if z else np.empty(0, dtype=np.int64) for z in (kept, at))
        return np.full(len(kept), row["anchor"]), at, ids[kept], scores[kept]

    rows = grid.meet(anchors, of_anchor, SLOTS)
    order = W.partitionBy("anchor", "slot").orderBy(F.desc("score"), "negative_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).drop("place")


def suffixes(slots: DataFrame, k: int) -> DataFrame:
    """``anchor``, ``slot`` and ``best``: the ``k`` best rows of a slot and all below it, merged from the lowest slot up."""
    entry = F.struct((-F.col("score")).alias("minus"), F.col("negative_id").alias("negative_id"))
    each = slots.groupBy("anchor", "slot").agg(F.array_sort(F.collect_list(entry)).alias("rows"))  # at most k
    listed = each.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("slot", "rows")), asc=False).alias("slots"))

    def merge(done: Column, slot: Column) -> Column:
        below = F.coalesce(F.element_at(done, -1)["best"], F.array().cast("array<struct<minus:bigint,negative_id:bigint>>"))
        best = F.slice(F.array_sort(F.concat(slot["rows"], below)), 1, k)
        return F.concat(done, F.array(F.struct(slot["slot"].alias("slot"), best.alias("best"))))

    nothing = F.array().cast("array<struct<slot:bigint,best:array<struct<minus:bigint,negative_id:bigint>>>>")
    start = F.slice(F.array(F.struct(F.lit(-1).cast("long").alias("slot"), F.array().cast("array<struct<minus:bigint,negative_id:bigint>>").alias("best"))), 1, 1)
    merged = F.aggregate("slots", F.concat(nothing, start), merge)
    return listed.select("anchor", F.explode(merged).alias("s")).select("anchor", "s.slot", "s.best").where("slot >= 0")


def mine(
    embeddings: DataFrame, anchor: Column, label: Column | None = None, scale: int = 256, n_positives: int = 5, n_negatives: int = 5, least: int = 80
) -> DataFrame:
    """``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.

    Anchors are the rows that ``anchor`` marks. A row takes part if it has an id, a label and a vector without null,
    NaN or infinite components; components are ``floor(scale * x)``, shorter vectors are filled up with zeros, and a
    score is the inner product. An anchor's positives are the ``n_positives`` best rows of its label with other ids;
    for each of them the ``n_negatives`` best rows of other labels with
    ``least * positive_score <= 100 * negative_score <= 100 * positive_score`` are returned. Higher scores come first,
    ties by smaller id. Rows that repeat an id take part each, as anchors too. Pairs without such rows, and empty
    tables, give no rows. Columns other than ``vec_id``, ``embedding`` and those of ``anchor`` and ``label`` are not used.
    A squared length of 2**56 or more is an error.
    """
    taking_part = vectors(embeddings, F.col("label") if label is None else label, scale)
    grid = Grid(taking_part, F.coalesce(anchor, F.lit(False)))
    found = cut(positives(grid, n_positives), "positives")
    best = suffixes(cut(slot_rows(grid, found, n_negatives, least), "slots"), n_negatives)
    limit = F.dense_rank().over(W.partitionBy("anchor").orderBy(F.desc("score"))) - 1  # the slot that ends at the score
    windows = found.withColumn("limit", limit.cast("long"))
    # A limit without rows of its own is answered by the next slot below it.
    reached = windows.join(best, "anchor").where("slot >= limit")
    nearest = reached.groupBy("anchor", "anchor_id", "place", "positive_id", "score").agg(F.min_by("best", "slot").alias("best"))
    rows = nearest.select("anchor_id", "positive_id", F.col("score").alias("positive_score"), F.posexplode("best").alias("at", "b"))
    negative = -F.col("b.minus")
    return rows.where(F.lit(least) * F.col("positive_score") <= 100 * negative).where(negative <= F.col("positive_score")).select(
        "anchor_id", "positive_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("b.negative_id").alias("negative_id"), "positive_score", negative.alias("negative_score")
    )
