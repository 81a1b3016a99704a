"""Near-duplicate classes by a chosen-path similarity join on sets of word shingles.

Documents with equal sets are one class member. Over the members, independent trees branch by minwise tokens: a
node of a tree holds the members that agree in the chosen coordinates of their minwise signatures on the way from
the root. Small nodes are compared exhaustively, large nodes branch again, and nodes that do not shrink any more
are compared with their first member, then block by block where more than one class is left in them. Candidates
pass an estimate from the signatures; links are confirmed on full sets. A pair of similarity ``s`` misses one tree
with a probability of about ``(1 - s) ** branches`` per level, and all trees with that to the power ``trees``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import chunks, cut, map_arrow, row_key, send_if_small, split_words, unused
from plumbline.session import cut_and_count

WORDS = 5
#: Minwise values of a signature: those that branch are kept in four bytes each, and one byte of every value serves the estimate.
BRANCHING, COORDINATES = 32, 256
TREES, BRANCHES = 4, 2
SMALL_NODE = 128
MAX_LEVELS = 12
#: A child with more than this share of its parent's members counts as not shrinking.
TIGHT = 0.75
BLOCK = 256

_MIX = np.uint64(0xFF51AFD7ED558CCD)
_STEP = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
_ODD = np.random.default_rng(3).integers(0, 1 << 63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, width: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit fingerprints of the word shingles of each text; see :func:`near_classes`."""
    offsets, codes, words = split_words(texts, lower=True)
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))[codes]
    n = len(hashes)
    steps = (_STEP * (width // len(_STEP) + 1))[:width]
    rolled = np.zeros(max(n - width + 1, 0), dtype=np.uint64)
    for i, step in enumerate(steps):
        rolled = _mixed(rolled + hashes[i : i + len(rolled)] * step)
    for i, j in zip(offsets, offsets[1:]):
        if j - i >= width:
            yield np.unique(rolled[i : j - width + 1])
        elif j > i:
            yield np.array([xxhash.xxh3_64_intdigest(hashes[i:j].tobytes(), seed=int(j - i))], dtype=np.uint64)
        else:
            yield np.empty(0, dtype=np.uint64)


def _signature(found: np.ndarray) -> np.ndarray:
    least = np.full(COORDINATES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(found), 2048):
        np.minimum(least, (_ODD[:, None] * found[None, i : i + 2048]).min(axis=1), out=least)
    return (least[:BRANCHING] >> np.uint64(32)).astype("<u4").tobytes() + (least >> np.uint64(40)).astype(np.uint8).tobytes()


def sketches(documents: DataFrame, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, the set's 128-bit fingerprint in two longs, and its minwise signature."""

    def sketch(batches):
        for batch in chunks(batches):
            sizes, high, low, signatures = [], [], [], []
            for found in shingle_sets(batch.column("text"), width):
                whole = xxhash.xxh3_128_intdigest(found.tobytes())
                sizes.append(len(found))
                high.append((whole >> 64) - (1 << 63))
                low.append((whole & (1 << 64) - 1) - (1 << 63))
                signatures.append(_signature(found) if len(found) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), pa.array(sizes, pa.int64()), pa.array(high, pa.int64()), pa.array(low, pa.int64()), pa.array(signatures, pa.binary())],
                ["doc_id", "n_shingles", "high", "low", "signature"],
            )

    texts = documents.select("doc_id", F.col("text").cast("string").alias("text"))
    return map_arrow(texts, sketch, "doc_id long, n_shingles long, high long, low long, signature binary")


def _value(c: str) -> F.Column:
    """The ``c``-th branching value, four bytes of the signature."""
    return F.expr(f"substring(signature, cast({c} as int) * 4 + 1, 4)")


def branch_nodes(members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Small nodes and large nodes that do not shrink, as rows of ``node`` and ``id``."""
    first = F.array(*[F.xxhash64(F.lit(c), _value(str(c))) for c in range(TREES * BRANCHES)])
    rows = members.select("id", F.explode(first).alias("node"), F.lit(None).cast("long").alias("above"))
    small, tight = [], []
    for level in range(1, MAX_LEVELS + 1):
        rows = cut(rows, "paths")
        sizes = rows.groupBy("node").agg(F.count(F.lit(1)).alias("size"), F.max("above").alias("above"))
        sizes = sizes.where("size > 1")
        still = (F.col("size") > TIGHT * F.col("above")) if level < MAX_LEVELS else F.lit(True)
        kind = F.when(F.col("size") <= SMALL_NODE, 0).when(still, 1).otherwise(2)
        rows = rows.select("id", "node").join(sizes.select("node", "size", kind.alias("kind")), "node")
        rows, large = cut_and_count(rows, F.col("kind") == 2, "paths")
        small.append(rows.where("kind = 0").select("node", "id"))
        tight.append(rows.where("kind = 1").select("node", "id"))
        if not large:
            break
        wide = rows.where("kind = 2").join(members.select("id", "signature"), "id")
        children = []
        for j in range(BRANCHES):
            c = f"pmod(xxhash64(node, {j}), {BRANCHING})"
            children.append(F.xxhash64(F.col("node"), F.expr(c), _value(c)))
        rows = wide.select("id", F.explode(F.array(*children)).alias("node"), F.col("size").alias("above"))
    return _all(small), _all(tight)


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


CANDIDATES = "a long, b long"
ROWS = "group long, id long, label long, n_shingles long, side int, signature binary"
_COLUMNS = [f.split()[0] for f in ROWS.split(", ")]


def _near_pairs(table: pa.Table, percent: int, margin: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of a group that may be linked, and their estimates: left and right rows with other labels and close signatures."""
    label, size, side = (table.column(c).to_numpy() for c in ("label", "n_shingles", "side"))
    raw = b"".join(table.column("signature").to_pylist())
    signatures = np.frombuffer(raw, dtype=np.uint8).reshape(len(label), -1)[:, -COORDINATES:]
    left, right = np.flatnonzero(side & 1), np.flatnonzero(side & 2)
    ok = label[left][:, None] != label[right][None, :]
    low = np.minimum(size[left][:, None], size[right][None, :])
    ok &= 100 * low >= percent * np.maximum(size[left][:, None], size[right][None, :])
    x, y = np.nonzero(ok)
    x, y = left[x], right[y]
    if not len(x):
        return x, y, np.zeros(0)
    steps = range(0, len(x), 8192)
    near = np.concatenate([(signatures[x[i : i + 8192]] == signatures[y[i : i + 8192]]).mean(axis=1) for i in steps])
    good = near >= percent / 100 - margin
    return x[good], y[good], near[good]


class _Classes:
    """Union-find over the rows of a group."""

    def __init__(self, labels):
        seen: dict = {}
        self.root = [seen.setdefault(label, i) for i, label in enumerate(labels)]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.root[i] = j
        return i != j


def _pairs(table: pa.Table, pairs: list[tuple[int, int]]) -> pa.Table:
    ids = table.column("id").to_numpy()
    x, y = (ids[[p[i] for p in pairs]] for i in (0, 1)) if pairs else (ids[:0], ids[:0])
    return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})


def _forest(percent: int, margin: float):
    """A forest of a group's closest pairs, which is enough if they hold."""

    def of_group(table):
        x, y, near = _near_pairs(table, percent, margin)
        classes = _Classes(range(table.num_rows))
        return _pairs(table, [(x[k], y[k]) for k in np.argsort(-near, kind="stable") if classes.join(x[k], y[k])])

    return of_group


def _touched(percent: int, margin: float):
    """The rows of a group that are in some pair."""

    def of_group(table):
        x, y, _ = _near_pairs(table, percent, margin)
        return table.take(pa.array(np.union1d(x, y)))

    return of_group


def _linked(percent: int, margin: float):
    """Links that join a group's classes, confirmed on the full sets in ``found``."""

    def of_group(table):
        x, y, near = _near_pairs(table, percent, margin)
        sets = [np.frombuffer(s, dtype=np.uint64) for s in table.column("found").to_pylist()]
        classes, links = _Classes(table.column("label").to_pylist()), []
        for i in np.unique(x):
            others = [j for j in y[x == i] if classes.find(i) != classes.find(j)]
            if not others or not len(sets[i]):
                continue
            sizes = np.array([len(sets[j]) for j in others])
            flat = np.concatenate([sets[j] for j in others])
            place = np.minimum(np.searchsorted(sets[i], flat), len(sets[i]) - 1)
            shared = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(sizes) - sizes)
            good = 100 * shared >= percent * (len(sets[i]) + sizes - shared)
            links += [(i, j) for j, yes in zip(others, good) if yes and classes.join(i, j)]
        return _pairs(table, links)

    return of_group


def _by_group(rows: DataFrame, of_group, schema: str) -> DataFrame:
    """``of_group`` on each group of rows; a task holds one group at a time."""
    names = [f.strip().split()[0] for f in schema.split(",")]

    def stream(batches):
        held: list[pa.Table] = []

        def close():
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            if table.num_rows > 1:
                yield from of_group(table).select(names).to_batches()

        for batch in batches:
            table = pa.Table.from_batches([batch])
            groups = table.column("group").to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
            for i, j in zip(edges, edges[1:]):
                if j > i:
                    if held and held[-1].column("group")[0].as_py() != groups[i]:
                        yield from close()
                    held.append(table.slice(i, j - i))
        if held:
            yield from close()

    return map_arrow(rows.repartition("group").sortWithinPartitions("group"), stream, schema)


def first_candidates(small: DataFrame, tight: DataFrame, members: DataFrame, percent: int, margin: float) -> DataFrame:
    """A forest of close pairs of each small node, and each tight node's members with its first member."""
    inside = small.select(F.col("node").alias("group"), "id", F.col("id").alias("label"), F.lit(3).alias("side"))
    inside = inside.join(members.select("id", "n_shingles", "signature"), "id").select(_COLUMNS)
    forest = _by_group(inside, _forest(percent, margin), CANDIDATES)
    firsts = tight.groupBy("node").agg(F.min("id").alias("a"))
    stars = tight.join(firsts, "node").where("id != a").select("a", F.col("id").alias("b"))
    return forest.unionByName(stars).distinct()


def open_rows(nodes: DataFrame, labels: DataFrame, members: DataFrame, percent: int, margin: float) -> DataFrame:
    """Rows of nodes whose members are not of one class yet, in blocks: those outside a node's largest class meet all others, once.

    Rows without a close partner of another class in their block are left out.
    """
    labelled = cut(
        nodes.join(labels, "id", "left").select("node", "id", F.coalesce("label", "id").alias("label")), "open"
    )
    by_label = labelled.groupBy("node", "label").agg(F.count(F.lit(1)).alias("n"))
    largest = by_label.groupBy("node").agg(
        F.max(F.struct("n", "label"))["label"].alias("top"),
        F.sum("n").alias("all"),
        (F.sum("n") - F.max("n")).alias("others"),
    ).where("others > 0")
    split = largest.select("node", "top", F.ceil(F.col("others") / BLOCK).alias("lefts"), F.ceil((F.col("all") - F.col("others")) / BLOCK).alias("tops"), "all")
    rows = labelled.join(split, "node")
    other = F.col("label") != F.col("top")
    one = F.col("all") <= BLOCK
    small = rows.where(one).select(F.xxhash64("node", F.lit(-1), F.lit(-1)).alias("group"), "id", "label", F.when(other, 3).otherwise(2).alias("side"))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("at")
    own = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).alias("own")
    many = rows.where(~one)
    # Blocks outside the largest class meet each other once, and each block of the largest class.
    outside = many.where(other).select("node", "id", "label", own("lefts"), each("lefts"))
    among = outside.select(
        F.xxhash64("node", F.least("own", "at"), F.greatest("own", "at"), F.lit(0)).alias("group"), "id", "label",
        F.when(F.col("own") < F.col("at"), 1).when(F.col("own") > F.col("at"), 2).otherwise(3).alias("side"),
    )
    left = many.where(other).select("node", "id", "label", own("lefts"), each("tops"))
    left = left.select(F.xxhash64("node", "own", "at", F.lit(1)).alias("group"), "id", "label", F.lit(1).alias("side"))
    right = many.where(~other).select("node", "id", "label", own("tops"), each("lefts"))
    right = right.select(F.xxhash64("node", "at", "own", F.lit(1)).alias("group"), "id", "label", F.lit(2).alias("side"))
    blocks = among.unionByName(left).unionByName(right)
    rows = small.unionByName(blocks).join(members.select("id", "n_shingles", "signature"), "id").select(_COLUMNS)
    return cut(_by_group(rows, _touched(percent, margin), ROWS), "open")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets reach the similarity: ``percent * |union| <= 100 * |intersection|``."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("found").alias("x")), "a")
    both = both.join(sets.select(F.col("id").alias("b"), F.col("found").alias("y")), "b")

    def check(batches):
        for batch in batches:
            kept = []
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer(), dtype=np.uint64) for c in ("x", "y"))
                together = len(np.intersect1d(x, y, assume_unique=True))
                kept.append(100 * together >= percent * (len(x) + len(y) - together))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(kept))

    return map_arrow(both.select("a", "b", "x", "y"), check, CANDIDATES)


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``label``, the smallest id reachable, for all ids of links ``a < b``.

    Alternating star operations: every id's larger neighbours are moved to its smallest neighbour, then smaller ones
    likewise, until nothing changes; the table is written in each round.
    """
    edges, before = links.select(F.col("b").alias("u"), F.col("a").alias("v")).where("u > v").distinct(), None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        grown = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        grown = cut(grown, "stars")
        least = grown.groupBy("u").agg(F.min("v").alias("m"))
        moved = grown.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "stars")
        now = edges.agg(F.count(F.lit(1)), F.sum(F.hash("u", "v").cast("decimal(38,0)"))).first()
        if now == before or not now[0]:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("label"))
        before = now


def near_classes(documents: DataFrame, percent: int = 85, width: int = WORDS, margin: float = 0.09) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` for every row of ``documents``.

    A to Z are lower-cased and words are runs without white space. A document's set has its distinct shingles of
    ``width`` words, or its whole word sequence if it is shorter; without words or text it is empty and linked with
    nothing. Documents are linked if ``100 * |intersection| >= percent * |union|``. ``component_id`` is the smallest
    ``doc_id`` reachable over links and ``kept`` marks the row that has it. Rows of one ``doc_id`` are one document
    for linking. A row without ``doc_id`` has no component and is kept. Columns other than ``doc_id`` and ``text``
    are not used. ``margin`` is what a signature's estimate may fall short of the similarity, four standard errors
    of a pair just at the threshold.
    """
    docs = cut(sketches(documents, width), "sketches")
    usable = docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = cut(usable.groupBy("high", "low").agg(F.min("doc_id").alias("id")), "classes")
    members = cut(
        usable.join(classes, ["high", "low"]).where("doc_id = id").select("id", "n_shingles", "signature").dropDuplicates(["id", "n_shingles", "signature"]),
        "members",
    )
    small, tight = branch_nodes(members)
    first = cut(first_candidates(small, tight, members, percent, margin), "pairs")
    first_ids = first.select(F.col("a").alias("id")).unionByName(first.select(F.col("b").alias("id"))).distinct()
    sets = _sets(documents, first_ids, width)
    links = cut(confirmed(first, sets, percent), "links")
    labels = cut(components(links), "labels")
    rows = open_rows(small.unionByName(tight), labels, members, percent, margin)
    if rows.take(1):
        full = rows.join(_sets(documents, rows.select("id").distinct(), width), "id").select(*_COLUMNS, "found")
        more = _by_group(full, _linked(percent, margin), CANDIDATES).distinct()
        labels = components(links.unionByName(cut(more, "links")))
    reached = classes.join(labels, "id", "left").select("high", "low", F.coalesce("label", "id").alias("label"))
    joined = docs.join(reached, ["high", "low"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("label"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def _sets(documents: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """``id`` and ``found``, the sorted fingerprints of its whole text's shingles, of the documents in ``ids``."""

    def find(batches):
        for batch in chunks(batches):
            found = [x.tobytes() for x in shingle_sets(batch.column("text"), width)]
            yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.int64()), pa.array(found, pa.binary())], ["id", "found"])

    texts = documents.select(F.col("doc_id").alias("id"), F.col("text").cast("string").alias("text"))
    ids = send_if_small(cut(ids, "ids"))
    return cut(map_arrow(texts.join(ids, "id", "left_semi"), find, "id long, found binary"), "sets")


def one_of_each(documents: DataFrame, percent: int = 85, width: int = WORDS) -> DataFrame:
    """The rows of ``documents``, with all their columns, without those whose group keeps another row.

    Where an id has several texts, each of them is a document of its own; of rows with one id and text, one stays.
    Rows without ``doc_id`` belong to no group and stay.
    """
    rows = documents.where("doc_id IS NOT NULL").groupBy(row_key().alias("row")).agg(F.count(F.lit(1)).alias("n"))
    rows = cut(rows, "rows")
    if not rows.groupBy("row.doc_id").agg(F.sum("n").alias("n")).where("n > 1").take(1):
        name = unused(documents, "dropped")
        dropped = near_classes(documents, percent, width).where("NOT kept").select(F.col("doc_id").alias(name)).distinct()
        dropped = send_if_small(cut(dropped, "dropped"))
        return documents.join(dropped, documents["doc_id"] == dropped[name], "left_anti")
    ordered = rows.orderBy("row.doc_id", "row.text_hash", "row.bytes")
    numbers = cut(ordered.select("row", "n", F.monotonically_increasing_id().alias("number")), "numbers")  # in the order of the ids
    known = send_if_small(numbers.select("row", "number"))
    numbered = documents.select(row_key().alias("row"), "text").join(known, "row").select(F.col("number").alias("doc_id"), "text")
    dropped = near_classes(numbered, percent, width).where("NOT kept").select(F.col("doc_id").alias("number")).distinct()
    dropped = cut(dropped, "dropped")
    key = unused(documents, "row")
    gone = send_if_small(cut(numbers.join(dropped, "number", "left_semi").select(F.col("row").alias(key)), "gone"))
    again = numbers.where("n > 1").join(dropped, "number", "left_anti").select(F.col("row").alias(key))
    again = send_if_small(cut(again, "again"))
    left = documents.join(gone, row_key() == F.col(key), "left_anti")
    once = left.join(again, row_key() == F.col(key), "left_anti")
    repeated = left.join(again, row_key() == F.col(key), "left_semi").withColumn(key, row_key())
    return once.unionByName(repeated.dropDuplicates([key]).drop(key))
