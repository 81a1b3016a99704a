"""Exact similarity classes of documents by a grouped prefix join on sets of word shingles.

All shingles of all documents are counted, and the most frequent ones come last in the order that every set is sorted
by. Two sets of the wanted similarity share a shingle of their prefixes in that order. Documents with equal sets are
one member, and members with equal prefixes and sizes one group, of which only one entry is in the prefix index. An
index entry first meets the first group of its shingle; where more than one class is left around a shingle, the groups
outside the largest class meet the others in blocks. Pairs of groups are ruled out by their sizes and prefixes;
groups that are left are expanded to their members, which are compared on full sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.chosen_path import _by_group, _Classes, components, shingle_sets
from plumbline.llm.common import chunks, cut, map_arrow, send_if_small

WORDS = 5
#: The most shingles that are put last by their count; they are held by the driver and every task (16 bytes each).
MOST_FREQUENT = 200_000
#: Shingles are counted in slices that stand for about this many bytes of text.
SLICE_BYTES = 8 << 20
#: Most keys (8 bytes each) of shared prefix shingles that are sent to every task; more are joined by a shuffle.
SHARED_KEYS = 2_000_000
#: Members of a group and groups of a block.
GROUP, BLOCK = 64, 128

_LAST = np.uint64(1 << 63)


def _bits(texts: DataFrame) -> int:
    """Binary digits of the slice number, from the size of the texts."""
    total = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    return max(7, int(total // SLICE_BYTES).bit_length())


def _planes(numbers: np.ndarray) -> bytes:
    """Ascending 32-bit numbers as bytes that compress well: their steps, all lowest bytes first."""
    return np.diff(numbers, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(data: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(data, dtype=np.uint8).reshape(4, -1).T.copy().view("<u4").ravel(), dtype=np.uint32)


def counts(rows: DataFrame, column: str, numbers, bits: int, least: int) -> DataFrame:
    """``key`` (the leading ``32 + bits`` binary digits of a 64-bit number) and ``n``, its occurrences, from ``least`` on.

    ``numbers`` gives the arrays of a record batch. Tasks count within chunks and send packed counts by slice, the
    leading ``bits`` digits; a slice is added up in one piece, to which a chunk gives each key once.
    """

    def count(batches):
        for batch in chunks(batches, column):
            found = [s for s in numbers(batch) if len(s)]
            if not found:
                continue
            keys, n = np.unique(np.concatenate(found) >> np.uint64(32 - bits), return_counts=True)
            slices = (keys >> np.uint64(32)).astype(np.int64)
            edges = [0, *(np.flatnonzero(np.diff(slices)) + 1), len(keys)]
            low, n = keys.astype(np.uint32), n.astype(np.uint32)
            parts, again = list(zip(edges, edges[1:])), n > 1
            for at in range(0, len(parts), 4096):
                some = parts[at : at + 4096]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(slices[[i for i, _ in some]]),
                        pa.array([_planes(low[i:j][~again[i:j]]) for i, j in some], pa.binary()),
                        pa.array([_planes(low[i:j][again[i:j]]) for i, j in some], pa.binary()),
                        pa.array([n[i:j][again[i:j]].tobytes() for i, j in some], pa.binary()),
                    ],
                    ["slice", "once", "several", "counts"],
                )

    def add(table: pa.Table) -> pa.Table:
        once, several = (np.concatenate([_from_planes(x) for x in table.column(c).to_pylist()]) for c in ("once", "several"))
        held = np.frombuffer(b"".join(table.column("counts").to_pylist()), dtype=np.uint32)
        keys, place = np.unique(np.concatenate([once, several]), return_inverse=True)
        n = np.bincount(place, weights=np.concatenate([np.ones(len(once)), held])).astype(np.int64)
        often = n >= least
        keys = keys[often].astype(np.uint64) + (np.uint64(table.column("slice")[0].as_py()) << np.uint64(32))
        return pa.table({"key": pa.array(keys.view(np.int64)), "n": pa.array(n[often], pa.int64())})

    packed = map_arrow(rows.select(column), count, "slice long, once binary, several binary, counts binary")
    return packed.groupBy("slice").applyInArrow(add, "key long, n long")


def shingle_counts(texts: DataFrame, bits: int, width: int = WORDS) -> DataFrame:
    """``key`` and ``n``, the number of documents, of the shingles that three documents or more have."""
    return counts(texts, "text", lambda batch: shingle_sets(batch.column("text"), width), bits, 3)


def frequent(found: DataFrame, most: int = MOST_FREQUENT) -> np.ndarray:
    """Keys of the most frequent shingles, by their count; all that have a count are in or out together."""
    steps = found.groupBy("n").count().orderBy(F.desc("n")).limit(most).collect()  # each count has a key at least
    least, held = None, 0
    for n, keys in steps:
        held += keys
        if held > most:
            break
        least = n
    if least is None:
        return np.empty(0, dtype=np.uint64)
    rows = found.where(F.col("n") >= least).select("n", "key").toArrow()
    n, keys = (rows.column(c).to_numpy() for c in ("n", "key"))
    return keys[np.lexsort((keys, n))].astype(np.uint64)


def packed(codes: np.ndarray) -> bytes:
    """Ascending ordering numbers, the leading 48 binary digits of them, as bytes that compress well."""
    return np.diff(codes >> np.uint64(16), prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].T.tobytes()


def unpacked(data: bytes) -> np.ndarray:
    steps = np.zeros((len(data) // 6, 8), dtype=np.uint8)
    steps[:, :6] = np.frombuffer(data, dtype=np.uint8).reshape(6, -1).T
    return np.cumsum(steps.view("<i8").ravel())


class Order:
    """The order of shingles: rare ones by fingerprint, then the frequent ones by their count."""

    def __init__(self, last: np.ndarray, bits: int):
        self.bits = bits
        self.rank = np.argsort(last).astype(np.uint64)
        self.keys = last[self.rank.astype(np.int64)]

    def prefix(self, found: np.ndarray, percent: int) -> np.ndarray:
        """Sorted ordering numbers of the first shingles of a set, one of which every similar set has among its own."""
        codes = found >> np.uint64(1)
        if len(self.keys):
            key = found >> np.uint64(32 - self.bits)
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[at] == key
            # The count's rank, then the digits that the key does not hold.
            codes[hit] = _LAST | (self.rank[at[hit]] << np.uint64(45)) | (found[hit] & np.uint64((1 << 45) - 1))
        length = len(found) + percent * len(found) // -100 + 1
        return np.sort(np.partition(codes, length - 1)[:length]) if length < len(codes) else np.sort(codes)


def _halves(data: bytes) -> tuple[int, int]:
    whole = xxhash.xxh3_128_intdigest(data)
    return (whole >> 64) - (1 << 63), (whole & (1 << 64) - 1) - (1 << 63)


def prefixes(documents: DataFrame, order: Order, percent: int, width: int) -> DataFrame:
    """``doc_id``, ``n_shingles``, the fingerprint of the set, its prefix, and the fingerprint of that, of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(order)

    def find(batches):
        for batch in chunks(batches):
            rows = []
            for found in shingle_sets(batch.column("text"), width):
                prefix = packed(shared.value.prefix(found, percent)) if len(found) else b""
                rows.append((len(found), *_halves(found.tobytes()), prefix, *_halves(prefix)))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_shingles", "high", "low", "prefix", "p_high", "p_low"])

    return map_arrow(documents, find, "doc_id long, n_shingles long, high long, low long, prefix binary, p_high long, p_low long")


def members_and_groups(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct sets (``id``, ``doc_id``, ``high``, ``low``, ``n_shingles``, ``g``), and groups (``g``, its first member's ``doc_id``, ``high`` and ``low``, ``members``).

    A group holds about ``GROUP`` members at most; more members with one prefix and size are several groups.
    """
    usable = docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    key = ["n_shingles", "p_high", "p_low"]
    least = usable.groupBy("high", "low").agg(F.min("doc_id").alias("doc_id"), *[F.min(c).alias(c) for c in key])
    members = cut(least.select(F.monotonically_increasing_id().alias("id"), "*"), "members")
    parts = members.groupBy(*key).agg(F.ceil(F.count(F.lit(1)) / GROUP).alias("parts")).where("parts > 1")
    dealt = members.join(parts, key, "left").withColumn("part", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))))
    numbers = dealt.groupBy(*key, "part").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("members"))
    members = cut(dealt.join(numbers, [*key, "part"]).drop("parts", "part"), "members")
    groups = members.where("id = g").select("g", "doc_id", "high", "low", "members")
    return members.select("id", "doc_id", "high", "low", "n_shingles", "g"), cut(groups, "groups")


def with_prefixes(rows: DataFrame, groups: DataFrame, docs: DataFrame) -> DataFrame:
    """``rows`` with the sizes and prefixes of their groups ``g``, which are read from the groups' first members."""
    named = rows.join(groups.select("g", "doc_id", "high", "low"), "g")
    return docs.select("doc_id", "high", "low", "n_shingles", "prefix").join(send_if_small(cut(named, "named")), ["doc_id", "high", "low"])


def size_class(size: str, percent: int) -> F.Column:
    """Sets that can be similar are of one class or of classes that follow each other."""
    return F.floor(F.log(F.col(size)) / F.log(F.lit(100 / percent + 1e-6))).cast("int")


def index_nodes(groups: DataFrame, docs: DataFrame, bits: int, percent: int) -> DataFrame:
    """``node``, ``of``, ``g`` and ``n_shingles``: the groups around each prefix shingle, by the class ``of`` of their sizes.

    A group stands in its own size class and the next, so a node's pairs of interest have a group of its class ``of``.
    Of nodes with the same groups, that of the smallest shingle is kept.
    """
    indexed = with_prefixes(groups.select("g"), groups, docs).select("g", "prefix")

    def unpack(batches):
        for batch in chunks(batches, "prefix"):
            sets = [unpacked(x) for x in batch.column("prefix").to_pylist()]
            g = np.repeat(batch.column("g").to_numpy(), [len(x) for x in sets])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sets)), pa.array(g)], ["token", "g"])

    numbers = lambda batch: [np.unique(unpacked(x)).astype(np.uint64) << np.uint64(16) for x in batch.column("prefix").to_pylist()]
    shared = cut(counts(indexed, "prefix", numbers, bits, 2).select("key"), "shared")
    entries = map_arrow(indexed, unpack, "token long, g long").withColumn("key", F.shiftrightunsigned(F.shiftleft("token", 16), 32 - bits))
    entries = entries.join(send_if_small(shared, SHARED_KEYS), "key").select("token", "g")
    sizes = docs.select("high", "low", "n_shingles").join(send_if_small(groups.select("g", "doc_id", "high", "low")), ["high", "low"])
    sizes = cut(sizes.select("g", "n_shingles").distinct(), "sizes")
    sized = cut(entries.distinct().join(sizes, "g"), "entries")
    own = size_class("n_shingles", percent)
    dealt = sized.select("token", "g", "n_shingles", own.alias("own"), F.explode(F.array(own, own + 1)).alias("of"))
    around = dealt.groupBy("token", "of").agg(
        F.count(F.lit(1)).alias("n"), F.max("own").alias("most"), F.max("n_shingles").alias("largest"), F.min("n_shingles").alias("smallest"), F.bit_xor(F.xxhash64("g")).alias("x"), F.bit_xor(F.xxhash64("g", F.lit(1))).alias("y")
    ).where("n > 1 AND most = of").where((F.col("n") > 2) | (F.lit(percent) * F.col("largest") <= 100 * F.col("smallest")))
    once = around.groupBy("of", "n", "x", "y").agg(F.min("token").alias("token")).select("token", "of")
    return cut(dealt.join(once, ["token", "of"]).select(F.col("token").alias("node"), "of", "g", "n_shingles"), "nodes")


ENTRIES = ["group", "g", "side", "n_shingles", "label", "prefix", "node", "of"]
TOUCHED = "group long, g long, side int"


def _shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many numbers each set on the left shares with each on the right, or more where numbers repeat in a set."""
    rows = [np.repeat(np.arange(len(s)), [len(x) for x in s]) for s in (left, right)]
    tokens, place = np.unique(np.concatenate([*left, *right]), return_inverse=True)
    places = place[: len(rows[0])], place[len(rows[0]) :]
    both = np.flatnonzero(np.bincount(places[0], minlength=len(tokens)).astype(bool) & np.bincount(places[1], minlength=len(tokens)).astype(bool))
    out = np.zeros((len(left), len(right)))
    for at in range(0, len(both), 4096):
        some = both[at : at + 4096]
        dense = []
        for r, p, s in zip(rows, places, (left, right)):
            column = np.minimum(np.searchsorted(some, p), len(some) - 1)
            hit = some[column] == p
            cells = np.bincount(r[hit] * len(some) + column[hit], minlength=len(s) * len(some))
            dense.append(cells.reshape(len(s), len(some)).astype(np.float32))
        out += dense[0] @ dense[1].T
    return out


def _rests(sets: list[np.ndarray], size: np.ndarray, last: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """What is left of set ``x`` behind the end of the prefix of ``y``, where that ends first."""
    before = np.stack([np.searchsorted(sets[i], last[y], side="left") for i in x])
    return size[x][:, None] - before


def possible_groups(rows: DataFrame, percent: int) -> DataFrame:
    """Rows of a block with a partner of another class on the other side that sizes and prefixes do not rule out.

    Where a block has a ``node``, a pair counts only at the first shingle that both prefixes have, in its size class ``of``.
    """

    def of_block(table):
        side, size, label, g = (table.column(c).to_numpy() for c in ("side", "n_shingles", "label", "g"))
        sets = [unpacked(x) for x in table.column("prefix").to_pylist()]
        node, of = (table.column(c)[0].as_py() for c in ("node", "of"))
        length, last = np.array([len(s) for s in sets]), np.array([s[-1] for s in sets])
        x, y = np.flatnonzero(side == 1), np.flatnonzero(side == 2)
        if not len(x) or not len(y):
            return table.slice(0, 0)
        low, high = np.minimum(size[x][:, None], size[y][None, :]), np.maximum(size[x][:, None], size[y][None, :])
        good = (label[x][:, None] != label[y][None, :]) & (g[x][:, None] != g[y][None, :]) & (100 * low >= percent * high)
        if node is not None:
            own = np.floor(np.log(size) / np.log(100 / percent + 1e-6)).astype(int)
            good &= np.maximum(own[x][:, None], own[y][None, :]) == of
        if not good.any():
            return table.slice(0, 0)
        shared = _shared_counts([sets[i] for i in x], [sets[i] for i in y])
        # Up to the end of the prefix that ends first, common shingles are in both; what is left of both sets may be common, too.
        ends_x = np.minimum((size - length)[x][:, None], _rests(sets, size, last, y, x).T)
        ends_y = np.minimum((size - length)[y][None, :], _rests(sets, size, last, x, y))
        first = np.sign(last[x][:, None] - last[y][None, :])
        rest = np.where(first < 0, ends_x, np.where(first > 0, ends_y, np.maximum((size - length)[x][:, None], (size - length)[y][None, :])))
        good &= ((shared + rest) * (100 + percent) >= percent * (low + high)) & (shared > 0)
        if node is not None:
            for i, j in zip(*np.nonzero(good)):
                good[i, j] = np.intersect1d(sets[x[i]], sets[y[j]])[0] == node
        return table.take(pa.array(np.concatenate([x[good.any(axis=1)], y[good.any(axis=0)]])))

    return _by_group(rows, of_block, TOUCHED)


MEMBERS = ["group", "id", "label", "side", "high", "low", "text"]


def confirmed_links(rows: DataFrame, documents: DataFrame, percent: int, width: int) -> DataFrame:
    """Links ``a < b`` that join the classes of each block: ``rows`` name members, their label, document and set.

    Texts are moved, which compress to less than their sets; the sets are made where they are compared.
    """

    def of_block(table):
        sets = list(shingle_sets(table.column("text").combine_chunks(), width))
        wanted = zip(table.column("high").to_pylist(), table.column("low").to_pylist())
        ours = np.flatnonzero([_halves(s.tobytes()) == w for s, w in zip(sets, wanted)])  # not another text of the same id
        table, sets = table.take(pa.array(ours)), [sets[i] for i in ours]
        side, ids = (table.column(c).to_numpy() for c in ("side", "id"))
        size = np.array([len(s) for s in sets])
        classes, links = _Classes(table.column("label").to_pylist()), []
        right = np.flatnonzero(side & 2)
        for i in np.flatnonzero(side & 1):
            fits = right[(100 * size[right] >= percent * size[i]) & (100 * size[i] >= percent * size[right])]
            others = [j for j in fits if ids[j] != ids[i] and classes.find(i) != classes.find(j)]
            if not others:
                continue
            flat = np.concatenate([sets[j] for j in others])
            place = np.minimum(np.searchsorted(sets[i], flat), size[i] - 1)
            shared = np.add.reduceat((sets[i][place] == flat).astype(np.int64), np.cumsum(size[others]) - size[others])
            good = 100 * shared >= percent * (size[i] + size[others] - shared)
            links += [(i, j) for j, yes in zip(others, good) if yes and classes.join(i, j)]
        x, y = (ids[[p[k] for p in links]] if links else ids[:0] for k in (0, 1))
        return pa.table({"a": pa.array(np.minimum(x, y), pa.int64()), "b": pa.array(np.maximum(x, y), pa.int64())})

    rows = cut(rows, "rows")
    wanted = documents.join(send_if_small(rows.select("doc_id").distinct()), "doc_id", "left_semi")
    texts = wanted.join(rows, "doc_id").select(MEMBERS)
    return _by_group(texts, of_block, "a long, b long").distinct()


def first_blocks(nodes: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """``group``, ``g``, ``side``, and no ``node`` and ``of``: the first group of each node (1) with the others of like size (2), each pair once."""
    first = nodes.groupBy("node", "of").agg(F.min("g").alias("a"))
    pairs = nodes.join(first, ["node", "of"]).where("g != a").select("a", "g", "n_shingles").distinct()
    both = pairs.join(sizes.select(F.col("g").alias("a"), F.col("n_shingles").alias("n")), "a")
    pairs = cut(both.where(F.lit(percent) * F.greatest("n", "n_shingles") <= 100 * F.least("n", "n_shingles")).select("a", "g"), "pairs")
    parts = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("parts"))
    others = pairs.join(parts, "a").select(F.xxhash64("a", F.pmod(F.xxhash64("g"), F.col("parts"))).alias("group"), "g", F.lit(2).alias("side"))
    each = F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")
    heads = parts.select("a", each).select(F.xxhash64("a", "part").alias("group"), F.col("a").alias("g"), F.lit(1).alias("side"))
    return others.unionByName(heads).select("*", F.lit(None).cast("long").alias("node"), F.lit(None).cast("int").alias("of"))


def open_blocks(nodes: DataFrame, labels: DataFrame) -> DataFrame:
    """Blocks of the nodes with more than one class: groups outside a node's largest class (1) with all of its groups (2)."""
    key = ["node", "of"]
    labelled = cut(nodes.join(labels, "g"), "open")
    by_label = labelled.groupBy(*key, "label").agg(F.count(F.lit(1)).alias("n"))
    top = by_label.groupBy(*key).agg(
        F.max(F.struct("n", "label"))["label"].alias("top"), F.sum("n").alias("all"), (F.sum("n") - F.max("n")).alias("others")
    ).where("others > 0")
    blocks = top.select(*key, "top", F.ceil(F.col("others") / BLOCK).alias("lefts"), F.ceil(F.col("all") / BLOCK).alias("rights"))
    rows = labelled.join(blocks, key)
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1)).alias("at")
    own = lambda n: F.pmod(F.xxhash64("g"), F.col(n)).alias("own")
    left = rows.where("label != top").select(*key, "g", own("lefts"), each("rights"))
    left = left.select(F.xxhash64(*key, "own", "at").alias("group"), "g", F.lit(1).alias("side"), *key)
    right = rows.select(*key, "g", own("rights"), each("lefts"))
    right = right.select(F.xxhash64(*key, "at", "own").alias("group"), "g", F.lit(2).alias("side"), *key)
    return left.unionByName(right)


def similar_classes(documents: DataFrame, percent: int = 80, width: int = WORDS) -> DataFrame:
    """``doc_id``, ``n_shingles`` and ``component_id`` of every row of ``documents``.

    A to Z are lower-cased and words are runs without white space. A document's set has its distinct shingles of
    ``width`` words, or its whole word sequence if it is shorter; without words or text it is empty and linked with
    nothing. Rows are linked if ``100 * |intersection| >= percent * |union|``, and rows with sets that share a
    ``doc_id`` are linked, too. ``component_id`` is the smallest ``doc_id`` reachable. Repeated rows each get their
    result; a row without ``doc_id`` is linked with nothing and has no component. Other columns are not used.
    Shingles are told apart by 64-bit fingerprints.
    """
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    bits = _bits(texts)
    last = frequent(cut(shingle_counts(texts, bits, width), "counts"))
    all_docs = cut(prefixes(texts, Order(last, bits), percent, width), "prefixes")
    repeated = cut(texts.groupBy("doc_id").count().where("count > 1").select("doc_id"), "repeated")
    if repeated.take(1):  # repeated rows are compared once
        docs, texts = _once(all_docs, repeated, "high", "low"), _once(texts, repeated, "text")
    else:
        docs = all_docs
    members, groups = members_and_groups(docs)
    nodes = index_nodes(groups, docs, bits, percent)

    def links(blocks: DataFrame, labels: DataFrame, inside: DataFrame | None = None) -> DataFrame:
        """Links of members in blocks of groups; ``labels`` has the class of each member."""
        by_group = labels.groupBy("g").agg(F.min("label").alias("label"), F.max("label").alias("most"))
        one_class = F.when(F.col("label") == F.col("most"), F.col("label")).otherwise(-1 - F.col("g"))
        entries = with_prefixes(blocks.join(by_group.select("g", one_class.alias("label")), "g"), groups, docs)
        left = possible_groups(entries.select(ENTRIES), percent)
        if inside is not None:
            left = left.unionByName(inside)
        rows = left.join(labels.select("g", "id", "label", "doc_id", "high", "low"), "g").drop("g")
        return cut(confirmed_links(rows, texts, percent, width), "links")

    alone = members.withColumn("label", F.col("id"))
    several = groups.where("members > 1").select(F.xxhash64("g", F.lit("inside")).alias("group"), "g", F.lit(3).alias("side"))
    found = links(first_blocks(nodes, members.where("id = g"), percent), alone, several).unionByName(_same_id(docs, members))
    found = cut(found, "links")

    def labelled() -> DataFrame:
        return cut(members.join(components(found), "id", "left").withColumn("label", F.coalesce("label", "id")), "labels")

    labels = labelled()
    of_groups = labels.groupBy("g").agg(F.min("label").alias("label"), F.max("label").alias("most"))
    of_groups = of_groups.select("g", F.when(F.col("label") == F.col("most"), F.col("label")).otherwise(-1 - F.col("g")).alias("label"))
    blocks = cut(open_blocks(nodes, of_groups), "open")
    if blocks.take(1):
        found = found.unionByName(links(blocks, labels))
        labels = labelled()
    smallest = labels.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    reached = labels.join(smallest, "label").select("high", "low", "component_id")
    joined = all_docs.select("doc_id", "n_shingles", "high", "low").join(reached, ["high", "low"], "left")
    component = F.when(F.col("doc_id").isNull(), None).when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id"))


def _once(rows: DataFrame, repeated: DataFrame, *columns: str) -> DataFrame:
    """One of the rows that agree in ``doc_id`` and the given columns."""
    several = rows.join(repeated, "doc_id", "left_semi").dropDuplicates(["doc_id", *columns])
    return rows.join(repeated, "doc_id", "left_anti").unionByName(several)


def _same_id(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Links between the sets of one ``doc_id``."""
    sets = docs.where("n_shingles > 0 AND doc_id IS NOT NULL").select("doc_id", "high", "low")
    repeated = sets.groupBy("doc_id").count().where("count > 1").select("doc_id")
    rows = sets.join(repeated, "doc_id").join(members.select("id", "high", "low"), ["high", "low"])
    least = rows.groupBy("doc_id").agg(F.min("id").alias("a"))
    return rows.join(least, "doc_id").where("id != a").select("a", F.col("id").alias("b")).distinct()
