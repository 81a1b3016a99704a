"""Prefix trie of rebuilt conversations from composable fingerprints.

A turn at place ``j`` adds ``e * B**j`` modulo a prime to its conversation's sum, ``e`` being a hash of its role and
text, so sums of a head and of a tail combine to the fingerprint of both, shifted by a power of ``B``. A rebuilt
conversation, the first turns of one and the last turns of another, gets the fingerprints of all its prefixes from
the sums of the two; its texts are never put together. Equal fingerprints of one depth are a node. Each row keeps a
reference to the stored turn that stands for all turns of its role and text, and nodes are checked by these
references: all members of a node agree in the reference of the last turn and in the parent.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import cut, map_arrow, split_words
from plumbline.operators.skew import rank_within

#: Primes below 2**31 whose residues make a fingerprint of 124 bits, and a base for each.
PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (911382323, 972663749, 1594323157, 1140671485)
#: Rows of a conversation that are added up in one window.
SLICE = 4096

_SUMS = [f"s{i}" for i in range(len(PRIMES))]
_TERMS = [f"t{i}" for i in range(len(PRIMES))]


def _powers(places: np.ndarray, base: int, prime: int) -> np.ndarray:
    """``base ** places`` modulo ``prime``."""
    out, square, left = np.ones(len(places), dtype=np.uint64), np.uint64(base), places.astype(np.uint64)
    while left.any():
        out = np.where(left & np.uint64(1), out * square % np.uint64(prime), out)
        square, left = square * square % np.uint64(prime), left >> np.uint64(1)
    return out


def running_sums(df: DataFrame, key: str, place: str, columns: dict[str, int | None]) -> DataFrame:
    """Adds sums of the given columns up to each row of its key, by ``place``, modulo the given numbers.

    Rows are added up in slices of ``SLICE`` places, so a conversation of any length is many windows.
    """
    sliced = df.withColumn("_slice", F.floor(F.col(place) / SLICE))

    def held(total: Column, modulo: int | None) -> Column:
        return total if modulo is None else F.pmod(total, F.lit(modulo))

    totals = sliced.groupBy(key, "_slice").agg(*[held(F.sum(c), m).alias(f"_{c}") for c, m in columns.items()])
    before = W.partitionBy(key).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    offsets = totals.select(key, "_slice", *[F.coalesce(F.sum(f"_{c}").over(before), F.lit(0)).alias(f"_{c}") for c in columns])
    inside = W.partitionBy(key, "_slice").orderBy(place).rowsBetween(W.unboundedPreceding, 0)
    local = sliced.select("*", *[F.sum(c).over(inside).alias(f"_in_{c}") for c in columns])
    joined = local.join(offsets, [key, "_slice"])
    return joined.select(*df.columns, *[held(F.col(f"_{c}") + F.col(f"_in_{c}"), m).alias(f"sum_{c}") for c, m in columns.items()])


def stored_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The turns (``number``, ``role``, ``text`` …), and by ``conv_id`` and ``place`` (from 1) what fingerprints are made of.

    That is ``n_words``, ``ref`` (the number of one stored turn with the same role and text), the terms of the turn, and
    their sums ``s0`` to ``s3`` up to it.
    """
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce(F.col("turn").cast("long"), F.lit(-(1 << 63))).alias("turn"),
        F.col("turn").isNotNull().alias("has_turn"), plain("role").alias("role"), plain("text").alias("text"),
    )
    turns = cut(turns.withColumn("number", F.monotonically_increasing_id()), "turns")
    ranked = rank_within(turns.select("conv_id", "has_turn", "turn", "role", "text", "number"), ["conv_id"], ["has_turn", "turn", "role", "text", "number"], "place")

    def terms(batches):
        for batch in batches:
            texts, roles = batch.column("text"), batch.column("role").to_pylist()
            places = batch.column("place").to_numpy()
            words = np.diff(split_words(texts)[0])
            hashed = [xxhash.xxh3_128_digest(f"{len(r)}:{r}{t}".encode()) for r, t in zip(roles, texts.to_pylist())]
            parts = np.frombuffer(b"".join(hashed), dtype="<u4").reshape(-1, 4).astype(np.uint64)
            out = [parts[:, i] % np.uint64(p) * _powers(places, b, p) % np.uint64(p) for i, (p, b) in enumerate(zip(PRIMES, BASES))]
            columns = [batch.column(c) for c in ("conv_id", "place", "number")]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(words.astype(np.int64)), *[pa.array(t.astype(np.int64)) for t in out]], ["conv_id", "place", "number", "n_words", *_TERMS]
            )

    schema = "conv_id long, place long, number long, n_words long, " + ", ".join(f"{t} long" for t in _TERMS)
    rows = map_arrow(ranked.select("conv_id", F.col("place").cast("long").alias("place"), "number", "role", "text"), terms, schema)
    summed = running_sums(rows, "conv_id", "place", dict(zip(_TERMS, PRIMES)))
    contents = turns.groupBy("role", "text").agg(F.min("number").alias("ref"))
    same = turns.join(contents, ["role", "text"]).select("number", "ref")
    named = summed.join(same, "number").drop("number")
    return turns, cut(named.withColumnsRenamed({f"sum_{t}": s for t, s in zip(_TERMS, _SUMS)}), "stored")


def _shifted(value: Column, back: Column, i: int) -> Column:
    """``value`` divided by the base ``back`` times (0 to 3)."""
    inverse = pow(BASES[i], -1, PRIMES[i])
    factors = [pow(inverse, k, PRIMES[i]) for k in range(4)]
    return F.pmod(value * F.get(F.array(*[F.lit(f) for f in factors]), back), F.lit(PRIMES[i]))


def prefix_rows(stored: DataFrame, group: int = 20, most: int = 4) -> DataFrame:
    """``conv_id``, ``depth``, fingerprint ``f``, its parent's ``p``, ``ref`` and ``n_words`` of the last turn, ``ends``, for all prefixes.

    A conversation is rebuilt from the first ``h`` turns of the one that begins its group of ``group`` ids, and its own
    turns after its first ``h``; ``h`` is the CRC-32 of its id modulo ``most``, 4 at most.
    """
    h = F.pmod(F.crc32(F.encode(F.col("conv_id").cast("string"), "UTF-8")), F.lit(most)).cast("int")
    base = F.col("conv_id") - F.col("conv_id") % group
    convs = stored.groupBy("conv_id").agg(F.max("place").alias("own")).select("conv_id", "own", h.alias("h"), base.alias("base"))
    fields = ["place", "ref", "n_words", *_TERMS, *_SUMS]
    heads = stored.where(F.col("place") < most).groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("turns"))
    # The sum of a conversation's own first h turns is taken off its later sums.
    joined = convs.alias("c").join(heads.alias("b"), F.col("c.base") == F.col("b.conv_id"), "left").join(heads.alias("o"), F.col("c.conv_id") == F.col("o.conv_id"), "left")
    taken = lambda turns, n: F.slice(F.coalesce(turns, F.array().cast(heads.schema["turns"].dataType)), 1, n)
    sums = lambda turns, name: [F.coalesce(F.get(F.col(turns), F.size(turns) - 1)[s], F.lit(0)).alias(f"{name}{i}") for i, s in enumerate(_SUMS)]
    plan = joined.select("c.conv_id", "own", "h", taken(F.col("b.turns"), F.col("h")).alias("head"), taken(F.col("o.turns"), F.col("h")).alias("skipped"))
    plan = plan.select("conv_id", "own", "h", "head", F.size("head").alias("k"), *sums("head", "head"), *sums("skipped", "own"))
    plan = plan.withColumn("length", F.col("k") + F.greatest(F.col("own") - F.col("h"), F.lit(0)))
    plan = cut(plan, "plan")

    def packed(values: list[Column]) -> Column:
        return F.struct((values[0] * (1 << 31) + values[1]).alias("x"), (values[2] * (1 << 31) + values[3]).alias("y"))

    def row(depth: Column, sums: list[Column], terms: list[Column]) -> list[Column]:
        parents = [F.pmod(s - t, F.lit(p)) for s, t, p in zip(sums, terms, PRIMES)]
        return [
            "conv_id", depth.cast("long").alias("depth"), packed(sums).alias("f"), packed(parents).alias("p"),
            "ref", "n_words", (depth == F.col("length")).alias("ends"),
        ]

    root = plan.select("conv_id", "length", F.lit(None).cast("long").alias("ref"), F.lit(0).cast("long").alias("n_words"))
    root = root.select(*row(F.lit(0), [F.lit(0).cast("long")] * 4, [F.lit(0).cast("long")] * 4))
    first = plan.select("conv_id", "length", F.explode("head").alias("t")).select("conv_id", "length", "t.*")
    first = first.select(*row(F.col("place"), [F.col(s) for s in _SUMS], [F.col(t) for t in _TERMS]))
    rest = stored.join(plan.drop("head"), "conv_id").where("place > h")
    back = F.col("h") - F.col("k")
    tail = [
        _shifted(F.pmod(F.col(s) - F.col(f"own{i}"), F.lit(PRIMES[i])), back, i) for i, s in enumerate(_SUMS)
    ]
    sums_ = [F.pmod(F.col(f"head{i}") + tail[i], F.lit(PRIMES[i])) for i in range(len(PRIMES))]
    terms_ = [_shifted(F.col(t), back, i) for i, t in enumerate(_TERMS)]
    rest = rest.select(*row(F.col("place") - back, sums_, terms_))
    return cut(root.unionByName(first).unionByName(rest), "prefixes")


def _digests(ends: DataFrame) -> DataFrame:
    """``node`` and the SHA-256 of its ids, comma-joined in their order; an id list is read row by row, whatever its length."""

    def read(batches):
        key, digest = None, None
        for batch in batches:
            rows = []
            for node, conv in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist()):
                if digest is None or node != key:
                    if digest is not None:
                        rows.append((key, digest.hexdigest()))
                    key, digest = node, hashlib.sha256(str(conv).encode())
                else:
                    digest.update(f",{conv}".encode())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["node", "ends_sha256"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([digest.hexdigest()], pa.string())], ["node", "ends_sha256"])

    return map_arrow(ends.repartition("node").sortWithinPartitions("node", "conv_id"), read, "node long, ends_sha256 string")


def trie(conversations: DataFrame, group: int = 20, most: int = 4, with_texts: bool = False) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations; see :func:`prefix_rows`.

    ``conv_id`` (the smallest member), ``depth``, ``parent_conv_id`` (null at the root), ``n_convs`` (members),
    ``n_children``, ``n_leaves`` (childless nodes of its subtree, itself included), ``saved_tokens`` (over its subtree,
    members less one times the words of the last turn), ``ends_sha256`` (of the ids of members that end there), and
    with ``with_texts`` the ``role`` and ``text`` of the last turn (null at the root).

    Turns are taken in the order of ``turn`` (null first), then role and text; null roles and texts are empty. Rows
    without ``conv_id`` are of no conversation and left out; repeated rows are turns each; other columns are not used.
    An empty table has no nodes. Fingerprints that do not stand for one prefix each are an error.
    """
    if not 1 <= most <= 4:
        raise ValueError("most must be 1 to 4")
    turns, stored = stored_turns(conversations)
    rows = prefix_rows(stored, group, most)
    nodes = rows.groupBy("depth", "f").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv_id").alias("conv_id"), F.min("n_words").alias("n_words"),
        F.min("ref").alias("ref"), F.max("ref").alias("last_ref"), *[F.expr(f"{g}(p.{c})").alias(f"{g}_{c}") for g in ("min", "max") for c in ("x", "y")],
    )
    nodes = cut(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")
    if nodes.where("NOT (ref <=> last_ref) OR min_x != max_x OR min_y != max_y").take(1):
        raise RuntimeError("two different prefixes have one fingerprint")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("f.x").alias("min_x"), F.col("f.y").alias("min_y"), F.col("node").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    known = nodes.join(parents, ["depth", "min_x", "min_y"], "left")
    known = cut(known.select("node", "depth", "f", "conv_id", "n_convs", "n_words", "ref", "parent", "parent_conv_id"), "known")
    children = known.where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.count(F.lit(1)).alias("n_children"))
    saved = (F.col("n_convs") - 1) * F.col("n_words")
    counted = cut(
        known.join(children, "node", "left").select(
            "*", F.col("n_children").isNull().cast("long").alias("leaf"), saved.alias("saves")
        ).na.fill(0, ["n_children"]), "counted",
    )
    # Every node is booked on its smallest member. That member's bookings above a node are not below it; all others of all members are.
    above = running_sums(counted.select("node", "conv_id", "depth", "leaf", "saves"), "conv_id", "depth", {"leaf": None, "saves": None})
    above = above.select("node", (F.col("sum_leaf") - F.col("leaf")).alias("leaves_above"), (F.col("sum_saves") - F.col("saves")).alias("saves_above"))
    booked = counted.groupBy("conv_id").agg(F.sum("leaf").alias("leaves"), F.sum("saves").alias("all_saves"))
    totals = rows.join(booked, "conv_id").groupBy("depth", "f").agg(F.sum("leaves").alias("all_leaves"), F.sum("all_saves").alias("all_saves"))
    ending = rows.where("ends").select("conv_id", "depth", "f").join(counted.select("node", "depth", "f"), ["depth", "f"])
    out = counted.join(above, "node").join(totals, ["depth", "f"]).join(_digests(ending.select("node", "conv_id")), "node", "left")
    if with_texts:
        out = out.join(turns.select(F.col("number").alias("ref"), "role", "text"), "ref", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", (F.col("all_leaves") - F.col("leaves_above")).alias("n_leaves"),
        (F.col("all_saves") - F.col("saves_above")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), *(["role", "text"] if with_texts else []),
    )
