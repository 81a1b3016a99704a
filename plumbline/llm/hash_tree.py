"""Placement of rows by a hierarchical weighted hash tree: regions, racks and shards.

At every level a row draws a hash for each child and goes to the child with the smallest ``-ln(draw) / weight``; a
child's weight is the sum of the weights below it. Changing a weight moves rows only into or out of the subtrees on
the way to it. A new shard that opens a new region therefore takes rows only into itself.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.llm.common import cut

#: Shards by region and rack, with their weights.
Tree = Mapping[str, Mapping[str, Mapping[int, float]]]


def regular_tree(shards: int, per_rack: int = 2, racks: int = 2) -> Tree:
    """Shards 0, 1, ... of weight 1, filled rack by rack and region by region."""
    tree: dict[str, dict[str, dict[int, float]]] = {}
    for shard in range(shards):
        rack = shard // per_rack
        tree.setdefault(f"region{rack // racks}", {}).setdefault(f"rack{rack}", {})[shard] = 1.0
    return tree


def _draw(key: Column, place: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(F.lit(place), key), 12).cast("double")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / F.lit(float(weight))


def _choose(key: Column, places: Mapping[str, tuple[float, Column]]) -> Column:
    """The value of the place whose weighted draw is least; equal draws go to the place named first."""
    usable = [(name, weight, value) for name, (weight, value) in places.items() if weight > 0]
    if not usable:
        return F.lit(None).cast("int")
    draws = [_draw(key, name, weight) for name, weight, _ in usable]
    best = draws[0] if len(draws) == 1 else F.least(*draws)
    out = usable[-1][2]
    for draw, (_, _, value) in list(zip(draws, usable))[-2::-1]:
        out = F.when(draw == best, value).otherwise(out)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """Shard of a key; null if no shard has a positive weight."""
    regions = {}
    for region, racks in tree.items():
        in_region = {}
        for rack, shards in racks.items():
            in_rack = {f"{region}/{rack}/{s}": (w, F.lit(s).cast("int")) for s, w in shards.items()}
            in_region[f"{region}/{rack}"] = (sum(shards.values()), _choose(key, in_rack))
        regions[region] = (sum(w for w, _ in in_region.values()), _choose(key, in_region))
    return _choose(key, regions)


def place(documents: DataFrame, tree: Tree, grown: Tree | None = None) -> DataFrame:
    """``doc_id``, ``size``, ``text_crc32``, ``shard``, ``slot`` and ``grown_shard`` of every row.

    ``doc_id`` and the tree alone decide on the shard; a null ``doc_id`` is a key like any other, and repeated rows
    share a shard. ``size`` is the text's bytes in UTF-8 plus 1, a null text counting as empty. ``slot`` numbers a
    shard's rows from 0 without gaps: by input part, inside it by ``doc_id`` and checksum. ``grown_shard`` is the
    shard under ``grown`` (null without it). Other columns are not used; without rows the result is empty.
    """
    text = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    key = F.col("doc_id").cast("long")
    placed = documents.select(
        key.alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        shard_of(key, tree).alias("shard"),
        (shard_of(key, grown) if grown is not None else F.lit(None).cast("int")).alias("grown_shard"),
        F.spark_partition_id().alias("part"),
    )
    placed = cut(placed, "placed")
    local = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    sizes = placed.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("n"))
    before = W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    numbered = placed.withColumn("local", local).join(offsets, ["shard", "part"])
    return numbered.select(
        "doc_id", "size", "text_crc32", "shard", (F.col("first") + F.col("local")).cast("long").alias("slot"), "grown_shard"
    )
