"""Stored trees with a hash per folder, and diffs that read no folder both sides have in common.

A tree is kept as the entries of its folders: files with their blob hash, folders with a hash over all their entries.
Equal folders have equal hashes, so two trees are compared from the root down, and only folders whose hashes differ are
looked into. Entries lie in partitions by depth and by a bucket of the folder; a step reads the buckets of its folders.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.constants import DIRECT, DIRECTIONS, MERGE_BASE
from plumbline.operators.branches import base_slot
from plumbline.session import cut_and_count, cut_lineage

ENTRIES = "repo string, tree string, folder string, name string, is_folder boolean, hash string, depth int, bucket int"
#: The depth of the entry that stands for a whole tree.
ROOT = -1
BUCKETS = 64


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("repo", "folder"), F.lit(buckets)).cast("int")


def _split(path: Column) -> list[Column]:
    """Folder (with its last slash) and name of a path; a folder's own last slash counts for nothing."""
    bare = F.regexp_replace(path, "/$", "")
    return [F.regexp_extract(bare, r"^((?s:.*)/)?[^/]*$", 1).alias("folder"), F.regexp_extract(bare, r"([^/]*)$", 1).alias("name")]


def _depth(folder: str) -> Column:
    return F.length(F.regexp_replace(F.col(folder), "[^/]", ""))


def folder_hashes(entries: DataFrame) -> DataFrame:
    """The folders of one depth as entries of the folders above them.

    Four sums of hash words combine on the map side, so a folder of any size is gathered nowhere.
    """
    word = F.md5(F.concat_ws("\0", "name", F.col("is_folder").cast("string"), "hash"))
    parts = [F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    summed = entries.groupBy("repo", "tree", F.col("folder").alias("path")).agg(*[F.sum(p).alias(f"w{i}") for i, p in enumerate(parts)])
    return summed.select("repo", "tree", *_split(F.col("path")), F.lit(True).alias("is_folder"), F.md5(F.concat_ws("-", *[f"w{i}" for i in range(4)])).alias("hash"))


def store_trees(files: DataFrame, base: str, buckets: int = BUCKETS) -> None:
    """Add the trees of ``files`` (repo, tree, path, blob_hash) to the table below ``base``, from the deepest folders up.

    ``tree`` names a version for good, such as the commit at a branch's tip. A tree's root is written last; a run that
    was ended before is repeated, and entries it left twice count once. Files without a hash are left out.
    """
    held = files.where(F.col("blob_hash").isNotNull()).groupBy("repo", "tree", "path").agg(F.max("blob_hash").alias("hash"))
    bare = F.regexp_extract("path", r"^((?s:.*)/)?[^/]*$", 1)  # a path that ends in a slash is a nameless file
    rows = held.select("repo", "tree", bare.alias("folder"), F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), F.lit(False).alias("is_folder"), "hash")
    rows = cut_lineage(rows.withColumn("depth", _depth("folder")), "files")
    deepest = rows.agg(F.max("depth")).first()[0]
    below = None
    for depth in range(-1 if deepest is None else deepest, ROOT, -1):
        entries = rows.where(F.col("depth") == depth).drop("depth")
        if below is not None:
            entries = entries.unionByName(below)
        entries = cut_lineage(entries, "entries")
        placed = entries.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket").sortWithinPartitions("bucket", "repo", "folder")
        placed.write.mode("append").partitionBy("bucket").parquet(f"{base}/depth={depth}")
        below = folder_hashes(entries)
    if below is not None:
        below.withColumn("bucket", F.lit(0)).write.mode("append").partitionBy("bucket").parquet(f"{base}/depth={ROOT}")


def read_trees(spark: SparkSession, base: str) -> DataFrame:
    """Entries of all stored trees; empty before the first is stored."""
    try:
        return spark.read.schema(ENTRIES).option("basePath", base).parquet(base)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], ENTRIES)


def missing_trees(wanted: DataFrame, trees: DataFrame) -> DataFrame:
    """The trees of ``wanted`` (repo, tree) that are not stored yet."""
    roots = trees.where(F.col("depth") == ROOT).select("repo", "tree")
    return wanted.select("repo", "tree").distinct().join(roots, ["repo", "tree"], "left_anti")


def _sides(rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Entries that differ between the left and the right tree, with both hashes; ``side`` says whose entry a row is."""
    pick = lambda side: F.max(F.when(F.col("side") == side, F.col("hash"))).alias(f"{side}_hash")
    both = rows.groupBy(*key).agg(pick("left"), pick("right"), F.max("left_tree").alias("left_tree"), F.max("right_tree").alias("right_tree"))
    return both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))


def _of_either(pairs: DataFrame, entries: DataFrame, on: Sequence[str], columns: Sequence[str]) -> DataFrame:
    found = []
    for side in ("left", "right"):
        own = entries.select(*on, F.col("tree").alias(f"{side}_tree"), *columns)
        found.append(pairs.join(own, [*on, f"{side}_tree"]).withColumn("side", F.lit(side)))
    return found[0].unionByName(found[1])


def stored_diff(trees: DataFrame, pairs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """Files that differ: ``repo, discrepancy, path, code, left_hash, right_hash`` with codes A, D and M.

    ``pairs`` has the trees to compare (repo, discrepancy, left_tree, right_tree); a tree that is not stored, or NULL, is
    empty. Each step compares the entries of the folders that differ one level higher, and reads only their buckets.
    """
    named = pairs.select("repo", "discrepancy", F.coalesce("left_tree", F.lit("")).alias("left_tree"), F.coalesce("right_tree", F.lit("")).alias("right_tree")).distinct()
    roots = trees.where(F.col("depth") == ROOT)
    folders = _sides(_of_either(named, roots, ["repo"], ["hash"]), ["repo", "discrepancy"])
    folders = folders.select("repo", "discrepancy", "left_tree", "right_tree", F.lit("").alias("folder"))
    folders, number = cut_and_count(folders, F.lit(True), "folders")
    code = F.when(F.col("left_hash").isNull(), "A").when(F.col("right_hash").isNull(), "D").otherwise("M")
    path = F.concat("folder", "name")
    depth, found = 0, []
    while number:
        at = [r[0] for r in folders.select(_bucket(buckets).alias("bucket")).distinct().collect()]  # a few small numbers
        entries = trees.where((F.col("depth") == depth) & F.col("bucket").isin(at))
        rows = _of_either(folders, entries, ["repo", "folder"], ["name", "is_folder", "hash"])
        differ = cut_lineage(_sides(rows, ["repo", "discrepancy", "folder", "name", "is_folder"]), "differ")
        found.append(differ.where("NOT is_folder").select("repo", "discrepancy", path.alias("path"), code.alias("code"), "left_hash", "right_hash"))
        down = differ.where("is_folder").select("repo", "discrepancy", "left_tree", "right_tree", F.concat(path, F.lit("/")).alias("folder"))
        folders, number = cut_and_count(down, F.lit(True), "folders")
        depth += 1
    if not found:
        none = F.lit(None).cast("string")
        return named.where("false").select("repo", "discrepancy", none.alias("path"), none.alias("code"), none.alias("left_hash"), none.alias("right_hash"))
    out = found[0]
    for rows in found[1:]:
        out = out.unionByName(rows)
    return out


def branch_trees(branch_files: DataFrame, base_files: DataFrame | None = None) -> DataFrame:
    """Files of all branches, and of the merge bases, as trees named after them (``base_<a>_<b>`` by the sorted pair)."""
    rows = branch_files.select("repo", F.col("branch").alias("tree"), "path", "blob_hash")
    if base_files is None:
        return rows
    ordered = F.concat_ws("_", F.lit("base"), F.least("left_name", "right_name"), F.greatest("left_name", "right_name"))
    return rows.unionByName(base_files.select("repo", ordered.alias("tree"), "path", "blob_hash"))


def tree_pairs(repos: DataFrame, mode: str = MERGE_BASE) -> DataFrame:
    """The two trees of each direction of each repository, by the names of :func:`branch_trees`."""
    pairs = [
        F.struct(F.lit(name).alias("discrepancy"), F.lit(left if mode == DIRECT else base_slot(left, right)).alias("left_tree"), F.lit(right).alias("right_tree"))
        for name, left, right in DIRECTIONS
    ]
    return repos.select("repo", F.explode(F.array(*pairs)).alias("p")).select("repo", "p.*")
