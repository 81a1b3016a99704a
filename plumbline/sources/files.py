"""File trees and texts as tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.labels import in_compared_areas, norm_path
from plumbline.functions.text import fingerprint


def relative(path: Column, root: str) -> Column:
    """Part of a file URI below ``root``."""
    folder = root.rstrip("/").split(":", 1)[-1].lstrip("/")
    return F.regexp_replace(path, rf"^[^:]*:?/*\Q{folder}\E/+", "")


def scan_tree(spark: SparkSession, root: str) -> DataFrame:
    """``path, length, content`` of all files below ``root`` but placeholder files.

    The source splits by file; the content stays out of every shuffle when the
    next step is :func:`file_inventory`.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    kept = files.where(~files.path.rlike(r"(^|/)\.gitkeep$"))
    return kept.select(relative(F.col("path"), root).alias("path"), "length", "content")


def scan_text(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path, text`` of the files whose name matches ``glob``, one row per file.

    Files are read as bytes, since a text scan drops the last line end; bytes
    that are no UTF-8 become replacement characters.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob)
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return reader.load(root).select(relative(F.col("path"), root).alias("path"), text.alias("text"))


def file_inventory(files: DataFrame) -> DataFrame:
    """Fingerprint per file of the compared areas; content is dropped before any shuffle."""
    rest = [c for c in files.columns if c not in ("content", "length")]
    return (
        files.where(in_compared_areas(F.col("path")))
        .select(*rest, fingerprint(F.col("content"), F.col("path")).alias("f"))
        .select(*rest, "f.*")
    )


def deployed_inventory(files: DataFrame) -> DataFrame:
    """As :func:`file_inventory`, after repairing doubled area folders.

    Where a repaired path meets an existing one, the later of the stored paths wins.
    """
    repaired = files.withColumn("_stored", F.col("path")).withColumn("path", norm_path(F.col("path")))
    inventory = file_inventory(repaired)
    keys = [c for c in inventory.columns if c in ("product", "path")]
    facts = [c for c in inventory.columns if c not in keys and c != "_stored"]
    picked = inventory.groupBy(*keys).agg(F.max_by(F.struct(*facts), "_stored").alias("f"))
    return picked.select(*keys, "f.*")
