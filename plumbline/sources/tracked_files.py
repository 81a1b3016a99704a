"""File inventories that read a file again only when its listing changed.

Each run lists the tree by path, size and time, which opens no file, and reads only files whose listing differs from what
an earlier run read. A generation of the table holds the fingerprints of those files and a mark for each deleted one, so
what a run reads and writes grows with the changes. A generation counts once its record in ``done`` is written, the last
thing a run does; a run that was ended is repeated. A file that was rewritten with its old size and time is not noticed.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.functions.text import fingerprint
from plumbline.session import cut_lineage
from plumbline.sources.files import relative

ROWS = (
    "path string, length bigint, modified timestamp, sha256 string, md5_base64 string, size_bytes bigint,"
    " compare_hash string, is_text boolean, gone boolean"
)
#: Files with an old time are read by name, so many names at once.
NAMED_AT_ONCE = 1000


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], schema)


def _finished(spark: SparkSession, base: str) -> int:
    try:
        done = spark.read.schema("gen int").option("recursiveFileLookup", True).parquet(f"{base}/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0
    last = done.agg(F.max("gen")).first()[0]
    return 0 if last is None else last + 1


def _latest(spark: SparkSession, base: str, before: int) -> DataFrame:
    rows = _read(spark, f"{base}/rows", f"{ROWS}, gen int").where(F.col("gen") < before)
    facts = [c for c in rows.columns if c not in ("path", "gen")]
    newest = rows.groupBy("path").agg(F.max_by(F.struct(*facts), "gen").alias("f"))
    return newest.select("path", "f.*").where(~F.col("gone")).drop("gone")


def read_tracked(spark: SparkSession, base: str) -> DataFrame:
    """The files of the last finished run: ``path, length, modified`` and their fingerprints."""
    return _latest(spark, base, _finished(spark, base))


def _binary(spark: SparkSession, glob: str | None):
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return reader if glob is None else reader.option("pathGlobFilter", glob)


def _kept(files: DataFrame) -> DataFrame:
    return files.where(~F.col("path").rlike(r"(^|/)\.gitkeep$"))


def _chunks(names: Iterator, size: int) -> Iterator[list[str]]:
    while chunk := [row[0] for row in islice(names, size)]:
        yield chunk


def track_files(spark: SparkSession, root: str, base: str, glob: str | None = None) -> int:
    """Bring the inventory below ``base`` up to the files below ``root``; returns the number of the generation written.

    Files newer than all that were read before are picked by time, which the scan checks before it opens a file. Changed
    files with an older time (copied with their times) are read by name, some at once. A file that vanishes between
    listing and reading ends the run; it is repeated then. Placeholder files are left out; an empty folder empties the
    inventory.
    """
    gen = _finished(spark, base)
    held = cut_lineage(_latest(spark, base, gen), "held")
    listed = _kept(_binary(spark, glob).load(root)).select(F.col("path").alias("uri"), relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"))
    listed = cut_lineage(listed, "listed")
    since = held.agg(F.max("modified")).first()[0]
    changed = listed.join(held, ["path", "length", "modified"], "left_anti")
    target = f"{base}/rows/gen={gen}"

    def store(files: DataFrame, mode: str = "append") -> None:
        facts = files.select(relative(F.col("path"), root).alias("path"), "length", F.col("modificationTime").alias("modified"), "content")
        hashed = facts.select("path", "length", "modified", fingerprint(F.col("content"), F.col("path")).alias("f"))
        hashed.select("path", "length", "modified", "f.*", F.lit(False).alias("gone")).write.mode(mode).parquet(target)

    gone = held.join(listed, "path", "left_anti").withColumn("gone", F.lit(True))
    gone.write.mode("overwrite").parquet(target)
    if since is None:
        store(_kept(_binary(spark, glob).load(root)))
    else:
        newer = F.col("modificationTime") > F.lit(since)
        store(_kept(_binary(spark, glob).load(root)).where(newer))
        older = changed.where(F.col("modified") <= F.lit(since)).select("uri")
        for names in _chunks(older.toLocalIterator(), NAMED_AT_ONCE):
            store(spark.read.format("binaryFile").load(names))
    spark.range(1).select(F.lit(gen).cast("int").alias("gen")).write.mode("overwrite").parquet(f"{base}/done/g{gen}")
    return gen
