"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from plumbline.session import scratch_path

#: Characters of text that are worked on at once inside a task.
CHUNK_CHARS = 3_000_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once below ``spark.checkpoint.dir`` and read it back, so that lost executors cost no more than a reread."""
    path = scratch_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key() -> Column:
    """What tells a document from others: its id and its text. Rows that agree in it are repeats of one row."""
    text = F.col("text").cast("string")
    return F.struct(
        F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), F.octet_length(text).alias("bytes")
    )


def unused(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


#: Most keys (up to 40 bytes each) that are sent to every task; larger key tables are joined by a shuffle.
BROADCAST_KEYS = 1_000_000


def send_if_small(keys: DataFrame, most: int = BROADCAST_KEYS) -> DataFrame:
    """Marks a written table of keys for broadcast if it has at most ``most`` rows."""
    return F.broadcast(keys) if keys.count() <= most else keys


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    archive = os.path.join(tempfile.mkdtemp(), "plumbline_workers.zip")  # the driver serves it to the executors
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, os.path.dirname(package)))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def give_back_memory() -> None:
    """Return freed memory to the system: an idle Python worker would keep it while others run."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not in every C library
    if trim:
        trim(0)


def map_arrow(df: DataFrame, function: Callable, schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with this package at hand in the workers, which give memory back after each task."""
    ship(df.sparkSession)

    def task(batches):
        yield from function(batches)
        give_back_memory()

    return df.mapInArrow(task, schema)


def chunks(batches, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of Arrow batches that hold about ``CHUNK_CHARS`` of text each; a longer text is a slice of its own."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
        part = np.cumsum(sizes) // CHUNK_CHARS
        edges = [0, *(np.flatnonzero(np.diff(part)) + 1), batch.num_rows]
        for i, j in zip(edges, edges[1:]):
            yield batch.slice(i, j - i)


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """White-space words of many texts: offsets of each text in ``codes``, ``codes`` into the distinct words, and those words.

    White space is space and U+0009 to U+000D; ``lower`` lower-cases A to Z only. A null text has no words.
    """
    texts = pc.fill_null(texts, "")
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    encoded = lists.values.dictionary_encode()
    codes = encoded.indices.to_numpy(zero_copy_only=False)
    offsets = np.asarray(lists.offsets, dtype=np.int64)
    words = encoded.dictionary.to_numpy(zero_copy_only=False).tolist()  # far faster than to_pylist
    if "" in words:  # at the ends of a text, or the whole of an empty one
        kept = codes != words.index("")
        offsets = np.concatenate([[0], np.cumsum(kept)])[offsets]
        codes = codes[kept]
    return offsets, codes, words


def gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The pieces ``flat[starts[c] : starts[c] + lengths[c]]`` of all codes end to end, and the offset of each."""
    sizes = lengths[codes]
    ends = np.cumsum(sizes)
    at = np.concatenate([[0], ends])
    index = np.arange(at[-1]) + np.repeat(starts[codes] - at[:-1], sizes)
    return flat[index], at
