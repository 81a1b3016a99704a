"""Benchmark passages in documents, found by hashed word windows.

The word grams of the benchmark's windows are a set of hashes, broadcast if the number of windows allows. Documents
are scanned gram by gram at a stride that meets every window, and documents with a known gram are read again and
compared window by window, word by word.
"""

from __future__ import annotations

import string
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import cut, row_key, send_if_small, unused

WINDOW = 10
#: Windows of a benchmark up to which they and their gram hashes are broadcast (about 0.2 KB each); more are joined by a shuffle.
BROADCAST_WINDOWS = 200_000

#: Everything but digits, lower-case ASCII letters and non-ASCII characters separates words.
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text, A to Z lower-cased; empty for a null text."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    ascii_only = F.octet_length(text) == F.char_length(text)
    lower = F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, string.ascii_uppercase, string.ascii_lowercase))
    return F.filter(F.split(lower, SEPARATORS), lambda w: w != "")


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once, so that reading one element of an array costs the same wherever it stands."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _words_at(w: Column, first: Column, length: int) -> Column:
    return F.array(*[F.get(w, first + k) for k in range(length)])


def _gram(hashes: Column, first: Column | int, size: int) -> Column:
    """Hash of ``size`` words from place ``first`` on, from the hashes of all words."""
    return F.xxhash64(*[F.get(hashes, F.lit(first) + k) for k in range(size)])


def _hashes(w: Column) -> Column:
    return F.transform(w, lambda x: F.xxhash64(x))


def _grams(w: Column, size: int, stride: int) -> Column:
    """Hashes of the grams of ``size`` words that begin at multiples of ``stride``."""
    starts = lambda h: F.sequence(F.lit(0), F.size(h) - size, F.lit(stride))
    found = _once(_hashes(w), lambda h: F.transform(starts(h), lambda i: _gram(h, i, size)))
    return F.when(F.size(w) >= size, found).otherwise(F.array().cast("array<bigint>"))


def item_windows(benchmark: DataFrame, window: int) -> DataFrame:
    """Distinct ``item_id``, ``length``, ``window`` (its words) of all items; a shorter item is one window."""
    tokens = benchmark.select(F.col("item_id"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    every = _once(F.col("w"), lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - window), lambda i: _words_at(w, i, window)))
    windows = F.when(F.size("w") >= window, every).otherwise(F.array("w"))
    return tokens.select("item_id", F.explode(windows).alias("window")).select("item_id", F.size("window").alias("length"), "window").distinct()


def gram_size(length: int) -> tuple[int, int]:
    """Size and stride of the word grams that are probed for windows of ``length`` words.

    Any ``length`` consecutive words of a text hold one whole gram that starts at a multiple of the stride.
    """
    size = (length + 1) // 2
    return size, length - size + 1


def gram_hashes(windows: DataFrame, lengths: list[int]) -> DataFrame:
    """Distinct hashes of all word grams inside the windows."""
    parts = []
    for length in lengths:
        size, _ = gram_size(length)
        every = _once(_hashes(F.col("window")), lambda h: F.array(*[_gram(h, i, size) for i in range(length - size + 1)]))
        parts.append(windows.where(F.col("length") == length).select(F.explode(every).alias("gram")))
    return _all(parts).distinct()


def scanned(documents: DataFrame, grams: DataFrame, lengths: list[int]) -> DataFrame:
    """One row with ``n_words`` for each document (``gram`` null), and one for each gram of it that is known."""
    row = row_key()
    tokens = documents.select(row.alias("row"), words(F.col("text")).alias("w"))
    tokens = tokens.select("row", F.size("w").cast("long").alias("n_words"), "w")  # else each gram's row would carry all words
    probes = [F.array(F.lit(None).cast("long"))]
    for size, stride in sorted({gram_size(n) for n in lengths}):
        probes.append(_grams(F.col("w"), size, stride))
    exploded = tokens.select("row", "n_words", F.explode(F.concat(*probes)).alias("gram"))
    joined = exploded.join(grams.select("gram", F.lit(True).alias("known")), "gram", "left")
    return joined.where("gram IS NULL OR known").select("row", "n_words", "gram")


def _by_length(column: str, lengths: list[int], value: Callable[[int], Column]) -> Column:
    out = F.when(F.col(column) == lengths[0], value(lengths[0]))
    for n in lengths[1:]:
        out = out.when(F.col(column) == n, value(n))
    return out


def _all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for other in frames[1:]:
        out = out.unionByName(other)
    return out


def find_passages(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_hit``, ``n_items``, ``items`` and ``spans`` of every row of ``documents``.

    A window is ``window`` consecutive words of an item; an item with fewer words, but not none, is one window. A
    document word inside any occurrence of a window is hit. ``items`` are the ids of items with occurring windows,
    sorted as strings; an item without id hits words but is not listed. ``spans`` are the occurrences as structs of
    first word (from 0) and length. Null texts have no words; rows that repeat each get their result. Columns other
    than ``doc_id`` and ``text``, and ``item_id`` and ``text`` of the benchmark, are not used.
    """
    return _passages(documents, benchmark, window).drop("row")


def _passages(documents: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """The columns of :func:`find_passages` and ``row``, the key of each row."""
    windows = cut(item_windows(benchmark, window), "windows")
    lengths = [r[0] for r in windows.select("length").distinct().sort("length").collect()]  # at most ``window`` rows
    if not lengths:
        none = F.array().cast("array<string>")
        return documents.select(
            row_key().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.size(words(F.col("text"))).cast("long").alias("n_words"),
            F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"),
            none.alias("items"), F.array().cast("array<struct<first:int,length:int>>").alias("spans"),
        )
    grams = cut(gram_hashes(windows, lengths), "grams")
    small = windows.count() <= BROADCAST_WINDOWS
    scan = cut(scanned(documents, F.broadcast(grams) if small else grams, lengths), "scan")
    hit_rows = send_if_small(cut(scan.where("gram IS NOT NULL").select("row").distinct(), "hits"))
    suspects = documents.select(row_key().alias("row"), "text").join(hit_rows, "row", "left_semi").dropDuplicates(["row"])
    suspects = cut(suspects.select("row", words(F.col("text")).alias("w")), "suspects")
    hashed = windows.withColumn("hash", _by_length("length", lengths, lambda n: _once(_hashes(F.col("window")), lambda h: _gram(h, 0, n))))
    known = hashed.groupBy("length", "hash", "window").agg(F.collect_set(F.col("item_id").cast("string")).alias("ids"))
    hashes = hashed.select("length", "hash").distinct()
    if small:
        known, hashes = F.broadcast(known), F.broadcast(hashes)
    # Places whose hash is known, without words; words are read at these places alone.
    at = _all([suspects.select("row", F.lit(n).alias("length"), F.posexplode(_grams(F.col("w"), n, 1)).alias("first", "hash")) for n in lengths])
    places = at.join(hashes, ["length", "hash"]).groupBy("row", "length").agg(F.collect_list(F.struct("first", "hash")).alias("places"))
    places = places.withColumnRenamed("row", "of")
    both = suspects.join(places, F.col("row").eqNullSafe(F.col("of"))).drop("of")
    read = lambda n: _once(F.col("w"), lambda w: F.transform("places", lambda p: F.struct(p["first"].alias("first"), p["hash"].alias("hash"), _words_at(w, p["first"], n).alias("found"))))
    at = both.select("row", "length", F.explode(_by_length("length", lengths, read)).alias("p")).select("row", "length", "p.*")
    exact = at.join(known, (at["length"] == known["length"]) & (at["hash"] == known["hash"]) & (at["found"] == known["window"]))
    found = exact.select("row", "first", at["length"].alias("length"), "ids")
    per_row = found.groupBy("row").agg(
        F.array_sort(F.collect_set(F.struct("first", "length"))).alias("spans"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("ids")))).alias("items"),
    )
    words_hit = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["first"], s["first"] + s["length"] - 1))))
    per_row = per_row.select("row", "spans", "items", F.size(words_hit).cast("long").alias("n_hit"))
    counts = scan.where("gram IS NULL").select("row", "n_words")
    same = F.col("c.row").eqNullSafe(F.col("p.row"))
    joined = counts.alias("c").join(per_row.alias("p"), same, "left")
    return joined.select(
        F.col("c.row").alias("row"),
        F.col("c.row.doc_id").alias("doc_id"),
        "n_words",
        F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce("spans", F.array().cast("array<struct<first:int,length:int>>")).alias("spans"),
    )


def clean_documents(documents: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of ``documents``, with all their columns, that hold no benchmark window.

    Rows without text, or of an empty benchmark, stay; repeated rows stay or go together, rows of one id each by its text.
    """
    hit = unused(documents, "hit")
    found = _passages(documents, benchmark, window).where("n_hit > 0").select(F.col("row").alias(hit)).distinct()
    found = send_if_small(cut(found, "hits"))
    return documents.join(found, row_key() == F.col(hit), "left_anti")
