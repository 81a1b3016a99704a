"""Renames and copies of files whose contents changed on the way, by the lines that two files share.

A file is the multiset of its lines. Files that share enough lines share one of their rarest, so only files around a
shared rare line are compared. Files with equal contents are one blob throughout, however many paths hold it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from plumbline.functions.text import normalize_newlines
from plumbline.operators.skew import rank_within
from plumbline.session import cut_and_count, cut_lineage

DIRECTION = ["repo", "discrepancy"]


def line_counts(blobs: DataFrame) -> DataFrame:
    """``repo``, ``blob``, ``line`` (a hash), ``m`` (how often the blob has it) of blobs (repo, blob, text); a NULL text has no lines."""
    lines = blobs.select("repo", "blob", F.explode(F.split(normalize_newlines(F.col("text")), "\n")).alias("line"))
    return lines.groupBy("repo", "blob", F.xxhash64("line").alias("line")).agg(F.count(F.lit(1)).alias("m"))


def rare_lines(lines: DataFrame, percent: int) -> DataFrame:
    """The rarest lines of each blob (and its number of lines ``n``), one of which every similar blob has among its own.

    Lines are ordered by the number of blobs in the repository that have them. What lies behind the lines kept is too
    little to reach ``percent`` of the blob alone. ``rest`` is the number of lines from this one on.
    """
    held = lines.groupBy("repo", "line").agg(F.count(F.lit(1)).alias("blobs"))
    own = W.partitionBy("repo", "blob")
    before = own.orderBy("blobs", "line").rowsBetween(W.unboundedPreceding, -1)
    ranked = lines.join(held, ["repo", "line"]).select(
        "repo", "blob", "line", F.sum("m").over(own).alias("n"), F.coalesce(F.sum("m").over(before), F.lit(0)).alias("before")
    )
    return ranked.where(F.col("before") <= F.col("n") - F.ceil(F.lit(percent) * F.col("n") / 100)).select(
        "repo", "blob", "line", "n", (F.col("n") - F.col("before")).alias("rest")
    )


def line_sets(lines: DataFrame) -> DataFrame:
    """``repo``, ``blob``, ``items``: a blob's lines as one set of numbers; the k-th of equal lines has a number of its own."""
    item = lambda k: F.when(k == 1, F.col("line")).otherwise(F.xxhash64("line", k))
    items = F.transform(F.sequence(F.lit(1).cast("bigint"), F.col("m")), item)
    return lines.groupBy("repo", "blob").agg(F.flatten(F.collect_list(items)).alias("items"))


def similar_blobs(sides: DataFrame, lines: DataFrame, percent: int = 50) -> DataFrame:
    """``repo, discrepancy, left, right, score`` of all pairs of blobs that share ``percent`` of their lines.

    ``sides`` has the blobs on either side (repo, discrepancy, blob, side: ``left`` or ``right``), ``lines`` those of
    :func:`line_counts`, best written beforehand. The score is the share
    of common lines in the longer file, in whole percents; files that differ in line ends only have 99.
    """
    sides = cut_lineage(sides.distinct(), "sides")
    used = sides.select("repo", "blob").distinct()
    lines = cut_lineage(lines.join(used, ["repo", "blob"], "left_semi"), "lines")
    rare = cut_lineage(rare_lines(lines, percent), "rare")
    asking = [F.sort_array(F.collect_set(F.when(F.col("side") == side, F.col("discrepancy")))).alias(f"{side}_in") for side in ("left", "right")]
    placed = rare.join(sides.groupBy("repo", "blob").agg(*asking), ["repo", "blob"])
    by_side = [
        placed.where(F.size(f"{side}_in") > 0).select(
            "repo", "line", F.col("blob").alias(side), F.col("n").alias(f"{side}_n"), F.col("rest").alias(f"{side}_rest"), f"{side}_in"
        )
        for side in ("left", "right")
    ]
    # The first line that two blobs share leaves no more lines to share than follow it in either. Only pairs that a direction asks for are compared.
    reachable = F.lit(percent) * F.greatest("left_n", "right_n") <= 100 * F.least("left_rest", "right_rest")
    together = by_side[0].join(by_side[1], ["repo", "line"]).where(reachable & (F.col("left") != F.col("right")) & F.arrays_overlap("left_in", "right_in"))
    longer = F.greatest("left_n", "right_n").alias("n")
    asked = cut_lineage(together.select("repo", "left", "right", longer, F.array_intersect("left_in", "right_in").alias("asked_in")).distinct(), "asked")
    sets = cut_lineage(line_sets(lines), "sets")
    scored = asked
    for side in ("left", "right"):
        scored = scored.join(sets.select("repo", F.col("blob").alias(side), F.col("items").alias(f"{side}_items")), ["repo", side])
    scored = scored.withColumn("shared", F.size(F.array_intersect("left_items", "right_items"))).where(F.lit(percent) * F.col("n") <= 100 * F.col("shared"))
    scored = scored.select("repo", F.explode("asked_in").alias("discrepancy"), "left", "right", "n", "shared")
    score = F.least(F.floor(100 * F.col("shared") / F.col("n")), F.lit(99)).cast("int")
    return scored.select(*DIRECTION, "left", "right", score.alias("score")).where(F.col("score") >= percent)


def assign(pairs: DataFrame) -> DataFrame:
    """One-to-one assignment of pairs (repo, discrepancy, left, right, score, lefts, rights), best scores first.

    ``lefts`` and ``rights`` say how many paths a blob has. Pairs are taken by score, then by blob, each for as many paths as both
    blobs have left: in rounds, every pair that is the best of both its blobs at once. The result has, for each pair taken,
    ``size`` paths, which begin after ``left_from`` and ``right_from`` paths of its blobs.
    """
    left, right = [*DIRECTION, "left"], [*DIRECTION, "right"]
    open_pairs, number = cut_and_count(pairs, F.lit(True), "pairs")
    taken, at = None, 0
    while number:
        best_left = W.partitionBy(*left).orderBy(F.desc("score"), "right")
        best_right = W.partitionBy(*right).orderBy(F.desc("score"), "left")
        ranked = open_pairs.withColumn("_l", F.row_number().over(best_left)).withColumn("_r", F.row_number().over(best_right))
        chosen = ranked.where("_l = 1 AND _r = 1").select(*DIRECTION, "left", "right", "score", F.least("lefts", "rights").alias("size"), F.lit(at).alias("round"))
        chosen = cut_lineage(chosen, "chosen")
        taken = chosen if taken is None else taken.unionByName(chosen)
        rest = open_pairs.join(chosen.select(*left, F.col("size").alias("_lt")), left, "left")
        rest = rest.join(chosen.select(*right, F.col("size").alias("_rt")), right, "left")
        rest = rest.withColumn("lefts", F.col("lefts") - F.coalesce("_lt", F.lit(0))).withColumn("rights", F.col("rights") - F.coalesce("_rt", F.lit(0)))
        open_pairs, number = cut_and_count(rest.where("lefts > 0 AND rights > 0").select(*pairs.columns), F.lit(True), "pairs")
        at += 1
    if taken is None:
        return pairs.select(*DIRECTION, "left", "right", "score", F.lit(0).cast("bigint").alias("size"), *[F.lit(0).cast("bigint").alias(c) for c in ("left_from", "right_from")])

    def earlier(key: list[str]) -> Column:
        return F.coalesce(F.sum("size").over(W.partitionBy(*key).orderBy("round").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    return taken.select(*DIRECTION, "left", "right", "score", "size", earlier(left).alias("left_from"), earlier(right).alias("right_from"))


def with_similar(renamed: DataFrame, blobs: DataFrame, percent: int = 50, copies: bool = False) -> DataFrame:
    """Turn added paths into renames ``R050`` to ``R099`` of deleted paths that share enough lines, and add ``old_path``.

    ``renamed`` is the diff after exact renames (``raw_change_type`` set), ``blobs`` the contents (repo, blob, text).
    Every deleted path serves one added path; equal blobs are served in path order, and used deletions disappear. With
    ``copies``, added paths that are left take the most similar old content of a modified path of the same diff as ``C050``
    to ``C099``; a source may serve many. Rows of unknown contents stay as they are.
    """
    renamed = cut_lineage(renamed, "renamed")  # read several times below; names and hashes only
    kind = F.col("raw_change_type")
    gone = renamed.where(kind == "D").select(*DIRECTION, "path", F.col("left_hash").alias("blob"))
    new = renamed.where(kind == "A").select(*DIRECTION, "path", F.col("right_hash").alias("blob"))

    def sided(lefts: DataFrame, rights: DataFrame) -> DataFrame:
        both = lefts.select(*DIRECTION).intersect(rights.select(*DIRECTION))
        rows = lefts.select(*DIRECTION, "blob", F.lit("left").alias("side")).unionByName(rights.select(*DIRECTION, "blob", F.lit("right").alias("side")))
        return rows.join(both, DIRECTION, "left_semi")

    def counted(rows: DataFrame, side: str) -> DataFrame:
        return rows.groupBy(*DIRECTION, F.col("blob").alias(side)).agg(F.count(F.lit(1)).alias(f"{side}s"))

    lines = cut_lineage(line_counts(blobs), "all_lines")  # texts are moved no further than here
    scored = similar_blobs(sided(gone, new), lines, percent)
    pairs = scored.join(counted(gone, "left"), [*DIRECTION, "left"]).join(counted(new, "right"), [*DIRECTION, "right"])
    taken = cut_lineage(assign(pairs.select(*DIRECTION, "left", "right", "score", "lefts", "rights")), "taken")

    def places(rows: DataFrame, side: str, name: str) -> DataFrame:
        served = taken.select(*DIRECTION, F.col(side).alias("blob")).distinct()
        ranked = rank_within(rows.join(served, [*DIRECTION, "blob"], "left_semi"), [*DIRECTION, "blob"], ["path"], "rank")
        at = ranked.withColumnRenamed("blob", side).join(taken, [*DIRECTION, side])
        inside = (F.col("rank") > F.col(f"{side}_from")) & (F.col("rank") <= F.col(f"{side}_from") + F.col("size"))
        return at.where(inside).select(*DIRECTION, "left", "right", (F.col("rank") - F.col(f"{side}_from")).alias("nth"), F.col("path").alias(name), "score")

    matched = places(gone, "left", "old_path").join(places(new, "right", "path").drop("score"), [*DIRECTION, "left", "right", "nth"])
    matched = cut_lineage(matched.select(*DIRECTION, "path", "old_path", "score"), "matched")
    used = matched.select(*DIRECTION, F.col("old_path").alias("path"), F.lit(True).alias("used"))
    rows = renamed.join(used, [*DIRECTION, "path"], "left").where(~((kind == "D") & F.coalesce("used", F.lit(False)))).drop("used")
    rows = rows.join(matched, [*DIRECTION, "path"], "left")
    if copies:
        sources = renamed.where(kind == "M").select(*DIRECTION, "path", F.col("left_hash").alias("blob"))
        left_over = new.join(matched, [*DIRECTION, "path"], "left_anti")
        found = similar_blobs(sided(sources, left_over), lines, percent)
        best = found.groupBy(*DIRECTION, F.col("right").alias("blob")).agg(F.min(F.struct(-F.col("score"), "left")).alias("b"))
        first = sources.groupBy(*DIRECTION, F.col("blob").alias("left")).agg(F.min("path").alias("copied_path"))
        named = best.select(*DIRECTION, "blob", (-F.col("b.col1")).alias("copy_score"), F.col("b.left").alias("left")).join(first, [*DIRECTION, "left"])
        copied = left_over.join(named, [*DIRECTION, "blob"]).select(*DIRECTION, "path", "copied_path", "copy_score")
        rows = rows.join(copied, [*DIRECTION, "path"], "left")
        kind = F.when(F.col("copy_score").isNotNull(), F.format_string("C%03d", "copy_score")).otherwise(kind)
        rows = rows.withColumn("old_path", F.coalesce("old_path", "copied_path"))
    code = F.when(F.col("score").isNotNull() & (F.col("code") == "A"), F.format_string("R%03d", "score")).otherwise(kind)
    return rows.withColumn("raw_change_type", code).select(*renamed.columns, "old_path")
