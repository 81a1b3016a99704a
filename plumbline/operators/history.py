"""Commit history as tables: ancestry, merge bases, branch gaps, file histories.

Inputs: ``commit_parents`` (repo, sha, parent_sha, parent_index), ``tips``
(repo, branch, sha), ``commits`` (repo, sha, …), ``commit_files`` (repo, sha, path, …).
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.constants import BRANCHES
from plumbline.functions.hunks import (
    REMOVED, asked_parts, changed_ranges, excerpt, excerpted_lines, lines_of, outline, outlined_lines, read_hash,
)
from plumbline.functions.wanted import (
    MOST_NUMBERS, SEGMENTS, content_number, fill_segment, line_numbers, segment, stands, words_for,
)
from plumbline.session import cut_and_count, cut_lineage, shuffles_freed, ship

MAX_ROUNDS = 40  # a line of a trillion commits


def descendants(nodes: DataFrame, main: DataFrame) -> DataFrame:
    """Number of commits, itself included, that come down to each commit by first parents.

    In round k a commit knows its ancestor 2**k steps up and how many commits
    are fewer than 2**k steps below it; the counts below that many steps up are
    added to the ancestor, and the step doubles. Only commits that still climb
    are carried into the next round; what a commit at its end gains later is a
    row of its own, and all are summed at last.
    """
    climbs = F.col("up").isNotNull()
    step = nodes.join(main, ["repo", "sha"], "left").select(
        "repo", "sha", F.col("parent_sha").alias("up"), F.lit(1).cast("bigint").alias("size")
    )
    ended = []
    for _ in range(MAX_ROUNDS):
        state, active = cut_and_count(step, climbs, "climbing")
        ended.append(state.where(~climbs).select("repo", "sha", "size"))
        if active == 0:
            return reduce(DataFrame.unionByName, ended).groupBy("repo", "sha").agg(F.sum("size").alias("size"))
        climbing = state.where(climbs)
        gained = climbing.groupBy("repo", F.col("up").alias("sha")).agg(F.sum("size").alias("size"))
        ahead = climbing.select("repo", F.col("sha").alias("up"), F.col("up").alias("next"))
        moved = climbing.join(ahead, ["repo", "up"], "left").select("repo", "sha", F.col("next").alias("up"), "size")
        rows = moved.unionByName(gained.withColumn("up", F.lit(None).cast("string")))
        step = rows.groupBy("repo", "sha").agg(F.max("up").alias("up"), F.sum("size").alias("size"))
    raise ValueError("the parent table has a cycle")


def chains(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """Split the graph into straight chains: ``repo, sha, chain, pos``.

    Each commit continues in its first parent, and each parent in the child that
    carries the most commits, so a chain is a line; ``chain`` is its oldest
    commit and ``pos`` the distance to it. Following the larger side keeps a
    main line in one piece: no path by first parents meets more chains than the
    logarithm of the number of commits. Distances double per round, so a history
    of a million commits in a row takes twenty rounds, not a million. Commits
    that still jump have distinct targets, which keeps these rounds free of hot
    keys.
    """
    edges = parents.where(F.col("parent_sha").isNotNull())
    main = cut_lineage(edges.groupBy("repo", "sha").agg(F.min_by("parent_sha", "parent_index").alias("parent_sha")), "main")
    nodes = cut_lineage(
        parents.select("repo", "sha")
        .unionByName(edges.select("repo", F.col("parent_sha").alias("sha")))
        .unionByName(tips.select("repo", "sha"))
        .where(F.col("sha").isNotNull())
        .distinct(),
        "nodes",
    )
    sized = main.join(descendants(nodes, main), ["repo", "sha"])
    links = sized.groupBy("repo", "parent_sha").agg(F.max_by("sha", F.struct("size", "sha")).alias("sha"))
    linked = F.col("parent_sha").isNotNull()
    state, active = cut_and_count(
        nodes.join(links, ["repo", "sha"], "left").select(
            "repo",
            "sha",
            F.coalesce("parent_sha", "sha").alias("chain"),
            F.when(linked, F.lit(1)).otherwise(F.lit(0)).cast("bigint").alias("pos"),
        ),
        F.col("pos") == 1,
    )
    for round_ in range(MAX_ROUNDS):
        if active == 0:
            return state
        reach = 1 << round_
        jumping = state.where(F.col("pos") == reach)
        ahead = state.select("repo", F.col("sha").alias("chain"), F.col("chain").alias("next"), F.col("pos").alias("more"))
        jumped = jumping.join(ahead, ["repo", "chain"]).select(
            "repo", "sha", F.col("next").alias("chain"), (F.col("pos") + F.col("more")).alias("pos")
        )
        state, active = cut_and_count(
            state.where(F.col("pos") != reach).unionByName(jumped), F.col("pos") == 2 * reach
        )
    raise ValueError("the parent table has a cycle")


def reachable(parents: DataFrame, tips: DataFrame) -> DataFrame:
    """Commits reachable from every branch tip: ``repo, branch, sha``.

    The search runs over chains, not commits: what a branch reaches of a chain
    is a lower part of it, so one row (repo, branch, chain, highest position)
    stands for any number of commits. A round follows the edges that leave the
    newly reached parts; the number of rounds is the depth of side branches.
    """
    parents = cut_lineage(parents.select("repo", "sha", "parent_sha", "parent_index"), "parents")  # both are read several times below
    tips = cut_lineage(tips.select("repo", "branch", "sha"), "tips")
    placed = chains(parents, tips)
    edges = parents.where(F.col("parent_sha").isNotNull()).select("repo", "sha", "parent_sha").distinct()
    at = placed.select("repo", "sha", F.col("chain").alias("from_chain"), F.col("pos").alias("from_pos"))
    to = placed.select("repo", F.col("sha").alias("parent_sha"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    crossing = cut_lineage(
        edges.join(at, ["repo", "sha"])
        .join(to, ["repo", "parent_sha"])
        .where(F.col("from_chain") != F.col("to_chain"))
        .select("repo", "from_chain", "from_pos", "to_chain", "to_pos")
    )
    key = ["repo", "branch", "chain"]
    start = tips.where(F.col("sha").isNotNull()).join(placed, ["repo", "sha"])
    none = F.lit(None).cast("bigint")
    grown = F.col("before").isNull() | (F.col("top") > F.col("before"))
    state, active = cut_and_count(
        start.groupBy(*key).agg(F.max("pos").alias("top")).withColumn("before", none), grown
    )
    while active > 0:
        steps = (
            state.where(grown)
            .withColumnRenamed("chain", "from_chain")
            .join(crossing, ["repo", "from_chain"])
            .where((F.col("from_pos") <= F.col("top")) & (F.col("from_pos") > F.coalesce("before", F.lit(-1))))
            .select("repo", "branch", F.col("to_chain").alias("chain"), F.col("to_pos").alias("top"), none.alias("before"))
        )
        known = state.select(*key, "top", F.col("top").alias("before"))
        state, active = cut_and_count(
            known.unionByName(steps).groupBy(*key).agg(F.max("top").alias("top"), F.max("before").alias("before")), grown
        )
    reached = state.select(*key, "top")
    return (
        placed.join(reached, ["repo", "chain"])
        .where(F.col("pos") <= F.col("top"))
        .select("repo", "branch", "sha")
    )


def branch_flags(closure: DataFrame) -> DataFrame:
    """One row per commit with a flag per branch that reaches it."""
    flags = [F.max(F.col("branch") == b).alias(f"on_{b}") for b in BRANCHES]
    return closure.groupBy("repo", "sha").agg(*flags)


def on(branch: str) -> Column:
    return F.col(f"on_{branch}")


def merge_bases(closure: DataFrame, parents: DataFrame) -> DataFrame:
    """One best common ancestor per repository and unordered branch pair.

    The common commits of two branches contain all their ancestors, so the best
    ones are those that no common commit has as a direct parent: one anti join.
    """
    pairs = [(a, b) for i, a in enumerate(BRANCHES) for b in BRANCHES[i + 1 :]]
    both = F.filter(
        F.array(*[F.when(on(a) & on(b), F.struct(F.lit(a).alias("left_name"), F.lit(b).alias("right_name"))) for a, b in pairs]),
        lambda p: p.isNotNull(),
    )
    common = branch_flags(closure).select("repo", "sha", F.explode(both).alias("pair")).select("repo", "sha", "pair.*")
    edges = parents.where(F.col("parent_sha").isNotNull()).select("repo", "sha", "parent_sha")
    inner = common.join(edges, ["repo", "sha"]).select("repo", "left_name", "right_name", F.col("parent_sha").alias("sha"))
    best = common.join(inner, ["repo", "left_name", "right_name", "sha"], "left_anti")
    return best.groupBy("repo", "left_name", "right_name").agg(F.min("sha").alias("base_sha"))


def ahead_behind(closure: DataFrame, source: str, target: str) -> DataFrame:
    """Commits only on the source and only on the target branch, per repository."""
    flags = branch_flags(closure.where(F.col("branch").isin(source, target)))
    return flags.groupBy("repo").agg(
        F.count_if(on(source) & ~on(target)).alias("source_commits_not_in_target"),
        F.count_if(on(target) & ~on(source)).alias("target_commits_not_in_source"),
    )


def waiting(closure: DataFrame, commits: DataFrame, source: str, target: str, as_of: datetime) -> DataFrame:
    """Oldest and newest commit waiting on the source branch, and whole days since the oldest."""
    flags = branch_flags(closure.where(F.col("branch").isin(source, target)))
    missing = flags.where(on(source) & ~on(target)).select("repo", "sha")
    dated = missing.join(commits.select("repo", "sha", "authored_at"), ["repo", "sha"])
    oldest = F.min("authored_at")
    seconds = F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(oldest)
    return dated.groupBy("repo").agg(
        oldest.alias("oldest_waiting"),
        F.max("authored_at").alias("newest_waiting"),
        F.floor(seconds / 86400).alias("waiting_days"),
    )


def last_commits(tips: DataFrame, commits: DataFrame) -> DataFrame:
    """Tip commit of each branch with its date."""
    dated = commits.select("repo", "sha", F.col("authored_at").alias("last_commit_date"))
    return tips.join(dated, ["repo", "sha"]).select("repo", "branch", F.col("sha").alias("last_commit"), "last_commit_date")


def branch_gap(
    repos: DataFrame, tips: DataFrame, closure: DataFrame, commits: DataFrame, source: str, target: str, as_of: datetime
) -> DataFrame:
    """How far a target branch is behind its source, one row per repository."""
    last = last_commits(tips, commits)

    def side(branch: str, name: str) -> DataFrame:
        return last.where(F.col("branch") == branch).select(
            "repo", F.col("last_commit").alias(f"last_{name}_commit"), F.col("last_commit_date").alias(f"last_{name}_commit_date")
        )

    rows = (
        repos.join(side(source, "source"), "repo", "left")
        .join(side(target, "target"), "repo", "left")
        .join(ahead_behind(closure, source, target), "repo", "left")
        .join(waiting(closure, commits, source, target, as_of), "repo", "left")
    )
    no_source, no_target = F.col("last_source_commit").isNull(), F.col("last_target_commit").isNull()
    known = ~(no_source | no_target)

    def when_known(value: Column) -> Column:
        return F.when(known, value)

    ahead = F.col("source_commits_not_in_target")
    status = (
        F.when(no_source, F.lit(f"no origin/{source}"))
        .when(no_target, F.lit(f"no origin/{target}"))
        .when(ahead == 0, F.lit("in sync"))
        .otherwise(F.lit("waiting for sync"))
    )
    present = F.when(no_source, F.lit("unknown")).when(no_target, F.lit("missing")).otherwise(F.lit("yes"))
    return rows.select(
        "repo",
        F.lit(source).alias("source_branch"),
        F.lit(target).alias("target_branch"),
        present.alias("target_branch_present"),
        when_known(ahead).alias("source_commits_not_in_target"),
        when_known(F.col("target_commits_not_in_source")).alias("target_commits_not_in_source"),
        when_known(F.col("oldest_waiting")).alias("oldest_source_commit_not_in_target"),
        when_known(F.coalesce("waiting_days", F.lit(0))).alias("waiting_days"),
        F.when(~no_source, F.col("last_target_commit")).alias("last_target_commit"),
        F.when(~no_source, F.col("last_target_commit_date")).alias("last_target_commit_date"),
        "last_source_commit",
        "last_source_commit_date",
        status.alias("status"),
    )


def file_meta(closure: DataFrame, commits: DataFrame, commit_files: DataFrame) -> DataFrame:
    """Last change, last add and first add of each path on each branch.

    A touched file is moved once by its path, with the branches that reach its
    commit; they are unfolded and compared where the rows of the path are.
    """
    facts = ["sha", "authored_at", "author", "author_email", "message"]
    touched = commit_files.select("repo", "sha", "path", "change_code").join(
        commits.select("repo", *facts), ["repo", "sha"]
    )
    branches = closure.groupBy("repo", "sha").agg(F.collect_list(F.struct("branch")).alias("branches"))
    moved = touched.join(branches, ["repo", "sha"]).repartition("repo", "path")
    on_branch = moved.withColumn("at", F.explode("branches")).withColumn("branch", F.col("at.branch")).drop("branches", "at")
    commit = F.struct(*facts)
    age = F.struct("authored_at", "sha")
    added = F.col("change_code") == "A"
    grouped = on_branch.groupBy("repo", "branch", "path").agg(
        F.max_by(commit, age).alias("last"),
        F.max_by(commit, F.when(added, age)).alias("created"),
        F.min_by(commit, F.when(added, age)).alias("first"),
    )

    def spread(struct: str, prefix: str) -> list[Column]:
        names = {"sha": "commit", "authored_at": "at", "author": "author", "author_email": "author_email", "message": "message"}
        return [F.col(f"{struct}.{old}").alias(f"{prefix}_{new}") for old, new in names.items()]

    return grouped.select(
        "repo", "branch", "path", *spread("created", "created"), *spread("last", "last_change"),
        F.col("first.sha").alias("first_added_commit"),
    )


def patch_fingerprint(diffs: DataFrame) -> DataFrame:
    """Order-free fingerprint per commit of its file diffs (repo, sha, path, diff_hash).

    Four sums of hash words combine on the map side, so a commit that touches
    any number of files is never gathered; equal diff sets give equal sums.
    """
    word = F.md5(F.concat_ws("|", F.col("path"), F.col("diff_hash")))
    parts = [F.conv(F.substring(word, 1 + 8 * i, 8), 16, 10).cast("bigint") for i in range(4)]
    summed = diffs.groupBy("repo", "sha").agg(*[F.sum(p).alias(f"w{i}") for i, p in enumerate(parts)])
    return summed.select("repo", "sha", F.md5(F.concat_ws("-", *[f"w{i}" for i in range(4)])).alias("patch_id"))


def diff_hashes(changes: DataFrame, blobs: DataFrame, context: int = 3) -> DataFrame:
    """``repo, sha, path, diff_hash`` of changed files (repo, sha, path, old_blob, new_blob) from their contents (repo, blob, text).

    Commits that make the same change from the same contents share one line diff, and only its hash is joined back. A side
    without a blob has no lines; blobs without text (such as binary files) are told apart by their names.

    No text is moved whole. Lines are compared by what stands for them, and only lines in a hunk are read from the texts
    and moved then, so what is moved grows with the number of lines and the size of the diffs. The two readings of
    ``blobs`` aggregate it at once, which lets the optimizer leave out a ``DISTINCT`` of texts below.
    """
    pair = ["repo", "old_blob", "new_blob"]
    same = lambda a, b: [a[c].eqNullSafe(b[c]) for c in pair]
    spark = changes.sparkSession
    ship(spark)
    both = _with_contents(changes.select(*pair).distinct(), blobs.groupBy("repo", "blob").agg(F.max(_outlined("text")).alias("lines")))
    unread = lambda side: F.col(f"{side}_blob").isNotNull() & F.col(f"{side}_lines").isNull()
    named = F.sha2(F.concat_ws("|", F.coalesce("old_blob", F.lit("")), F.coalesce("new_blob", F.lit(""))), 256)
    either = both.withColumn("diff_hash", F.when(unread("old") | unread("new"), named))
    schema = "repo string, old_blob string, new_blob string, diff_hash string, ranges array<int>, length int, wanted bigint"
    with shuffles_freed(spark):
        compared = cut_lineage(either.mapInArrow(_compared(context), schema), "changed_ranges")
    wanted = compared.agg(F.sum("wanted")).first()[0] or 0
    filters = -(-wanted // MOST_NUMBERS) or 1
    with shuffles_freed(spark):
        excerpts, held = zip(*[_wanted_lines(compared, blobs, context, wanted // filters, filters, n) for n in range(filters)])
        hunks = _with_contents(compared.drop("wanted"), reduce(DataFrame.unionByName, excerpts))
        found = cut_lineage(hunks.mapInArrow(_hashed(context), "repo string, old_blob string, new_blob string, diff_hash string"), "diff_hashes")
    for each in held:
        each.destroy()
    joined = changes.join(found, same(changes, found))
    return joined.select(changes["repo"], "sha", "path", "diff_hash")


def _with_contents(pairs: DataFrame, contents: DataFrame) -> DataFrame:
    """``pairs`` with the ``lines`` of both sides: ``new_lines``, and last, as context is taken from there, ``old_lines``.

    Pairs without a blob on a side are dealt out by their other blob, and not to one task.
    """
    for side, other in (("new", "old"), ("old", "new")):
        blob = F.col(f"{side}_blob")
        own = contents.select(F.col("repo").alias("of_repo"), F.col("blob").alias("of_blob"), F.col("lines").alias(f"{side}_lines"))
        at = (F.col("repo") == F.col("of_repo")) & (F.coalesce(blob, f"{other}_blob") == F.col("of_blob")) & blob.isNotNull()
        pairs = pairs.join(own, at, "left").drop("of_repo", "of_blob")
    return pairs


def _outlined(text: str) -> Column:
    def outlined(texts: pa.Array) -> pa.Array:
        return pa.array((outline(lines_of(x.as_py())) if x.is_valid else None for x in texts), pa.binary())

    return F.arrow_udf(outlined, "binary")(text)


def _columns(batch: pa.RecordBatch, *names: str) -> list[list]:
    return [batch.column(c).to_pylist() for c in names]


def _ranges(flat: list[int]) -> list[tuple[int, int, int, int]]:
    return list(zip(*[iter(flat)] * 4))


def _compared(context: int):
    """Changed ranges of the lines of both sides, four numbers each, and how many lines their hunks have."""

    def compared(batches):
        for batch in batches:
            ranges, lengths, wanted = [], [], []
            for name, old, new in zip(*_columns(batch, "diff_hash", "old_lines", "new_lines")):
                a, b = outlined_lines(old), outlined_lines(new)
                found = changed_ranges(a, b) if name is None else []
                ranges.append([n for x in found for n in x])
                lengths.append(len(a))
                wanted.append(sum(end - first for _, first, end in asked_parts(found, len(a), context)))
            kept = ["repo", "old_blob", "new_blob", "diff_hash"]
            made = [pa.array(ranges, pa.list_(pa.int32())), pa.array(lengths, pa.int32()), pa.array(wanted, pa.int64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *made], [*kept, "ranges", "length", "wanted"])

    return compared


def _wanted_lines(
    compared: DataFrame, blobs: DataFrame, context: int, n: int, filters: int, own: int
) -> tuple[DataFrame, Broadcast[bytes]]:
    """``repo, blob, lines``: of contents whose number belongs to filter ``own`` of ``filters``, the lines that hunks ask for.

    Texts are not moved to those who ask; a filter of about ``n`` lines goes to the texts instead. It finds all lines that
    were asked for and few others. The filter is returned beside, to be destroyed when the lines have been read.
    """
    words = words_for(n)

    def asked(batches):
        for batch in batches:
            ask = []
            for repo, old, new, flat, length in zip(*_columns(batch, "repo", "old_blob", "new_blob", "ranges", "length")):
                if not flat:
                    continue
                number = {"old": content_number(repo, old) if old is not None else 0, "new": content_number(repo, new) if new is not None else 0}
                for mark, first, end in asked_parts(_ranges(flat), length, context):
                    of = number["new" if mark == "+" else "old"]
                    if of % filters == own:
                        ask.append((of, first, end))
            if not ask:
                continue
            numbers = line_numbers(*zip(*ask))
            at = segment(numbers)
            order = np.argsort(at, kind="stable")
            held, starts = np.unique(at[order], return_index=True)
            yield pa.RecordBatch.from_arrays(
                [pa.array(held, pa.int32()), pa.array([x.tobytes() for x in np.split(numbers[order], starts[1:])], pa.binary())], ["segment", "numbers"]
            )

    def filled(table: pa.Table) -> pa.Table:
        numbers = np.frombuffer(b"".join(table.column("numbers").to_pylist()), np.uint64)
        return pa.table({"segment": table.column("segment")[:1], "words": pa.array([fill_segment(numbers, words)], pa.binary())})

    asking = compared.select("repo", "old_blob", "new_blob", "ranges", "length").mapInArrow(asked, "segment int, numbers binary")
    parts = {r.segment: r.words for r in asking.groupBy("segment").applyInArrow(filled, "segment int, words binary").collect()}
    none = bytes(8 * words // SEGMENTS)
    whole = blobs.sparkSession.sparkContext.broadcast(b"".join(bytes(parts.get(n, none)) for n in range(SEGMENTS)))

    def excerpted(repos: pa.Array, names: pa.Array, texts: pa.Array) -> pa.Array:
        out, at, numbers, lines = [None] * len(texts), [], [], []
        for row, (repo, blob, text) in enumerate(zip(repos.to_pylist(), names.to_pylist(), texts)):
            if repo is None or blob is None or not text.is_valid:
                continue
            of = content_number(repo, blob)
            if of % filters == own:
                at.append(row)
                numbers.append(of)
                lines.append(lines_of(text.as_py()))
        ends = [len(x) for x in lines]
        found = stands(line_numbers(numbers, [REMOVED] * len(at), ends), np.frombuffer(whole.value, np.uint64))
        for row, own_lines, hits in zip(at, lines, np.split(found, np.cumsum([n - REMOVED for n in ends[:-1]]))):
            places = (np.flatnonzero(hits) + REMOVED).tolist()
            if places:
                out[row] = excerpt(own_lines, places)
        return pa.array(out, pa.binary())

    read = F.arrow_udf(excerpted, "binary")("repo", "blob", "text")
    return blobs.groupBy("repo", "blob").agg(F.max(read).alias("lines")).where(F.col("lines").isNotNull()), whole


def _hashed(context: int):
    """Hashes of hunks whose lines have been read; a hash by names stays."""

    def hashed(batches):
        for batch in batches:
            found = []
            for name, flat, length, old, new in zip(*_columns(batch, "diff_hash", "ranges", "length", "old_lines", "new_lines")):
                if name is None:
                    name = read_hash(_ranges(flat), length, excerpted_lines(old), excerpted_lines(new), context)
                found.append(name)
            kept = ["repo", "old_blob", "new_blob"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(found, pa.string())], [*kept, "diff_hash"])

    return hashed
