"""Mergeable distinct counts, bucketed snapshots and unreadable histories."""

import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from plumbline.operators import branches, distinct, reconcile
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import snapshots
from tests.conftest import rows

FACTS = "run string, k string, v string"


def test_numbers_grow_and_never_change(table):
    first = distinct.extend(None, table(FACTS, ("1", "a", "x"), ("1", "a", None), ("1", "b", ""), ("1", "b", "x")), "v")
    assert rows(first) == [("", 1), ("x", 2)]
    known = cut_lineage(first)
    more = distinct.extend(known, table(FACTS, ("2", "a", "x"), ("2", "a", "b"), ("2", "a", "a")), "v")
    assert rows(more) == [("a", 3), ("b", 4)]
    assert distinct.extend(known, table(FACTS), "v").count() == 0
    assert rows(distinct.extend(table(distinct.DICTIONARY), table(FACTS, ("1", "a", "x")), "v")) == [("x", 1)]


def test_merged_counts_equal_counts_of_rows(spark):
    """Two runs that share values, more numbers than one bitmap has, one key with most rows."""
    first = spark.range(50_000).select(F.lit("1").alias("run"), F.when(F.col("id") % 10 < 7, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 5)).alias("k"), F.col("id").cast("string").alias("v"))
    second = spark.range(40_000, 90_000).select(F.lit("2").alias("run"), F.when(F.col("id") % 3 == 0, "hot").alias("k"), F.when(F.col("id") % 2 == 0, F.col("id").cast("string")).alias("v"))
    numbers = cut_lineage(distinct.extend(None, first, "v"))
    maps = cut_lineage(distinct.bitmaps(first, ["run", "k"], "v", numbers))
    numbers = cut_lineage(numbers.unionByName(distinct.extend(numbers, second, "v")))
    both = maps.unionByName(distinct.bitmaps(second, ["run", "k"], "v", numbers))
    facts = first.unionByName(second)
    for keys in (["k"], ["run", "k"], ["run"]):
        assert rows(distinct.counts(both, keys, "n")) == rows(facts.groupBy(*keys).agg(F.countDistinct("v").alias("n")))


def test_keys_of_one_value_stay_small(spark):
    """Every value with a key of its own: words, not bitmaps of thousands of numbers, and no rows sorted to combine them."""
    facts = spark.range(5_000).select(F.col("id").cast("string").alias("k"), F.col("id").cast("string").alias("v"))
    maps = distinct.bitmaps(facts, ["k"], "v", cut_lineage(distinct.extend(None, facts, "v")))
    assert dict(maps.dtypes)["bits"] == "bigint" and maps.count() == 5_000
    assert "SortAggregate" not in maps._jdf.queryExecution().executedPlan().toString()
    assert maps.groupBy().agg(F.sum(F.bit_count("bits"))).first()[0] == 5_000


def test_counts_of_nothing(table):
    numbers = table(distinct.DICTIONARY, ("x", 1))
    maps = distinct.bitmaps(table(FACTS, ("1", "a", None), ("1", "b", "x"), ("1", None, "x")), ["k"], "v", numbers)
    assert rows(distinct.counts(maps, ["k"], "n")) == rows(table("k string, n bigint", ("a", 0), ("b", 1), (None, 1)))
    assert distinct.counts(distinct.bitmaps(table(FACTS), ["k"], "v", numbers), ["k"], "n").count() == 0
    with pytest.raises(PySparkException, match="no number in the dictionary"):
        distinct.bitmaps(table(FACTS, ("1", "a", "unknown")), ["k"], "v", numbers).collect()


REPORT = "repo string, discrepancy string, commit string, file_path string, note string, seq int"


@pytest.fixture
def stored(spark):
    def store(report, buckets=4):
        name = f"t_{uuid.uuid4().hex}"
        snapshots.store_snapshot(report, name, scratch_path(spark, "snapshot"), reconcile.REPORT_KEY, "seq", buckets)
        return name

    return store


def test_snapshots_compare_as_reports(spark, table, stored):
    old = table(REPORT, ("r", "d", "1", "a", "first", 1), ("r", "d", "1", "a", "last", 2), ("r", None, "2", "", "x", 3), ("r", "d", "3", "b", "same", 4), (None, None, None, None, "none", 5))
    new = table(REPORT, ("r", "d", "3", "b", "other note", 1), ("r", "", "2", None, "y", 2), ("r", None, "2", "", None, 3))
    names = stored(old), stored(new)
    found = snapshots.compare_snapshots(spark, *names)
    assert rows(found) == rows(reconcile.report_diff(old, new, "seq").select(*found.columns))
    assert {(r.side, r.note) for r in found.collect()} == {("only_in_old", "last"), ("only_in_old", "none"), ("only_in_new", "y")}
    empty = stored(old.where("false"))
    assert snapshots.compare_snapshots(spark, empty, names[1]).where("side = 'only_in_new'").count() == 3
    assert snapshots.compare_snapshots(spark, names[0], names[0]).count() == 0


def test_snapshots_are_compared_without_exchange(spark, table, stored):
    report = spark.range(1000).select(F.lit("r").alias("repo"), F.lit("d").alias("discrepancy"), F.col("id").cast("string").alias("commit"), F.lit("p").alias("file_path"), F.lit("n").alias("note"), F.col("id").alias("seq"))
    names = stored(report), stored(report.where("seq % 2 = 0"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = snapshots.compare_snapshots(spark, *names)
        assert found.count() == 500
        plan = found._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and "Exchange" not in plan


def test_history_that_cannot_be_read(table):
    keys = "repo string, branch string, sha string"
    repos = table("repo string", ("whole",), ("cut",), ("none",), ("short",))
    tips = [(r, b, f"{r}-{b}") for r in ("whole", "cut", "none") for b in ("master", "test", "production")] + [("short", "master", "short-master")]
    known = table("repo string, sha string", *[(r, s) for r, _, s in tips if r != "none" and s != "cut-test"])
    directed = branches.repo_directions(branches.branch_presence(repos, table(keys, *tips)))
    found = branches.history_status(directed, table(keys, *tips), known)
    status = {(r.repo, r.discrepancy): r.status for r in found.collect()}
    assert len(status) == 24 and found.columns == directed.columns
    assert all(s == {"whole": "ok", "none": "error", "short": "missing_branch"}.get(r, "error" if "test" in d else "ok") for (r, d), s in status.items())
    counts = table("repo string, discrepancy string, unique_commits bigint, unique_files bigint, total_file_lines bigint")
    row = branches.commit_kpis(found, counts).where("repo = 'none' AND discrepancy = 'test_not_in_master'").first()
    assert (row.unique_commits, row.unique_files, row.status, row.severity) == (None, None, "error", "N/A")
