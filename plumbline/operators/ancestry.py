"""Reachability kept between runs: a chain index that grows with new commits only.

A history is split into chains as in :mod:`plumbline.operators.history`. The index keeps where each commit stands
(``placed``), the edges between chains (``crossing``), and for each chain that ever held a branch tip, its *trunks*, a
staircase per reached chain (``reach``): from which position of the trunk on the other chain is reached, and how far up.
What a tip reaches is read off the steps at or below its position. New commits go on at the ends of chains or start new
ones, so nothing stored ever changes: a run adds a generation with rows for its new commits and new steps.

A generation counts once its record in ``done`` is written, the last thing a run does. A run that was ended before is
simply repeated and overwrites its generation. One run at a time extends an index.

Repositories of up to ``SMALL`` rows are dealt over the tasks, which extend one at a time; the rows of larger ones are
joined in rounds. Both write the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plumbline.functions.lines import MISSING, Repository
from plumbline.operators.history import chains
from plumbline.session import cut_and_count, cut_lineage, scratch_path, ship

TABLES = {
    "placed": "repo string, sha string, chain string, pos bigint",
    "records": "repo string, sha string",
    "crossing": "repo string, from_chain string, from_pos bigint, to_chain string, to_pos bigint",
    "trunks": "repo string, trunk string",
    "reach": "repo string, trunk string, pos bigint, chain string, top bigint",
    "resets": "repo string",
}
BUCKETS = 16

#: Most rows, given and stored, of a repository that one task extends by itself.
SMALL = 10_000
#: Slots in which rows are counted first; repositories of slots with more than ``SMALL`` rows are counted one by one.
SLOTS = 1 << 16
#: Rows of all tables in one form.
ROW = "repo string, kind string, a string, b string, m bigint, n bigint"
COLUMNS = {
    "given": ("sha", "parent_sha", "parent_index", None),
    "wanted": ("sha", None, None, None),
    "placed": ("sha", "chain", "pos", None),
    "records": ("sha", None, None, None),
    "crossing": ("from_chain", "to_chain", "from_pos", "to_pos"),
    "trunks": ("trunk", None, None, None),
    "kept": ("trunk", None, None, None),
    "reach": ("trunk", "chain", "pos", "top"),
    "resets": (None, None, None, None),
}
#: Rows that a task hands over at once.
AT_ONCE = 20_000


def generations(spark: SparkSession, base: str) -> int:
    """Number of finished generations of the index."""
    try:
        done = spark.read.schema("gen int").option("recursiveFileLookup", True).parquet(f"{base}/done")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return 0
    last = done.agg(F.max("gen")).first()[0]
    return 0 if last is None else last + 1


def _bucket(buckets: int):
    return F.pmod(F.xxhash64("repo"), F.lit(buckets)).cast("int")


def read_table(spark: SparkSession, base: str, name: str, before: int, at: Sequence[int] | None = None) -> DataFrame:
    """Rows of a table from generations below ``before``, of the buckets ``at`` alone if given; with ``gen``."""
    schema = f"{TABLES[name]}, gen int, bucket int"
    try:
        rows = spark.read.schema(schema).option("basePath", f"{base}/{name}").parquet(f"{base}/{name}")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        rows = spark.createDataFrame([], schema)
    rows = rows.where(F.col("gen") < before)
    return (rows if at is None else rows.where(F.col("bucket").isin(list(at)))).drop("bucket")


def _add(rows: DataFrame, base: str, name: str, gen: int, buckets: int) -> None:
    """Write a generation's rows of a table."""
    placed = rows.withColumn("bucket", _bucket(buckets)).hint("rebalance", "bucket")
    placed.write.mode("overwrite").partitionBy("bucket").parquet(f"{base}/{name}/gen={gen}")


def _live(rows: DataFrame, resets: DataFrame) -> DataFrame:
    """Rows of trunks that no later reset of their repository took back."""
    last = resets.groupBy("repo").agg(F.max("gen").alias("reset"))
    return rows.join(last, "repo", "left").where(F.col("reset").isNull() | (F.col("gen") >= F.col("reset"))).drop("reset")


def _place(nodes: DataFrame, records: DataFrame, placed: DataFrame) -> DataFrame:
    """Positions of new commits: the longest line above a stored chain's end goes on with it, others start chains."""
    edges = records.where(F.col("parent_sha").isNotNull())
    main = edges.groupBy("repo", "sha").agg(F.min_by("parent_sha", F.struct("parent_index", "parent_sha")).alias("parent_sha"))
    main = cut_lineage(main.join(nodes, ["repo", "sha"]), "main")
    inside = main.join(nodes.select("repo", F.col("sha").alias("parent_sha")), ["repo", "parent_sha"])
    lines = nodes.join(inside, ["repo", "sha"], "left").select("repo", "sha", "parent_sha", F.lit(0).alias("parent_index"))
    own = cut_lineage(chains(lines, nodes), "own")
    length = own.groupBy("repo", "chain").agg(F.max("pos").alias("length"))
    ends = placed.groupBy("repo", "chain").agg(F.max("pos").alias("pos")).withColumnRenamed("chain", "onto")
    heads = length.join(main.withColumnRenamed("sha", "chain"), ["repo", "chain"])
    below = placed.select("repo", F.col("sha").alias("parent_sha"), F.col("chain").alias("onto"), "pos")
    fitting = heads.join(below, ["repo", "parent_sha"]).join(ends, ["repo", "onto", "pos"])
    chosen = fitting.groupBy("repo", "onto", "pos").agg(F.max_by("chain", F.struct("length", "chain")).alias("chain"))
    return own.join(chosen.withColumnRenamed("pos", "end"), ["repo", "chain"], "left").select(
        "repo", "sha", F.coalesce("onto", "chain").alias("chain"), (F.col("pos") + F.coalesce(F.col("end") + 1, F.lit(0))).alias("pos")
    )


def _stairs(rows: DataFrame) -> DataFrame:
    """Drop steps that a lower position of the trunk already takes as high."""
    lower = Window.partitionBy("repo", "trunk", "chain").orderBy("pos", F.desc("top"), "fresh").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_below", F.max("top").over(lower)).where(F.col("_below").isNull() | (F.col("top") > F.col("_below"))).drop("_below")


def _follow(state: DataFrame, crossing: DataFrame) -> DataFrame:
    """Steps one edge further on from fresh steps.

    An edge belongs to the lowest step at or above its position, found in one sorted pass over steps and edges, and only
    a fresh step takes it. Each edge is met once per trunk, however many steps lead to its chain.
    """
    touched = state.where("fresh").select("repo", "trunk", "chain").distinct()
    none = F.lit(None).cast("bigint")
    edges = touched.join(crossing.withColumnRenamed("from_chain", "chain"), ["repo", "chain"]).select(
        "repo", "trunk", "chain", F.col("from_pos").alias("at"), "to_chain", "to_pos", none.alias("pos"), F.lit(None).cast("boolean").alias("fresh")
    )
    steps = state.join(touched, ["repo", "trunk", "chain"], "left_semi").select(
        "repo", "trunk", "chain", F.col("top").alias("at"), F.lit(None).cast("string").alias("to_chain"), none.alias("to_pos"), "pos", "fresh"
    )
    downwards = Window.partitionBy("repo", "trunk", "chain").orderBy(F.desc("at"), F.col("to_chain").isNotNull())
    taken = edges.unionByName(steps).withColumn("by", F.last(F.when(F.col("pos").isNotNull(), F.struct("pos", "fresh")), True).over(downwards))
    return taken.where(F.col("to_chain").isNotNull() & F.col("by.fresh") & (F.col("to_chain") != F.col("trunk"))).select(
        "repo", "trunk", F.col("by.pos").alias("pos"), F.col("to_chain").alias("chain"), F.col("to_pos").alias("top"), F.lit(True).alias("fresh")
    )


def _large(rows: Sequence[DataFrame]) -> tuple[DataFrame, int]:
    """Repositories with more than ``SMALL`` rows, and their number."""
    repos = reduce(DataFrame.unionByName, [r.select("repo") for r in rows])
    slot = F.pmod(F.xxhash64("repo"), F.lit(SLOTS)).alias("slot")
    crowded = repos.groupBy(slot).agg(F.count("*").alias("rows")).where(F.col("rows") > SMALL).select("slot")
    crowded, some = cut_and_count(crowded, F.lit(True), "crowded")
    if not some:
        return repos.where(F.lit(False)), 0
    counted = repos.withColumn("slot", slot).join(crowded, "slot", "left_semi").groupBy("repo").agg(F.count("*").alias("rows"))
    return cut_and_count(counted.where(F.col("rows") > SMALL).select("repo"), F.lit(True), "large")


def _extended(batches) -> Iterator[pa.RecordBatch]:
    """New rows of whole repositories, whose rows come one after the other."""
    names = [x.split()[0] for x in ROW.split(", ")]
    out: list[tuple] = []

    def handed(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows)
        return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if i < 4 else pa.int64()) for i, c in enumerate(columns)], names)

    def ended(repository: Repository) -> Iterator[pa.RecordBatch]:
        for row in repository.extend():
            out.append(row)
            if len(out) == AT_ONCE:
                yield handed(out)
                out.clear()

    current = None
    for batch in batches:
        numbers = [c.fill_null(MISSING) for c in batch.columns[4:]]  # through arrays, which is far faster than value by value
        for repo, kind, a, b, m, n in zip(*[c.to_numpy(zero_copy_only=False).tolist() for c in [*batch.columns[:4], *numbers]]):
            if current is None or repo != current.repo:
                if current is not None:
                    yield from ended(current)
                current = Repository(repo)
            current.add(kind, a, b, m, n)
    if current is not None:
        yield from ended(current)
    if out:
        yield handed(out)


def _extend_small(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New rows by table, each repository extended by one task. ``rows`` has the live stored rows and the new ones."""
    spark = rows["given"].sparkSession
    ship(spark)

    def formed(name: str) -> DataFrame:
        types = ("string", "string", "bigint", "bigint")
        values = [(F.lit(None) if c is None else F.col(c)).cast(t).alias(x) for x, c, t in zip("abmn", COLUMNS[name], types)]
        return rows[name].select("repo", F.lit(name).alias("kind"), *values)

    together = reduce(DataFrame.unionByName, [formed(name) for name in rows]).repartition("repo").sortWithinPartitions("repo")
    path = scratch_path(spark, "extended")
    together.mapInArrow(_extended, ROW).write.partitionBy("kind").parquet(path)
    found = spark.read.schema(ROW).parquet(path)
    if not found.where("kind = 'cycle'").isEmpty():
        raise ValueError("the parent table has a cycle")

    def of(name: str) -> DataFrame:
        columns = [F.col(x).alias(c) for x, c in zip("abmn", COLUMNS[name]) if c is not None]
        return found.where(F.col("kind") == name).select("repo", *columns)

    new = {name: of(name) for name in TABLES}
    recorded = found.where("kind = 'placed' AND n = 1").select("repo", F.col("a").alias("sha"))
    steps = _stairs(new["reach"].withColumn("fresh", F.lit(True))).drop("fresh")
    return new | {"records": new["records"].unionByName(recorded), "reach": steps}


def _extend_large(rows: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """New rows by table, in rounds of joins. ``rows`` has the live stored rows and the new ones."""
    given, wanted, old = cut_lineage(rows["given"].distinct(), "given"), rows["wanted"], rows["placed"]
    records = cut_lineage(given.join(rows["records"], ["repo", "sha"], "left_anti"), "records")
    late = cut_lineage(records.select("repo", "sha").distinct().join(old, ["repo", "sha"], "left_semi").select("repo").distinct(), "late")
    above = records.where(F.col("parent_sha").isNotNull()).select("repo", F.col("parent_sha").alias("sha"))
    met = records.select("repo", "sha").unionByName(above).unionByName(wanted).distinct()
    nodes = cut_lineage(met.join(old, ["repo", "sha"], "left_anti"), "nodes")
    new = cut_lineage(_place(nodes, records, old), "placed")
    placed = old.unionByName(new)

    edges = records.where(F.col("parent_sha").isNotNull()).select("repo", "sha", "parent_sha").distinct()
    source = placed.select("repo", "sha", F.col("chain").alias("from_chain"), F.col("pos").alias("from_pos"))
    target = placed.select("repo", F.col("sha").alias("parent_sha"), F.col("chain").alias("to_chain"), F.col("pos").alias("to_pos"))
    between = edges.join(source, ["repo", "sha"]).join(target, ["repo", "parent_sha"]).where("from_chain != to_chain")
    added = cut_lineage(between.select("repo", "from_chain", "from_pos", "to_chain", "to_pos"), "crossing")
    crossing = rows["crossing"].unionByName(added)

    kept = rows["kept"].join(late, "repo", "left_anti").select("repo", "trunk").distinct()
    held = wanted.join(placed, ["repo", "sha"]).select("repo", F.col("chain").alias("trunk"))
    begun = held.unionByName(rows["trunks"]).distinct().join(kept, ["repo", "trunk"], "left_anti")
    begun = cut_lineage(begun, "trunks")
    first = added.withColumnRenamed("from_chain", "trunk").join(kept, ["repo", "trunk"])
    whole = crossing.withColumnRenamed("from_chain", "trunk").join(begun, ["repo", "trunk"])
    starts = cut_lineage(
        first.unionByName(whole).select("repo", "trunk", F.col("from_pos").alias("pos"), F.col("to_chain").alias("chain"), F.col("to_pos").alias("top"), F.lit(True).alias("fresh")),
        "starts",
    )
    grown = starts.select("repo", "trunk").distinct()
    floors = rows["reach"].join(late, "repo", "left_anti").join(grown, ["repo", "trunk"], "left_semi").groupBy("repo", "trunk", "chain").agg(F.max("top").alias("top"))
    floors = floors.select("repo", "trunk", F.lit(-1).cast("bigint").alias("pos"), "chain", "top", F.lit(False).alias("fresh"))
    state, fresh = cut_and_count(_stairs(starts.unionByName(floors)), F.col("fresh"), "stairs")
    while fresh:
        known = state.withColumn("fresh", F.lit(False))
        state, fresh = cut_and_count(_stairs(known.unionByName(_follow(state, crossing))), F.col("fresh"), "stairs")
    reach = state.where("pos >= 0").select("repo", "trunk", "pos", "chain", "top")
    return {"placed": new, "records": records.select("repo", "sha").distinct(), "crossing": added, "trunks": begun, "reach": reach, "resets": late}


def extend_index(base: str, parents: DataFrame, tips: DataFrame, buckets: int = BUCKETS) -> int:
    """Add new commits and tips to the index below ``base``; returns the number of the generation written.

    ``parents`` (repo, sha, parent_sha, parent_index) may repeat commits the index holds, which are left out; ``tips``
    has repo and sha. Rows without repo or sha do not count. A record that arrives after its commit was met as a parent
    (a history that was cut off before) takes back the steps of its repository, which are then built anew.
    ``buckets`` must be the same in each call.
    """
    spark = parents.sparkSession
    gen = generations(spark, base)
    named = F.col("repo").isNotNull() & F.col("sha").isNotNull()
    given = cut_lineage(parents.where(named).select("repo", "sha", "parent_sha", "parent_index"), "given")
    wanted = cut_lineage(tips.where(named).select("repo", "sha").distinct(), "wanted")
    repos = given.select("repo").unionByName(wanted.select("repo"))
    at = [r[0] for r in repos.select(_bucket(buckets).alias("b")).distinct().collect()]  # a few small numbers
    rows = {"given": given, "wanted": wanted}
    if gen:
        stored = {name: read_table(spark, base, name, gen, at) for name in TABLES}
        resets = stored["resets"]
        rows |= {name: stored[name].drop("gen") for name in ("placed", "records", "crossing", "trunks")}
        rows |= {"kept": _live(stored["trunks"], resets).drop("gen"), "reach": _live(stored["reach"], resets).drop("gen")}
    else:
        rows |= {name: spark.createDataFrame([], TABLES[name]) for name in ("placed", "records", "crossing", "trunks", "reach")}
        rows |= {"kept": rows["trunks"]}
    large, some = _large(list(rows.values()))
    found = []
    if some:
        found.append(_extend_large({name: r.join(large, "repo", "left_semi") for name, r in rows.items()}))
        rows = {name: r.join(large, "repo", "left_anti") for name, r in rows.items()}
    found.append(_extend_small(rows))
    for name in TABLES:
        _add(reduce(DataFrame.unionByName, [f[name] for f in found]), base, name, gen, buckets)
    spark.range(1).select(F.lit(gen).alias("gen")).write.mode("overwrite").parquet(f"{base}/done/g{gen}")
    return gen


def reachable_from_index(spark: SparkSession, base: str, tips: DataFrame) -> DataFrame:
    """Commits reachable from every branch tip, as ``history.reachable`` gives them: ``repo, branch, sha``.

    The chains of the tips must be trunks of the index: pass the tips to :func:`extend_index` first.
    """
    number = generations(spark, base)
    placed = read_table(spark, base, "placed", number).drop("gen")
    resets = read_table(spark, base, "resets", number)
    trunks = _live(read_table(spark, base, "trunks", number), resets).select("repo", F.col("trunk").alias("chain")).distinct()
    named = tips.where(F.col("repo").isNotNull() & F.col("sha").isNotNull())
    start = cut_lineage(named.join(placed, ["repo", "sha"], "left").select("repo", "branch", "chain", "pos"), "start")
    if not start.join(trunks, ["repo", "chain"], "left_anti").isEmpty():
        raise ValueError("the index was not extended with all of these tips")
    steps = _live(read_table(spark, base, "reach", number), resets).select("repo", F.col("trunk"), F.col("pos").alias("from_pos"), "chain", "top")
    others = start.withColumnRenamed("chain", "trunk").join(steps, ["repo", "trunk"]).where("from_pos <= pos")
    rows = start.select("repo", "branch", "chain", F.col("pos").alias("top")).unionByName(others.select("repo", "branch", "chain", "top"))
    reached = rows.groupBy("repo", "branch", "chain").agg(F.max("top").alias("top"))
    return placed.join(reached, ["repo", "chain"]).where("pos <= top").select("repo", "branch", "sha")
