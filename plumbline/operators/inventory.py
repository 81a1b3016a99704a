"""Keyed inventories extracted from file and CI texts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.constants import DATASETS_KEY, DEPLOY_JOBS, NO_DATASETS
from plumbline.functions.labels import filter_names, is_model, risk_score
from plumbline.functions.text import (
    added_columns,
    ci_block,
    ci_pairs,
    create_columns,
    dag_ids,
    ddl_target,
    last_value,
    materialization,
    normalize_sql,
    split_header,
    split_names,
    stem,
    unquote,
)
from plumbline.operators.skew import fill_forward
from plumbline.session import spread

OBJECT = ["product", "dataset", "object_name"]


def ddl_files(files: DataFrame) -> DataFrame:
    """One row per definition file (product, path, text) with its target, kind and columns.

    A file that names no object stands for its stem. Only this step reads texts.
    """
    parsed = spread(files.select("product", "path", "text")).withColumn("t", ddl_target(F.col("text")))
    tabular = F.col("t.kind").isin("table", "alter_table")
    none = F.array().cast("array<struct<name:string,type:string>>")
    return parsed.select(
        "product",
        "path",
        "text",
        F.col("t.dataset").alias("dataset"),
        F.coalesce("t.object", stem(F.col("path"))).alias("object_name"),
        F.col("t.kind").alias("kind"),
        F.when(tabular, F.concat(create_columns(F.col("text")), added_columns(F.col("text")))).otherwise(none).alias("columns"),
    )


def ddl_columns(parsed: DataFrame) -> DataFrame:
    """Columns per object; the type in the last file, by path, stands."""
    rows = parsed.select(*OBJECT, "path", F.posexplode("columns").alias("at", "c"))
    last = F.max_by(F.col("c.type"), F.struct("path", "at"))
    return rows.groupBy(*OBJECT, F.col("c.name").alias("column_name")).agg(last.alias("data_type"))


def ddl_inventory(parsed: DataFrame) -> DataFrame:
    """One row per object: type, number of files, columns and first file.

    The first file by path sets the type; the last file of another known kind
    replaces it; an object that is only altered counts as a table once columns
    are known. All of it are extremes by path that combine on the map side; the
    files themselves stay rows of :func:`ddl_files`.
    """
    kind, path = F.col("kind"), F.col("path")
    overriding = ~kind.isin("table", "alter_table", "unknown")
    grouped = parsed.groupBy(*OBJECT).agg(
        F.min_by("kind", "path").alias("first_kind"),
        F.max_by("kind", F.when(overriding, path)).alias("last_kind"),
        F.max(F.when(F.size("columns") > 0, F.lit(1)).otherwise(F.lit(0))).alias("with_columns"),
        F.count(F.lit(1)).alias("file_count"),
        F.min("path").alias("first_path"),
    )
    first = F.when((F.col("first_kind") == "alter_table") & (F.col("with_columns") == 1), F.lit("table")).otherwise(F.col("first_kind"))
    return grouped.select(
        *OBJECT,
        F.coalesce("last_kind", first).alias("object_type"),
        "file_count",
        (F.col("file_count") > 1).alias("multi_statement"),
        "first_path",
    )


def view_fragments(parsed: DataFrame, inventory: DataFrame) -> DataFrame:
    """Texts of the objects that are views, one row per file."""
    views = inventory.where(F.col("object_type").isin("view", "materialized_view")).select(*OBJECT)
    matched = parsed.join(views.where(F.col("dataset").isNotNull()), OBJECT, "left_semi")
    return matched.select(*OBJECT, "path", "text")


def model_inventory(files: DataFrame) -> DataFrame:
    """Models by file stem, with normalised hash and materialisation; the last path stands."""
    models = files.where(is_model(F.col("path")) & F.col("path").endswith(".sql")).select(
        "product",
        stem(F.col("path")).alias("object_name"),
        F.col("path").alias("relative_path"),
        F.sha2(normalize_sql(F.col("text")), 256).alias("sql_hash"),
        materialization(F.col("text")).alias("materialized"),
    )
    facts = F.struct("relative_path", "sql_hash", "materialized")
    return models.groupBy("product", "object_name").agg(F.max_by(facts, "relative_path").alias("f")).select("product", "object_name", "f.*")


def dag_inventory(files: DataFrame) -> DataFrame:
    """DAG ids per Python file, for files that define any."""
    found = files.select("product", F.col("path").alias("relative_path"), dag_ids(F.col("text")).alias("dag_ids"))
    return found.where(F.size("dag_ids") > 0)


def ci_settings(text: Column, jobs: Sequence[str] = DEPLOY_JOBS, whole_tail: bool = False) -> Column:
    """(key, value) structs of a CI text: top-level variables, then those of the deploy jobs.

    Later pairs override earlier ones; :func:`last_value` reads them that way.
    """
    pairs = [ci_pairs(ci_block(text, "variables", 0, whole_tail), 2)]
    for job in jobs:
        block = ci_block(text, job, 0, whole_tail)
        pairs.append(ci_pairs(ci_block(block, "variables", 2, whole_tail), 4))
    return F.concat(*pairs)


def settings_table(ci_files: DataFrame, jobs: Sequence[str] = DEPLOY_JOBS) -> DataFrame:
    """Effective settings per repository as rows, the last pair of a key standing."""
    pairs = ci_files.select("repo", F.posexplode(ci_settings(F.col("text"), jobs)).alias("at", "p"))
    return pairs.groupBy("repo", F.col("p.key").alias("key")).agg(F.max_by(F.col("p.value"), "at").alias("value"))


def branch_texts(remote: DataFrame, local: DataFrame) -> DataFrame:
    """CI text per repository: the remote ref's, else the local one's; repositories without a text drop out."""
    both = remote.select("repo", F.lit(0).alias("rank"), "git_ref", "text").unionByName(
        local.select("repo", F.lit(1).alias("rank"), "git_ref", "text")
    )
    first = both.groupBy("repo").agg(F.min_by(F.struct("git_ref", "text"), "rank").alias("f"))
    return first.select("repo", "f.*").where(F.col("text").isNotNull())


def repo_datasets(ci_texts: DataFrame) -> DataFrame:
    """Datasets each repository declares, in order, with their number."""
    value = unquote(last_value(ci_settings(F.col("text")), DATASETS_KEY))
    listed = ci_texts.select("repo", "git_ref", split_names(value).alias("names"))
    return listed.select(
        "repo", "git_ref", F.array_join("names", ", ").alias("datasets"), F.size("names").cast("bigint").alias("dataset_count"), "names"
    )


def dataset_refs(declared: DataFrame) -> DataFrame:
    """Distinct (dataset, repo) pairs.

    The repositories of a dataset stay rows: a dataset that very many declare
    would not fit a list in one cell.
    """
    return declared.select(F.explode("names").alias("dataset"), "repo").distinct()


def dataset_ref_counts(refs: DataFrame) -> DataFrame:
    return refs.groupBy("dataset").agg(F.count(F.lit(1)).alias("repo_count"), F.min("repo").alias("first_repo"))


def resolve_targets(
    products: DataFrame, settings: DataFrame, defaults: dict[str, str], explicit: Sequence[str] = ()
) -> DataFrame:
    """Project, environment, bucket and datasets per product.

    A CI value goes before the default; explicitly given datasets go before the
    CI list. ``settings`` holds repo, key, value.
    """
    keys = {"project": "BQ_PROJECT", "environment": "ENV", "bucket": "GCP_BUCKET", "_datasets": DATASETS_KEY}
    wide = settings.where(F.col("key").isin(list(keys.values()))).groupBy("repo").agg(
        *[F.max(F.when(F.col("key") == key, F.col("value"))).alias(name) for name, key in keys.items()]
    )
    rows = products.select(F.col("product").alias("repo")).join(wide, "repo", "left")
    named = [F.coalesce(name, F.lit(defaults[name])).alias(name) for name in ("project", "environment", "bucket")]
    given = F.array(*[F.lit(d) for d in explicit]) if explicit else split_names(F.col("_datasets"))
    return rows.select(F.col("repo").alias("product"), *named, F.array_join(given, ",").alias("datasets"))


def without_targets(targets: DataFrame) -> DataFrame:
    """``product, warning`` of products for which no dataset was resolved."""
    return targets.where(F.coalesce("datasets", F.lit("")) == "").select("product", F.lit(NO_DATASETS).alias("warning")).distinct()


def log_rows(logs: DataFrame, keys: Sequence[str] = ("repo", "discrepancy")) -> DataFrame:
    """(commit, file) rows of marker-delimited log texts, one text per cell.

    A header that does not have its five parts is dropped first, so the files
    after it belong to the header before, and a text splits at its headers:
    no window and no shuffle are needed.
    """
    broken = r"(?m)^@@@(?:[^|\n]*\|){0,3}[^|\n]*$"
    blocks = F.split(F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), broken, ""), r"(?m)^(?=@@@)")
    block = logs.select(*keys, F.explode(blocks).alias("block")).where(F.col("block").startswith("@@@"))
    head = split_header(F.regexp_extract("block", r"^([^\n]*)", 1))
    lines = F.split(F.regexp_extract("block", r"(?s)^[^\n]*\n(.*)$", 1), "\n")
    paths = F.filter(F.transform(lines, lambda l: F.trim(l)), lambda l: l != "")
    rows = block.select(*keys, head.alias("h"), paths.alias("paths"))
    return rows.select(*keys, "h.*", F.explode("paths").alias("file_path"))


def log_line_rows(lines: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """As :func:`log_rows` for logs stored as one row per line, however long one log is."""
    filled = fill_forward(lines, keys, order, split_header(F.col("line")), "h")
    path = F.trim("line")
    kept = filled.where(F.col("h").isNotNull() & (path != "") & ~F.col("line").startswith("@@@"))
    return kept.select(*keys, order, "h.*", path.alias("file_path"))


def unmatched_datasets(datasets: DataFrame, refs: DataFrame, include: str = ".*", exclude: str | None = "^_") -> DataFrame:
    """Catalog datasets, by name filter, that no repository declares."""
    kept = filter_names(datasets, "dataset", include, exclude)
    return kept.join(refs.select("dataset").distinct(), "dataset", "left_anti")


def unmatched_objects(objects: DataFrame, unmatched: DataFrame) -> DataFrame:
    return objects.join(unmatched.select("dataset"), "dataset", "left_semi")


def type_counts(objects: DataFrame) -> DataFrame:
    """Objects and a sorted type breakdown per dataset; types are few, so the map is small."""
    counted = objects.groupBy("dataset", "object_type").agg(F.count(F.lit(1)).alias("n"))
    entry = F.struct(F.col("object_type").alias("key"), F.col("n").alias("value"))
    return counted.groupBy("dataset").agg(
        F.sum("n").alias("object_count"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("object_type_counts"),
    )


def dataset_errors(scanned: DataFrame) -> DataFrame:
    """Datasets whose scan reported errors, with the joined error text."""
    return scanned.where(F.col("error").isNotNull()).select("dataset", "error")


def orphan_rows(unmatched: DataFrame, counts: DataFrame) -> DataFrame:
    """Ledger rows of unmatched datasets with their object count and risk, and owner and last change where they are known."""
    joined = unmatched.join(counts, "dataset", "left")
    n = F.coalesce("object_count", F.lit(0))
    return joined.select(
        F.col("dataset").alias("dataset_name"),
        "project_id",
        F.lit("orphan").alias("orphan_status"),
        F.lit(False).alias("source_reference_found"),
        n.alias("table_count"),
        risk_score(n).alias("risk_score"),
        *[c for c in ("owner", "last_modified") if c in unmatched.columns],
    )


def orphan_object_rows(objects: DataFrame) -> DataFrame:
    """Ledger rows of the objects in unmatched datasets, with last change, rows and storage where they are known."""
    known = [c for c in ("last_modified", "row_count", "storage_mb") if c in objects.columns]
    return objects.select(F.col("dataset").alias("dataset_name"), "object_type", "object_name", *known)
