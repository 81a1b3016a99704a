"""The four daily reports from input tables to ledger rows and report files."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.constants import DIRECT, MERGE_BASE, NO_DATASETS
from plumbline.functions.labels import filter_names, stamp
from plumbline.operators import branches, history, inventory, reconcile
from plumbline.operators.executive import count_rows
from plumbline.session import cut_lineage
from plumbline.sources.ledger import new_runs, read_ledger, record_run, run_path
from plumbline.sources.reports import render_findings, write_report_csv, write_snapshot_json, write_text_report


class Frames(dict):
    """Entries by name; one given as a function is made when it is first read."""

    def __getitem__(self, name):
        value = super().__getitem__(name)
        if callable(value):
            value = self[name] = value()
        return value

    def items(self):
        return [(name, self[name]) for name in self]


@dataclass
class Report:
    """Frames of one run: rows for the ledger, CSV files with their sort keys, numbered lines, JSON snapshots by section."""

    report_type: str
    ledger: dict[str, DataFrame]
    files: dict[str, tuple[DataFrame, list[str]]] = field(default_factory=dict)
    texts: dict[str, DataFrame] = field(default_factory=dict)
    snapshots: dict[str, dict[str, DataFrame]] = field(default_factory=dict)


def commit_drift(
    repos: DataFrame, tips: DataFrame, parents: DataFrame, commits: DataFrame, commit_files: DataFrame,
    closure: DataFrame | None = None,
) -> Report:
    """Patch-unique commits in all six directions. A known ``closure`` is reused."""
    closure = history.reachable(parents, tips) if closure is None else closure
    presence = branches.branch_presence(repos, tips)
    directed = cut_lineage(branches.history_status(branches.repo_directions(presence), closure, commits), "directed")
    unique = branches.patch_unique(commits, closure)
    complete = directed.where(F.col("status") == "ok").select("repo", "discrepancy")
    # Each of these feeds several report files and the ledger, so each is computed once.
    unique = cut_lineage(unique.join(complete, ["repo", "discrepancy"], "left_semi"), "unique")
    kpis = cut_lineage(branches.commit_kpis(directed, branches.commit_counts(unique, commit_files)), "kpis")
    details = cut_lineage(branches.commit_details(unique, commits, commit_files), "details")
    evidence = details.select(
        "repo", F.lit("commit").alias("drift_type"), "discrepancy", F.col("commit").cast("string").alias("commit_sha"),
        F.col("created_at").alias("commit_date"), "author", "file_path", F.lit(None).cast("string").alias("change_type"),
        "problem_statement",
    )
    return Report(
        "commit_drift",
        {"branch_drift_evidence": evidence, "branch_drift_kpis": kpis},
        {
            "commit_counts": (branches.commit_matrix(kpis, presence), list(branches.SORT_MATRIX)),
            "file_counts": (branches.file_matrix_commit(kpis, presence), list(branches.SORT_MATRIX)),
            "details": (details, list(branches.SORT_COMMIT_DETAILS)),
            "totals": (kpis, list(branches.SORT_TOTALS)),
        },
    )


def file_drift(
    repos: DataFrame, tips: DataFrame, branch_files: DataFrame, base_files: DataFrame | None, bases: DataFrame | None,
    meta: DataFrame, mode: str = MERGE_BASE,
) -> Report:
    """Content differences in all six directions, from merge bases or between tips."""
    presence = branches.branch_presence(repos, tips)
    directed = branches.content_status(branches.repo_directions(presence), None if mode == DIRECT else bases)
    wide = branches.wide_files(branch_files, None if mode == DIRECT else base_files)
    complete = directed.where(F.col("status") == "ok").select("repo", "discrepancy")
    diff = branches.tree_diff(wide, mode).join(complete, ["repo", "discrepancy"], "left_semi")
    diff = cut_lineage(branches.with_renames(diff, mode=mode), "renamed")
    kpis = cut_lineage(branches.file_kpis(directed, branches.difference_counts(diff), mode), "kpis")
    details = cut_lineage(branches.content_details(diff, meta, branch_files, mode), "details")
    blank = F.lit("")
    evidence = details.select(
        "repo", F.lit("content").alias("drift_type"), "discrepancy",
        F.nullif("last_change_commit", blank).alias("commit_sha"),
        F.try_to_timestamp(F.nullif("last_change_at", blank)).alias("commit_date"),
        F.nullif("last_change_author", blank).alias("author"), "file_path",
        F.col("raw_change_type").alias("change_type"), "problem_statement",
    )
    return Report(
        "file_drift",
        {"branch_drift_evidence": evidence, "branch_drift_kpis": kpis},
        {
            "file_counts": (branches.file_matrix_content(kpis, presence), list(branches.SORT_MATRIX)),
            "details": (details, list(branches.SORT_CONTENT_DETAILS)),
            "totals": (kpis, list(branches.SORT_TOTALS)),
        },
    )


def catalog_findings(
    catalog: DataFrame, catalog_columns: DataFrame, parsed: DataFrame, models: DataFrame
) -> DataFrame:
    """All catalog findings of a product set; ``parsed`` comes from ``ddl_files``.

    Texts are parsed and the catalog is united once; the five comparisons read
    the written results. Texts of files that define nothing are left behind.
    """
    defines = F.col("dataset").isNotNull()
    parsed = cut_lineage(parsed.withColumn("text", F.when(defines, F.col("text"))), "parsed")
    catalog, ddl = cut_lineage(catalog, "catalog"), cut_lineage(inventory.ddl_inventory(parsed), "ddl")
    models = cut_lineage(models, "models")
    frames = [
        reconcile.only_in_catalog(catalog, ddl, models),
        reconcile.only_in_source(catalog, ddl, models),
        reconcile.type_mismatch(catalog, ddl),
        reconcile.schema_mismatch(inventory.ddl_columns(parsed), catalog_columns),
        reconcile.definition_mismatch(catalog, inventory.view_fragments(parsed, ddl).join(
            catalog.select("product", "project").distinct(), "product")),
    ]
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def numbered(catalog_side: DataFrame, file_side: DataFrame) -> DataFrame:
    """Numbered lines of all findings, catalog findings first; the former carry source paths."""
    rows = catalog_side.unionByName(file_side, allowMissingColumns=True)
    seq = F.struct("product", F.coalesce("dataset", F.lit("")).alias("dataset"), "name", "status")
    section = F.when(F.col("area") == "gcs", F.lit(1)).otherwise(F.lit(0)).alias("section")
    return render_findings(rows.select(section, seq.alias("seq"), "status", "name", "source_technology", "source_path", "details"))


def out_of(products: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows of other products."""
    return rows.join(products.select("product"), "product", "left_anti")


def env_drift(
    catalog: DataFrame, catalog_columns: DataFrame, parsed: DataFrame, models: DataFrame,
    source_files: DataFrame, deployed_files: DataFrame,
    targets: DataFrame | None = None, warnings: DataFrame | None = None, allow_empty: bool = False,
) -> Report:
    """Source definitions and files against the catalog and the file store.

    Findings are one row each in the CSV files, the numbered report and the
    ledger; the columns and the source paths behind them are tables of their own.

    ``targets`` (see ``inventory.resolve_targets``) are written as the run's settings. A product without datasets is an
    error, or, where ``allow_empty``, its catalog side is skipped and a warning says so; definitions of such a product
    are no findings. ``warnings`` (product, warning) of earlier steps are written with those.
    """
    extra = {}
    warned = warnings
    if targets is not None:
        empty = cut_lineage(inventory.without_targets(targets), "empty")
        if not allow_empty and not empty.isEmpty():
            raise ValueError(f"{NO_DATASETS} Products: {[r.product for r in empty.select('product').orderBy('product').limit(5).collect()]}, …")
        catalog, catalog_columns = out_of(empty, catalog), out_of(empty, catalog_columns)
        warned = empty if warnings is None else empty.unionByName(warnings.select("product", "warning"))
        extra["settings"] = (targets, ["product"])
    if warned is not None:
        extra["warnings"] = (warned, ["product", "warning"])
    # Each step feeds several outputs: it is computed once, when the first of them is read.
    read = cache(lambda: (cut_lineage(parsed, "parsed"), cut_lineage(models, "models")))
    sources = cache(lambda: read() if targets is None else tuple(out_of(empty, rows) for rows in read()))
    in_catalog = cache(lambda: cut_lineage(catalog_findings(catalog, catalog_columns, *sources()), "findings"))
    in_files = cache(lambda: cut_lineage(reconcile.compare_files(source_files, deployed_files), "findings"))
    with_source = cache(lambda: cut_lineage(reconcile.finding_sources(in_catalog(), *read()), "sources"))
    inventories = cache(lambda: cut_lineage(inventory.ddl_inventory(read()[0]), "ddl"))

    def summary() -> DataFrame:
        return count_rows(
            bigquery_findings=in_catalog(), gcs_findings=in_files(), source_bq_objects=inventories(),
            source_dbt_models=read()[1], source_files=source_files, actual_bq_objects=catalog, actual_gcs_objects=deployed_files,
        )

    def snapshot() -> dict[str, DataFrame]:
        return {
            "bigquery_findings": with_source(), "gcs_findings": in_files(), "source_bq_objects": inventories(),
            "source_dbt_models": read()[1], "source_files": source_files, "actual_gcs_objects": deployed_files,
            "actual_bq_objects": catalog.drop("ddl", "view_query", "definition_body"),
        }

    return Report(
        "env_drift",
        Frames(env_drift_findings=lambda: reconcile.ledger_findings(in_catalog(), in_files())),
        Frames(
            bigquery_findings=lambda: (with_source(), ["status", "name"]),
            schema_columns=lambda: (reconcile.column_diff(inventory.ddl_columns(sources()[0]), catalog_columns), [*inventory.OBJECT, "column_name"]),
            source_paths=lambda: (reconcile.source_paths(in_catalog(), *read()), ["product", "name", "path"]),
            gcs_findings=lambda: (in_files(), ["name"]),
            summary=lambda: (summary(), []),
            **extra,
        ),
        Frames(findings=lambda: numbered(with_source(), in_files())),
        Frames(snapshot=snapshot),
    )


def orphan_datasets(
    datasets: DataFrame, objects: DataFrame, ci_texts: DataFrame, include: str = ".*", exclude: str | None = "^_"
) -> Report:
    """Catalog datasets that no repository declares, with the objects they hold.

    ``datasets`` holds dataset, project_id and error, the text of a partly
    failed scan; objects of such a dataset are kept as far as they were read.
    Owner and last change of datasets, and last change, rows and storage of
    objects go to the ledger where the inputs have them.
    """
    datasets = filter_names(datasets, "dataset", include, exclude)
    declared = cut_lineage(inventory.repo_datasets(ci_texts), "declared")
    refs = inventory.dataset_refs(declared)
    unmatched = cut_lineage(inventory.unmatched_datasets(datasets, refs, include, exclude), "unmatched")
    held = cut_lineage(inventory.unmatched_objects(objects, unmatched), "held")
    counts = cut_lineage(inventory.type_counts(held), "counts")
    listing = unmatched.join(counts, "dataset", "left").select(
        "dataset", F.coalesce("object_count", F.lit(0)).alias("object_count"),
        F.coalesce(F.to_json("object_type_counts"), F.lit("{}")).alias("object_type_counts"),
        F.coalesce("error", F.lit("")).alias("error"),
    )
    errors = inventory.dataset_errors(unmatched)
    summary = count_rows(
        datasets_scanned=datasets, repos_scanned=ci_texts, repos_with_dataset_refs=declared.where("dataset_count > 0"),
        datasets_referenced=refs.select("dataset").distinct(), unmatched_datasets=unmatched, datasets_with_errors=errors,
    )
    return Report(
        "orphan_datasets",
        {"orphan_dataset_objects": inventory.orphan_object_rows(held), "orphan_datasets": inventory.orphan_rows(unmatched, counts)},
        {
            "unmatched_datasets": (listing, ["dataset"]),
            "unmatched_objects": (held, ["dataset", "object_name"]),
            "dataset_errors": (errors, ["dataset"]),
            "repo_dataset_references": (declared.drop("names"), ["repo"]),
            "summary": (summary, []),
        },
        snapshots={
            "snapshot": {
                "unmatched_datasets": listing, "unmatched_objects": held, "dataset_errors": errors,
                "repo_dataset_references": declared.drop("names"),
            }
        },
    )


def publish(
    spark: SparkSession, report: Report, base: str, prefix: str, execution_id: str, as_of: datetime, **run
) -> bool:
    """Write the report files, then the ledger rows, the run record last.

    Returns False, and writes nothing, when the ledger already holds this id.
    A failing write leaves a ``failed`` run record and raises again.
    """
    folder = run_path(prefix, execution_id, report.report_type)
    record = {
        "execution_id": execution_id, "report_type": report.report_type, "execution_ts": as_of, "source_mode": "branch",
        "environment": "prod", "git_ref": None, "triggered_by": "ui", "duration_seconds": None, "gcs_path": f"{prefix}/{execution_id}/", **run,
    }

    def run_row(status: str) -> DataFrame:
        return stamp(spark.range(1), **record, status=status).drop("id")

    if new_runs(run_row("success"), read_ledger(spark, base, "executions"), as_of).isEmpty():
        return False
    try:
        for name, (frame, order) in report.files.items():
            write_report_csv(frame, order, f"{folder}/{name}")
        for name, lines in report.texts.items():
            write_text_report(lines, ["finding_number"], f"{folder}/{name}")
        for name, sections in report.snapshots.items():
            write_snapshot_json(sections, f"{folder}/{name}")
        stamped = {
            name: stamp(rows, execution_id=execution_id, run_date=as_of.date()) for name, rows in report.ledger.items()
        }
        return record_run(spark, base, run_row("success"), stamped, as_of)
    except Exception:
        record_run(spark, base, run_row("failed"), {}, as_of)
        raise
