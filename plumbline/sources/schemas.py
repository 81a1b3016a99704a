"""Ledger tables: columns, required columns and layout."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

STRING, LONG, DOUBLE, BOOL = T.StringType(), T.LongType(), T.DoubleType(), T.BooleanType()
DATE, INSTANT = T.DateType(), T.TimestampType()


@dataclass(frozen=True)
class LedgerTable:
    schema: T.StructType
    day: str | None = None  # partition column
    day_of: str | None = None  # timestamp the partition column is derived from
    cluster: tuple[str, ...] = ()


def _schema(required: list[tuple], optional: list[tuple], order: list[str]) -> T.StructType:
    fields = {name: T.StructField(name, kind, False) for name, kind in required}
    fields.update({name: T.StructField(name, kind, True) for name, kind in optional})
    return T.StructType([fields[name] for name in order])


def _table(spec: str, kinds: dict, **layout) -> LedgerTable:
    """``spec`` lists columns in order; ``!`` marks required ones; STRING unless in ``kinds``."""
    names = spec.split()
    order = [name.rstrip("!") for name in names]
    required = [(n.rstrip("!"), kinds.get(n.rstrip("!"), STRING)) for n in names if n.endswith("!")]
    optional = [(n, kinds.get(n, STRING)) for n in names if not n.endswith("!")]
    return LedgerTable(_schema(required, optional, order), **layout)


LEDGER = {
    "executions": _table(
        "execution_id! report_type! execution_ts! environment git_ref source_mode triggered_by status"
        " duration_seconds gcs_path",
        {"execution_ts": INSTANT, "duration_seconds": LONG},
        day="execution_day",
        day_of="execution_ts",
    ),
    "entities": _table("entity_id! entity_type! name! domain owner lifecycle", {}),
    "branch_drift_kpis": _table(
        "execution_id! run_date repo! left_branch right_branch drift_type comparison_mode unique_commits"
        " unique_files severity status",
        {"run_date": DATE, "unique_commits": LONG, "unique_files": LONG},
        day="run_date",
        cluster=("repo", "drift_type"),
    ),
    "branch_drift_evidence": _table(
        "execution_id! run_date repo drift_type discrepancy commit_sha commit_date author file_path"
        " change_type problem_statement",
        {"run_date": DATE, "commit_date": INSTANT},
        day="run_date",
        cluster=("repo", "discrepancy"),
    ),
    "env_drift_findings": _table(
        "execution_id! product component_type object_type object_name drift_category source_hash env_hash severity",
        {},
        cluster=("product", "component_type"),
    ),
    "orphan_datasets": _table(
        "execution_id! dataset_name! project_id orphan_status source_reference_found last_modified"
        " table_count owner risk_score",
        {"source_reference_found": BOOL, "last_modified": INSTANT, "table_count": LONG, "risk_score": LONG},
        cluster=("orphan_status",),
    ),
    "orphan_dataset_objects": _table(
        "execution_id! dataset_name! object_type object_name last_modified row_count storage_mb",
        {"last_modified": INSTANT, "row_count": LONG, "storage_mb": DOUBLE},
    ),
}
