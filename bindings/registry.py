"""Registry of bound queries and the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from bindings.views import Views, with_views

QUERIES: dict[str, Callable[[Views], DataFrame]] = {}
CHECKS: dict[str, str] = {}

# Views only the checking SQL needs: the latest successful run of each report.
CHECK_VIEWS = {
    f"latest_{short}": (
        f"SELECT * FROM {{executions}} WHERE report_type = '{report}' AND status = 'success'"
        " ORDER BY execution_ts DESC, execution_id LIMIT 1"
    )
    for short, report in {
        "commit": "commit_drift",
        "file": "file_drift",
        "env": "env_drift",
        "orphan": "orphan_datasets",
    }.items()
}


def query(name: str, sql: str | None = None):
    """Register a function of the views under ``name``, with its checking SQL if there is one."""

    def register(function: Callable[[Views], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = function
        if sql is not None:
            CHECKS[name] = with_views(sql, CHECK_VIEWS)
        return function

    return register


def bound() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(function):
        return lambda spark, sf_dir: function(Views(spark, sf_dir))

    return {name: bind(function) for name, function in QUERIES.items()}
