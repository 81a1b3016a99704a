import json
import os
from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from plumbline.operators import inventory, runs
from plumbline.operators.executive import count_rows, message_signals
from plumbline.operators.skew import rank_within
from plumbline.plans import dashboards, reports, tiles
from plumbline.sources import files, ledger
from plumbline.sources import reports as sinks
from plumbline.sources.schemas import LEDGER
from plumbline.streaming import ledger_stream
from tests.conftest import rows

RUN = "execution_id string, report_type string, execution_ts timestamp, status string"


def test_schemas():
    assert [f.name for f in LEDGER["executions"].schema if not f.nullable] == ["execution_id", "report_type", "execution_ts"]
    assert len(LEDGER) == 7 and LEDGER["orphan_dataset_objects"].schema["storage_mb"].dataType.simpleString() == "double"


def test_append_and_guard(spark, table, tmp_path):
    base, as_of = str(tmp_path), datetime(2024, 1, 10)
    run = table(RUN, ("id1", "commit_drift", as_of, "success"))
    evidence = table("execution_id string, run_date date, repo string", ("id1", date(2024, 1, 10), "r"))
    assert ledger.read_ledger(spark, base, "executions").count() == 0
    assert ledger.record_run(spark, base, run, {"branch_drift_evidence": evidence}, as_of)
    assert not ledger.record_run(spark, base, run, {"branch_drift_evidence": evidence}, as_of)
    assert ledger.read_ledger(spark, base, "executions").count() == 1
    assert ledger.read_ledger(spark, base, "branch_drift_evidence").count() == 1
    assert os.path.isdir(tmp_path / "executions" / "execution_day=2024-01-10")
    # Three days later the id counts as new again.
    later = datetime(2024, 1, 13)
    assert ledger.record_run(spark, base, run.withColumn("execution_ts", F.lit(later)), {}, later)
    assert ledger.read_ledger(spark, base, "executions").count() == 2


def test_required_columns(table, tmp_path):
    with pytest.raises(Exception, match="executions.execution_id is required"):
        ledger.append_ledger(table(RUN, (None, "x", datetime(2024, 1, 1), "ok")), str(tmp_path), "executions")


def test_guard_prunes_days(spark, table, tmp_path):
    base = str(tmp_path)
    ledger.append_ledger(table(RUN, *[(str(i), "x", datetime(2024, 1, i), "success") for i in range(1, 20)]), base, "executions")
    new = ledger.new_runs(table(RUN, ("5", "x", datetime(2024, 1, 19), "ok")), ledger.read_ledger(spark, base, "executions"), datetime(2024, 1, 19))
    assert "execution_day" in plan(new).split("PartitionFilters")[1].split("]")[0]


def plan(df):
    return df._jdf.queryExecution().toString()


def test_latest_run_filter_reaches_the_scan(spark, table, tmp_path):
    base = str(tmp_path)
    ledger.append_ledger(table("execution_id string, run_date date, repo string", *[(str(i), date(2024, 1, i + 1), "r") for i in range(5)]), base, "branch_drift_evidence")
    log = table(RUN, *[(str(i), "commit_drift", datetime(2024, 1, i + 1), "success") for i in range(5)], ("9", "commit_drift", datetime(2024, 2, 1), "failed"))
    slice_ = runs.at_latest(ledger.read_ledger(spark, base, "branch_drift_evidence"), runs.latest_run(log, "commit_drift"), ["execution_ts"])
    assert "execution_id" in plan(slice_).split("DataFilters")[1].split("]")[0]  # by the id alone: other days count too
    assert [r.execution_id for r in slice_.collect()] == ["4"]
    text = plan(slice_)
    assert "BroadcastHashJoin" in text and "DataFilters: [isnotnull(execution_id" in text and "CartesianProduct" not in text


def test_ties_are_broken_by_id(table):
    log = table(RUN, ("b", "x", datetime(2024, 1, 1), "success"), ("a", "x", datetime(2024, 1, 1), "success"))
    assert runs.latest_run(log, "x").first().execution_id == "a"
    assert runs.latest_per_type(log).first().execution_id == "a"
    assert runs.run_exists(log, "b") and not runs.run_exists(log, "c")


def test_success_rate_counts_skipped(table):
    log = table(RUN, *[(str(i), "x", datetime(2024, 1, 1, i), s) for i, s in enumerate(["success", "failed", "skipped", "success"])])
    assert rows(runs.daily_summary(log)) == [(date(2024, 1, 1), "x", 2, 1, 4, 0.5)]


def test_rank_within_hot_key(spark):
    df = spark.range(2000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.concat(F.lit("k"), (F.col("id") % 100).cast("string"))).alias("k"), F.col("id"))
    found = rank_within(df, ["k"], ["id"], "n").collect()
    by_key = {}
    for r in found:
        by_key.setdefault(r.k, []).append((r.id, r.n))
    assert all([n for _, n in sorted(v)] == list(range(1, len(v) + 1)) for v in by_key.values())
    assert sorted(r.n for r in rank_within(df, [], ["id"], "n").collect()) == list(range(1, 2001))


def test_csv_and_json(spark, table, tmp_path):
    df = table("a string, b string", ("2", 'q"uote'), ("1", "x,y"), ("3", None), ("4", "  two\nlines\r\n, \"so\"  "))
    sinks.write_report_csv(df, ["a"], str(tmp_path / "csv"))
    assert rows(sinks.read_report_csv(spark, str(tmp_path / "csv"))) == rows(df)
    sinks.write_union_csv([df, table("c string", ("z",))], str(tmp_path / "union"))
    assert sinks.read_report_csv(spark, str(tmp_path / "union")).columns == ["a", "b", "c"]
    sinks.write_snapshot_json({"one": df, "two": table("c string", ("z",))}, str(tmp_path / "json"))
    back = spark.read.json(str(tmp_path / "json"))
    assert {r.section: json.loads(r.record) for r in back.where("section = 'two'").collect()} == {"two": {"c": "z"}}


def test_numbered_findings(spark, table, tmp_path):
    findings = table(
        "section int, seq string, status string, name string, source_technology string, source_path string, details string",
        (1, "a", "only_in_gcs", "dbt/x", "dbt", None, "gone"), (0, "b", "only_in_bq", "t", None, None, None), (0, "a", "type_mismatch", "s", "bq", "f.sql", "d"),
    )
    lines = sinks.render_findings(findings)
    assert [r.line for r in lines.orderBy("finding_number").collect()] == [
        "1. `type_mismatch` `s` [source=bq] [source_path=f.sql]: d", "2. `only_in_bq` `t` [source=unknown]: None", "3. `only_in_gcs` `dbt/x` [source=dbt]: gone",
    ]
    sinks.write_text_report(lines, ["finding_number"], str(tmp_path / "text"))
    assert spark.read.text(str(tmp_path / "text")).count() == 3


def test_file_tree(spark, tmp_path):
    for path, content in {"dbt/models/a.sql": b"select 1\r\n", "dbt/.gitkeep": b"", "python/b.py": b"x", "bq/c.sql": b"y"}.items():
        os.makedirs((tmp_path / path).parent, exist_ok=True)
        (tmp_path / path).write_bytes(content)
    tree = files.scan_tree(spark, str(tmp_path))
    assert sorted(r.path for r in tree.collect()) == ["bq/c.sql", "dbt/models/a.sql", "python/b.py"]
    assert {r.path: r.size_bytes for r in files.file_inventory(tree).collect()} == {"dbt/models/a.sql": 10, "python/b.py": 1}
    assert sorted((r.path, r.text) for r in files.scan_text(spark, str(tmp_path), "*.sql").collect()) == [("bq/c.sql", "y"), ("dbt/models/a.sql", "select 1\r\n")]


def test_stream_drops_repeats_and_replays(spark, table, tmp_path):
    source = str(tmp_path / "in")
    table(RUN, ("a", "x", datetime(2024, 1, 1), "success"), ("a", "x", datetime(2024, 1, 1, 5), "success"), ("b", "x", datetime(2024, 1, 2), "failed")).write.parquet(source)
    for _ in range(2):
        stream = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        ledger_stream.ingest_runs(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
        daily = spark.readStream.schema(spark.read.parquet(source).schema).parquet(source)
        ledger_stream.run_daily_summary(daily, str(tmp_path / "day"), str(tmp_path / "day_state")).awaitTermination()
        table(RUN, ("a", "x", datetime(2024, 1, 1, 6), "success"), ("c", "x", datetime(2024, 1, 2), "success")).write.mode("append").parquet(source)
    found = ledger_stream.read_ingested(spark, str(tmp_path / "out"))
    assert sorted(r.execution_id for r in found.collect()) == ["a", "b", "c"]
    assert rows(ledger_stream.read_daily_summary(spark, str(tmp_path / "day"))) == [(date(2024, 1, 1), "x", 3, 0, 3, 1.0), (date(2024, 1, 2), "x", 1, 1, 2, 0.5)]


def test_late_runs_are_kept(spark, table, tmp_path):
    source, out, day = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "day")
    for n, at in enumerate((20, 21, 10, 22)):
        table(RUN, (f"r{n}", "x", datetime(2024, 1, at), "success"), ("r0", "x", datetime(2024, 1, 20), "success")).coalesce(1).write.mode("append").parquet(source)
        for start, folder in ((ledger_stream.ingest_runs, out), (ledger_stream.run_daily_summary, day)):
            start(spark.readStream.schema(spark.read.parquet(source).schema).parquet(source), folder, f"{folder}_state").awaitTermination()
    assert sorted(r.execution_id for r in ledger_stream.read_ingested(spark, out).collect()) == ["r0", "r1", "r2", "r3"]
    assert {r.execution_date.day: r.total_count for r in ledger_stream.read_daily_summary(spark, day).collect()} == {10: 1, 20: 5, 21: 1, 22: 1}
    for _ in range(2):
        ledger_stream.publish_ingested(spark, out, str(tmp_path / "ledger"))
    assert ledger.read_ledger(spark, str(tmp_path / "ledger"), "executions").count() == 4


def test_commit_report_end_to_end(spark, table, tmp_path):
    repos = table("repo string", ("r",))
    tips = table("repo string, branch string, sha string", ("r", "master", "a"), ("r", "test", "b"))
    parents = table("repo string, sha string, parent_sha string, parent_index int", ("r", "a", None, 0), ("r", "b", "a", 0))
    commits = table(
        "repo string, sha string, patch_id string, is_merge boolean, authored_at timestamp, author string, author_email string, message string",
        ("r", "a", "p", False, datetime(2024, 1, 1), "x", "x@y", "m"), ("r", "b", "q", False, datetime(2024, 1, 2), "x", "x@y", "m"),
    )
    touched = table("repo string, sha string, path string, change_code string", ("r", "b", "f1", "A"), ("r", "b", "f2", "M"))
    report = reports.commit_drift(repos, tips, parents, commits, touched)
    base, prefix = str(tmp_path / "ledger"), str(tmp_path / "out")
    for wrote in (True, False):
        assert reports.publish(spark, report, base, prefix, "run1", datetime(2024, 1, 5)) is wrote
    read = {n: ledger.read_ledger(spark, base, n) for n in ("executions", "branch_drift_kpis", "branch_drift_evidence")}
    assert (read["executions"].count(), read["branch_drift_kpis"].count(), read["branch_drift_evidence"].count()) == (1, 6, 2)
    shown = dashboards.commit_kpi_report(read["executions"], read["branch_drift_kpis"], read["branch_drift_evidence"]).collect()
    assert [(r.drift_direction, r.unique_commits, r.unique_files, r.severity, r.distinct_authors) for r in shown] == [
        ("test not in master", 1, 2, "low", 1), ("master not in test", 0, 0, "none", None),
    ]
    details = sinks.read_report_csv(spark, f"{prefix}/run1/commit_drift/details")
    assert [(r.file_path, r.discrepancy) for r in details.orderBy("file_path").collect()] == [("f1", "test_not_in_master"), ("f2", "test_not_in_master")]


def test_orphan_report_end_to_end(spark, table, tmp_path):
    datasets = table("dataset string, project_id string, error string", ("a", "p", None), ("b", "p", "tables: denied"), ("c", "p", None), ("_x", "p", None))
    objects = table("dataset string, object_name string, object_type string", ("b", "t", "view"), ("a", "t", "view"))
    ci = table("repo string, git_ref string, text string", ("r", "production", "variables:\n  BQ_DATASET_NAMES: a\n"))
    report = reports.orphan_datasets(datasets, objects, ci)
    base, prefix = str(tmp_path / "ledger"), str(tmp_path / "out")
    assert reports.publish(spark, report, base, prefix, "run1", datetime(2024, 1, 5))
    read = {n: ledger.read_ledger(spark, base, n) for n in ("executions", "orphan_datasets", "orphan_dataset_objects")}
    shown = dashboards.orphan_summary_report(read["executions"], read["orphan_datasets"], read["orphan_dataset_objects"], date(2024, 3, 1)).collect()
    assert [(r.dataset_name, r.risk_score, r.reported_table_count, r.scanned_views) for r in shown] == [("b", 2, 1, 1), ("c", 1, 0, 0)]
    csv = {n: sinks.read_report_csv(spark, f"{prefix}/run1/orphan_datasets/{n}").collect() for n in ("unmatched_datasets", "dataset_errors", "summary")}
    assert [(r.dataset, r.object_type_counts) for r in csv["unmatched_datasets"]] == [("b", '{"view":1}'), ("c", "{}")]
    assert [(r.dataset, r.error) for r in csv["dataset_errors"]] == [("b", "tables: denied")]
    assert (csv["summary"][0].datasets_scanned, csv["summary"][0].unmatched_datasets, csv["summary"][0].datasets_with_errors) == ("3", "2", "1")


def test_env_report_end_to_end(spark, table, tmp_path):
    catalog = table(
        "product string, project string, dataset string, object_name string, object_type string, ddl string, view_query string, definition_body string, column_count int",
        ("p", "pr", "d", "t", "base_table", None, None, None, 1), ("p", "pr", "d", "gone", "base_table", None, None, None, 0),
    )
    columns = table("product string, project string, dataset string, object_name string, column_name string, data_type string", ("p", "pr", "d", "t", "b", "INT64"))
    texts = table("product string, path string, text string", ("p", "bq/1.sql", "create table d.t (a INT64);"), ("p", "bq/2.sql", "alter table d.t add column b INT64"))
    models = inventory.model_inventory(texts.where("false"))
    tree = table("product string, path string, content binary", ("p", "dbt/x.sql", bytearray(b"1")), ("p", "dbt/y.sql", bytearray(b"2")))
    report = reports.env_drift(catalog, columns, inventory.ddl_files(texts), models, files.file_inventory(tree), files.file_inventory(tree.where("path like '%x.sql'")))
    base, prefix = str(tmp_path / "ledger"), str(tmp_path / "out")
    assert reports.publish(spark, report, base, prefix, "run1", datetime(2024, 1, 5))
    folder = f"{prefix}/run1/env_drift"
    lines = sorted(r.value for r in spark.read.text(f"{folder}/findings").collect())
    assert len(lines) == 3 and lines[1].startswith("2. `schema_mismatch` `t` [source=bq] [source_path=bq/1.sql]: missing_in_prod=1") and "dbt/y.sql" in lines[2]
    assert sorted(r.path for r in sinks.read_report_csv(spark, f"{folder}/source_paths").collect()) == ["bq/1.sql", "bq/2.sql"]
    assert [(r.column_name, r.difference) for r in sinks.read_report_csv(spark, f"{folder}/schema_columns").collect()] == [("a", "missing")]
    sections = {r.section: r.n for r in spark.read.json(f"{folder}/snapshot").groupBy("section").agg(F.count("*").alias("n")).collect()}
    assert sections == {"bigquery_findings": 2, "gcs_findings": 1, "source_bq_objects": 1, "source_files": 2, "actual_gcs_objects": 1, "actual_bq_objects": 2}
    assert ledger.read_ledger(spark, base, "env_drift_findings").count() == 3


def test_file_report_end_to_end(spark, table, tmp_path):
    repos, tips = table("repo string", ("r",)), table("repo string, branch string, sha string", ("r", "master", "a"), ("r", "test", "b"))
    branch_files = table("repo string, branch string, path string, blob_hash string", ("r", "master", "x", "1"), ("r", "test", "x", "2"), ("r", "test", "y", "3"))
    bases = table("repo string, left_name string, right_name string", ("r", "master", "test"))
    base_files = table("repo string, left_name string, right_name string, path string, blob_hash string", ("r", "master", "test", "x", "1"))
    facts = ["commit", "at", "author", "author_email", "message"]
    names = ", ".join(f"{p}_{f} string" for p in ("created", "last_change") for f in facts)
    meta = table(f"repo string, branch string, path string, {names}", ("r", "test", "x", *["c0", "2024-01-01", "n", "m", "t"], *["c1", "2024-01-02 03:00:00", "ann", "m", "t"]))
    report = reports.file_drift(repos, tips, branch_files, base_files, bases, meta)
    base = str(tmp_path / "ledger")
    assert reports.publish(spark, report, base, str(tmp_path / "out"), "run1", datetime(2024, 1, 5))
    read = {n: ledger.read_ledger(spark, base, n) for n in ("executions", "branch_drift_kpis", "branch_drift_evidence")}
    shown = dashboards.file_kpi_report(read["executions"], read["branch_drift_kpis"], read["branch_drift_evidence"]).collect()
    assert [(r.drift_direction, r.unique_files, r.files_added, r.files_modified, r.distinct_authors) for r in shown] == [
        ("test differs from master", 2, 1, 1, 1), ("master differs from test", 0, None, None, None),
    ]
    assert {r.file_path: (r.commit_sha, r.commit_date) for r in read["branch_drift_evidence"].collect()} == {"x": ("c1", datetime(2024, 1, 2, 3)), "y": (None, None)}


def test_failed_run_is_recorded(spark, table, tmp_path):
    broken = table("repo string", ("r",)).withColumn("x", F.raise_error(F.lit("boom")).cast("string"))
    report = reports.Report("commit_drift", {}, {"details": (broken, ["repo"])})
    with pytest.raises(Exception, match="boom"):
        reports.publish(spark, report, str(tmp_path / "l"), str(tmp_path / "o"), "run2", datetime(2024, 1, 5))
    assert [r.status for r in ledger.read_ledger(spark, str(tmp_path / "l"), "executions").collect()] == ["failed"]


def test_risk_buckets_and_signals(table):
    scores = table("risk_score bigint", *[(n,) for n in (0, 25, 26, 50, 51, 75, 76, 100, 101)])
    assert rows(tiles.risk_histogram(scores)) == [("0-25", 2), ("101+", 1), ("26-50", 2), ("51-75", 2), ("76-100", 2)]
    messages = table("message string", ("REVERT it",), ("revert cherry-pick",), (None,))
    assert dict(rows(message_signals(messages)))["revert"] == 2 and dict(rows(message_signals(messages)))["major:"] == 0
    assert rows(count_rows(a=messages, b=scores)) == [(3, 9)]


def test_env_report_without_target_datasets(table):
    """A product without datasets is an error, or its catalog side is skipped with a warning."""
    catalog = table(
        "product string, project string, dataset string, object_name string, object_type string, ddl string, view_query string, definition_body string, column_count int",
        ("p", "pr", "d", "gone", "base_table", None, None, None, 0),
    )
    columns = table("product string, project string, dataset string, object_name string, column_name string, data_type string")
    texts = table("product string, path string, text string", ("p", "bq/1.sql", "create table d.t (a INT64);"), ("q", "bq/2.sql", "create table d.u (a INT64);"))
    tree = files.file_inventory(table("product string, path string, content binary", ("q", "dbt/x.sql", bytearray(b"1"))))
    targets = table("product string, project string, environment string, bucket string, datasets string", ("p", "x", "prod", "b", "d"), ("q", "x", "prod", "b", ""))
    inputs = (catalog, columns, inventory.ddl_files(texts), inventory.model_inventory(texts.where("false")), tree, tree.where("false"))
    with pytest.raises(ValueError, match="No datasets"):
        reports.env_drift(*inputs, targets=targets)
    report = reports.env_drift(*inputs, targets=targets, allow_empty=True)
    found = sorted((r.product, r.status, r.name.split(".")[-1]) for r in report.files["bigquery_findings"][0].collect())
    assert [(p, n) for p, _, n in found] == [("p", "gone"), ("p", "t")]
    assert report.files["gcs_findings"][0].count() == 1
    assert [r.product for r in report.files["warnings"][0].collect()] == ["q"]
    assert report.files["settings"][0].count() == 2
    plain = reports.env_drift(*inputs)
    assert "u" in {r.name.split(".")[-1] for r in plain.files["bigquery_findings"][0].collect()} and "warnings" not in plain.files


def test_steps_are_made_when_read(table, monkeypatch):
    """Warnings alone compare nothing; a step that several outputs share is computed once."""
    catalog = table("product string, project string, dataset string, object_name string, object_type string, ddl string, view_query string", ("p", "x", "d", "t", "table", "create table t", ""))
    columns = table("product string, dataset string, object_name string, column_name string, data_type string")
    texts = table("product string, path string, text string", ("p", "bq/o.sql", "create view `x.d.o` as select 1"))
    models = table("product string, path string, text string")
    tree = table("product string, path string, content binary", ("p", "python/a.py", b"a"))
    targets = table("product string, project string, environment string, bucket string, datasets string", ("q", "x", "prod", "b", ""))
    made = []
    cut = reports.cut_lineage
    monkeypatch.setattr(reports, "cut_lineage", lambda df, label="step": made.append(label) or cut(df, label))
    inputs = (catalog, columns, inventory.ddl_files(texts), inventory.model_inventory(models), files.file_inventory(tree), files.file_inventory(tree))
    report = reports.env_drift(*inputs, targets=targets, allow_empty=True)
    assert [r.product for r in report.files["warnings"][0].collect()] == ["q"] and made == ["empty"]
    assert report.files["summary"][0].first().source_bq_objects == 1 and "sources" not in made
    assert report.files["bigquery_findings"][0].count() == 2 and made.count("findings") == 2
    assert [name for name, _ in report.files.items()] == [*report.files] and made.count("findings") == 2


def test_few_read_tasks_do_not_bound_parsing(spark, table):
    texts = table("product string, path string, text string", *[("p", f"bq/{i}.sql", "create view `x.d.o` as select 1") for i in range(48)]).coalesce(1)
    rows = inventory.ddl_files(texts)
    busy = rows.select(F.spark_partition_id().alias("at")).distinct().count()
    assert rows.count() == 48 and busy > spark.sparkContext.defaultParallelism
