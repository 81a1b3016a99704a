import pytest
from pyspark.sql import functions as F

from plumbline.operators import reconcile
from plumbline.sources.catalog import catalog_inventory
from plumbline.sources.files import deployed_inventory
from tests.conftest import rows

FILES = "product string, path string, compare_hash string"
COLUMNS = "product string, dataset string, object_name string, column_name string, data_type string"
DDL = "product string, dataset string, object_name string, object_type string"
CATALOG = "product string, project string, dataset string, object_name string, object_type string, ddl string, view_query string"
MODELS = "product string, object_name string, relative_path string, materialized string"


def brief(df):
    return sorted((r.name, r.status, r.severity) for r in df.collect())


def test_compare_files(table):
    source = table(FILES, ("p", "dbt/a", "1"), ("p", "dbt/b", "1"), ("p", "python/c", "1"), ("q", "dbt/a", "1"))
    deployed = table(FILES, ("p", "dbt/a", "1"), ("p", "dbt/b", "2"), ("p", "dbt/d", "1"))
    found = {(r.product, r.name): (r.status, r.severity, r.source_technology, r.source_hash, r.env_hash) for r in reconcile.compare_files(source, deployed).collect()}
    assert found == {
        ("p", "dbt/b"): ("content_mismatch", "high", "dbt", "1", "2"),
        ("p", "python/c"): ("only_in_source", "medium", "python", "1", None),
        ("p", "dbt/d"): ("only_in_gcs", "high", "dbt", None, "1"),
        ("q", "dbt/a"): ("only_in_source", "medium", "dbt", "1", None),
    }
    assert rows(reconcile.compare_files(source, source)) == []


def test_deployed_path_repair(spark):
    files = spark.createDataFrame(
        [("p", "dbt/dbt/a.sql", b"1"), ("p", "python/python/b.py", b"2"), ("p", "other/c.sql", b"3"), ("p", "dbt/a.sql", b"4")],
        "product string, path string, content binary",
    )
    found = {r.path: r.size_bytes for r in deployed_inventory(files).collect()}
    assert found == {"dbt/a.sql": 1, "python/b.py": 1}


@pytest.fixture
def objects(table):
    ddl = table(DDL, ("p", "d", "both", "table"), ("p", "d", "missing", "view"), ("p", None, "loose", "unknown"), ("p", "d", "kind", "view"))
    models = table(MODELS, ("p", "m", "dbt/m.sql", None), ("p", "eph", "dbt/eph.sql", "ephemeral"), ("p", "gone", "dbt/gone.sql", "table"), ("p", "missing", "dbt/x.sql", None))
    names = [("d", "both", "base_table"), ("e", "both", "base_table"), ("d", "loose", "view"), ("d", "m", "view"), ("d", "eph", "view"), ("d", "kind", "base_table")]
    catalog = table(CATALOG, *[("p", "pr", d, n, t, None, None) for d, n, t in names])
    return ddl, models, catalog


def test_one_sided_objects(objects):
    ddl, models, catalog = objects
    only_catalog = sorted((r.name, r.dataset) for r in reconcile.only_in_catalog(catalog, ddl, models).collect())
    assert only_catalog == [("both", "e"), ("eph", "d")]
    only_source = sorted((r.name, r.source_technology) for r in reconcile.only_in_source(catalog, ddl, models).collect())
    assert only_source == [("gone", "dbt_model"), ("missing", "bq")]


def test_type_mismatch(objects):
    ddl, _, catalog = objects
    assert brief(reconcile.type_mismatch(catalog, ddl)) == [("kind", "type_mismatch", "high")]


def test_schema_diff(table):
    source = table(
        COLUMNS, ("p", "d", "t", "a", "INT64"), ("p", "d", "t", "b", "numeric(10, 2)"), ("p", "d", "t", "c", "STRING"),
        ("p", "d", "one_sided", "a", "INT64"), ("p", "d", "equal", "a", "int64"),
    )
    actual = table(
        COLUMNS, ("p", "d", "t", "b", "NUMERIC(10,2)"), ("p", "d", "t", "c", "BYTES"), ("p", "d", "t", "x", "INT64"), ("p", "d", "t", "w", "INT64"),
        ("p", "d", "equal", "a", "INT64"),
    )
    assert rows(reconcile.schema_diff(source, actual)) == [("p", "d", "t", 1, 2, 1)]
    finding = reconcile.schema_mismatch(source, actual).first()
    assert finding.details == "missing_in_prod=1; extra_in_prod=2; type_mismatch=1"


@pytest.mark.parametrize("n", [1, 999, 1001, 5000])
def test_wide_object_is_one_finding(table, spark, n):
    names = spark.range(n).select(F.lit("p").alias("product"), F.lit("d").alias("dataset"), F.lit("t").alias("object_name"), F.format_string("c%04d", "id").alias("column_name"), F.lit("INT64").alias("data_type"))
    actual = table(COLUMNS, ("p", "d", "t", "id", "INT64"))
    source = names.unionByName(actual)
    assert reconcile.column_diff(source, actual).count() == n
    assert [r.details for r in reconcile.schema_mismatch(source, actual).collect()] == [f"missing_in_prod={n}; extra_in_prod=0; type_mismatch=0"]


def test_definitions(table):
    view = "CREATE VIEW `pr.d.%s` AS SELECT a -- x\nFROM `pr.d.t`"
    catalog = table(
        CATALOG,
        ("p", "pr", "d", "same", "view", None, "select A from d.t"), ("p", "pr", "d", "other", "view", None, "select b from d.t"),
        ("p", "pr", "d", "from_ddl", "view", "create view pr.d.from_ddl as select a from d.t;", None),
        ("p", "pr", "d", "empty", "view", None, None), ("p", "pr", "d", "split", "view", None, "select 1 union all select 2"),
        ("p", "pr", "d", "split_bad", "view", None, "select 1 union all select 2"),
    )
    fragments = table(
        "product string, dataset string, object_name string, path string, text string, project string",
        *[("p", "d", n, f"{n}.sql", view % n, "pr") for n in ("same", "other", "from_ddl", "empty")],
        ("p", "d", "split", "1.sql", "create view pr.d.split as select 1", "pr"), ("p", "d", "split", "2.sql", "union all select 2", "pr"),
        ("p", "d", "split", "3.sql", "-- nothing", "pr"),
        ("p", "d", "split_bad", "1.sql", "create view pr.d.split_bad as union all select 2", "pr"), ("p", "d", "split_bad", "2.sql", "select 1", "pr"),
    )
    found = reconcile.definition_mismatch(catalog, fragments)
    assert brief(found) == [("other", "definition_mismatch", "high"), ("split_bad", "definition_mismatch", "high")]
    assert all(r.source_hash and r.env_hash for r in found.collect())


def test_catalog_inventory_defaults(table):
    key = "product string, project string, dataset string, object_name string"
    tables = table(key + ", object_type string, ddl string", ("p", "pr", "d", "t", "BASE TABLE", "x"), ("p", "pr", "d", "f", "BASE TABLE", "y"))
    columns = table(key + ", column_name string, data_type string", ("p", "pr", "d", "t", "a", "INT64"), ("p", "pr", "d", "c", "a", "INT64"), ("p", "pr", "d", "f", "a", "INT64"))
    views = table(key + ", view_definition string", ("p", "pr", "d", "v", "q"), ("p", "pr", "d", "c", "q2"))
    routines = table(key + ", object_type string, routine_definition string", ("p", "pr", "d", "f", "FUNCTION", "body"))
    found = {r.object_name: (r.object_type, r.ddl, r.view_query, r.definition_body, r.column_count) for r in catalog_inventory(tables, columns, views, routines).collect()}
    assert found == {
        "t": ("base_table", "x", None, None, 1), "c": ("unknown", None, "q2", None, 1), "v": ("view", None, "q", None, 0),
        "f": ("function", None, None, "body", 0),
    }


REPORT = "repo string, discrepancy string, commit string, file_path string, author string, seq int"


def test_report_diff_last_row_stands(table):
    old = table(REPORT, ("r", "d", "1", "f", "a", 1), ("r", "d", "1", "f", "b", 2), ("r", "d", "2", "f", "a", 3), ("r", "e", "3", "f", "a", 4))
    new = table(REPORT, ("r", "d", "2", "f", "z", 1), ("s", "d", "4", "f", "n", 2))
    assert rows(reconcile.report_diff(old, new, "seq")) == [("only_in_new", "s", "d", "4", "f", "n"), ("only_in_old", "r", "d", "1", "f", "b"), ("only_in_old", "r", "e", "3", "f", "a")]
    assert rows(reconcile.report_diff(old, old, "seq")) == []
    assert rows(reconcile.pair_delta(old, new)) == [("r", "d", 3, 1, -2), ("r", "e", 1, 0, -1), ("s", "d", 0, 1, 1)]
    assert rows(reconcile.diff_summary(old, new)) == [(4, 2, -2, 2, 1, 3)]


def test_delta_of_unique_reports(table):
    old = table(REPORT, *[("r", "d", str(i), "f", "a", i) for i in range(10)])
    new = table(REPORT, *[("r", "d", str(i), "f", "a", i) for i in range(4, 20)])
    s = reconcile.diff_summary(old, new).first()
    assert s.delta_rows == s.only_in_new - s.only_in_old == 6


def test_empty_reports(table, spark):
    empty = spark.createDataFrame([], REPORT)
    assert rows(reconcile.diff_summary(empty, empty)) == [(0, 0, 0, 0, 0, 0)]


@pytest.mark.parametrize("n", [1, 999, 1001, 5000])
def test_finding_sources(table, spark, n):
    findings = table("product string, name string, dataset string, source_technology string", ("p", "o", "d", "bq"), ("p", "m", None, "dbt_model"), ("p", "x", None, "unknown"))
    files = spark.range(n).select(F.lit("p").alias("product"), F.lit("d").alias("dataset"), F.lit("o").alias("object_name"), F.format_string("f%04d", "id").alias("path"))
    models = table(MODELS, ("p", "m", "dbt/m.sql", None))
    found = {r.name: (r.source_files, r.source_path) for r in reconcile.finding_sources(findings, files.unionAll(files), models).collect()}
    assert found == {"o": (n, "f0000"), "m": (1, "dbt/m.sql"), "x": (0, None)}
    assert reconcile.source_paths(findings, files, models).count() == n + 1
