from pyspark.sql import functions as F

from plumbline.operators import inventory
from tests.conftest import rows

FILES = "product string, path string, text string"


def test_ddl_inventory_precedence(table):
    parsed = inventory.ddl_files(
        table(
            FILES,
            ("p", "bq/1.sql", "alter table d.a add column x INT64;"),
            ("p", "bq/2.sql", "create view d.b as select 1"), ("p", "bq/3.sql", "create table d.b (\n y INT64\n);"),
            ("p", "bq/4.sql", "create table d.c (\n y INT64\n);"), ("p", "bq/5.sql", "create procedure d.c() begin end"),
            ("p", "bq/6.sql", "create or replace table d.c (\n y STRING\n);"),
            ("p", "bq/seven.sql", "select 1"), ("p", "bq/8.sql", "alter table d.e rename to f"),
        )
    )
    found = {(r.dataset, r.object_name): (r.object_type, r.file_count, r.multi_statement) for r in inventory.ddl_inventory(parsed).collect()}
    assert found == {
        ("d", "a"): ("table", 1, False), ("d", "b"): ("view", 2, True), ("d", "c"): ("procedure", 3, True),
        (None, "seven"): ("unknown", 1, False), ("d", "e"): ("alter_table", 1, False),
    }
    columns = {(r.object_name, r.column_name): r.data_type for r in inventory.ddl_columns(parsed).collect()}
    assert columns == {("a", "x"): "INT64", ("b", "y"): "INT64", ("c", "y"): "STRING"}


def test_settings_and_refs(table):
    text = 'variables:\n  BQ_DATASET_NAMES: "a, b"\n  BQ_PROJECT: p0\ndeploy_to_prod_dbt:\n  variables:\n    BQ_DATASET_NAMES: "c, a ,"\n'
    ci = table("repo string, git_ref string, text string", ("r1", "origin/x", text), ("r2", "x", "stages: []\n"), ("r3", "x", "variables:\n  BQ_DATASET_NAMES: 'a'\n"))
    assert rows(inventory.settings_table(ci)) == [("r1", "BQ_DATASET_NAMES", "c, a ,"), ("r1", "BQ_PROJECT", "p0"), ("r3", "BQ_DATASET_NAMES", "'a'")]
    declared = inventory.repo_datasets(ci)
    assert {r.repo: (r.datasets, r.dataset_count) for r in declared.collect()} == {"r1": ("c, a", 2), "r2": ("", 0), "r3": ("a", 1)}
    refs = inventory.dataset_refs(declared)
    assert rows(refs) == [("a", "r1"), ("a", "r3"), ("c", "r1")]
    assert rows(inventory.dataset_ref_counts(refs)) == [("a", 2, "r1"), ("c", 1, "r1")]
    datasets = table("dataset string, project_id string", ("a", "p"), ("z", "p"), ("_tmp", "p"))
    assert rows(inventory.unmatched_datasets(datasets, refs)) == [("z", "p")]


def test_remote_text_goes_first(table):
    schema = "repo string, git_ref string, text string"
    texts = inventory.branch_texts(table(schema, ("a", "origin/b", "remote")), table(schema, ("a", "b", "local"), ("c", "b", "local"), ("d", "b", None)))
    assert rows(texts) == [("a", "origin/b", "remote"), ("c", "b", "local")]


def test_resolve_targets(table):
    products, settings = table("product string", ("a",), ("b",)), table("repo string, key string, value string", ("a", "BQ_PROJECT", "pa"), ("a", "BQ_DATASET_NAMES", "x, y"))
    defaults = {"project": "p", "environment": "prod", "bucket": "k"}
    assert rows(inventory.resolve_targets(products, settings, defaults)) == [("a", "pa", "prod", "k", "x,y"), ("b", "p", "prod", "k", "")]
    assert rows(inventory.resolve_targets(products, settings, defaults, ["e"]))[0] == ("a", "pa", "prod", "k", "e")


LOG = "lost.sql\n@@@c1|2024|ann|a@x|one | two\n\n a.sql \n@@@bad|x\nb.sql\n@@@c2|2024|bob|b@x|m\n@@@c3|2024|bob|b@x|m\r\nc.sql"
WANTED = [("c1", "a.sql", "one | two"), ("c1", "b.sql", "one | two"), ("c3", "c.sql", "m")]


def test_log_texts(table):
    found = inventory.log_rows(table("repo string, discrepancy string, text string", ("r", "d", LOG))).select("commit", "file_path", "message")
    assert rows(found) == WANTED


def test_log_lines_across_blocks(table, monkeypatch):
    from plumbline.operators import skew

    lines = [("log", i, line) for i, line in enumerate(LOG.replace("\r", "").split("\n"))]
    whole = inventory.log_line_rows(table("log string, seq bigint, line string", *lines), ["log"])
    assert rows(whole.select("commit", "file_path", "message")) == WANTED
    df = table("log string, seq bigint, v string", *[("l", i, "x%d" % i if i % 7 == 0 else None) for i in range(1, 50)])
    filled = {r.seq: r.f for r in skew.fill_forward(df, ["log"], "seq", F.col("v"), "f", block=4).collect()}
    assert filled == {i: (f"x{i // 7 * 7}" if i >= 7 else None) for i in range(1, 50)}


def test_models_and_dags(table):
    files = table(FILES, ("p", "dbt/models/m.sql", "select 1"), ("p", "dbt/models/z/m.sql", "{{ config(materialized='table') }}"), ("p", "dbt/target/models/t.sql", "x"), ("p", "dbt/models/m.yml", "x"))
    found = inventory.model_inventory(files).collect()
    assert [(r.object_name, r.relative_path, r.materialized) for r in found] == [("m", "dbt/models/z/m.sql", "table")]
    dags = inventory.dag_inventory(table(FILES, ("p", "python/a.py", 'dag_id="x"'), ("p", "python/b.py", "none")))
    assert rows(dags) == [("p", "python/a.py", ["x"])]


def test_type_counts_and_risk(table):
    objects = table("dataset string, object_type string, object_name string", ("a", "view", "1"), ("a", "base_table", "2"), ("a", "view", "3"))
    counts = inventory.type_counts(objects)
    assert counts.first().object_type_counts == {"base_table": 1, "view": 2}
    unmatched = table("dataset string, project_id string", ("a", "p"), ("b", "p"))
    assert rows(inventory.orphan_rows(unmatched, counts).select("dataset_name", "table_count", "risk_score")) == [("a", 3, 2), ("b", 0, 1)]


def test_products_without_targets(table):
    targets = table("product string, datasets string", ("a", "x"), ("b", ""), ("c", None), ("b", ""))
    assert [r.product for r in inventory.without_targets(targets).orderBy("product").collect()] == ["b", "c"]


def test_orphan_facts_pass_where_known(table):
    unmatched = table("dataset string, project_id string, owner string", ("d", "p", "o"))
    counts = table("dataset string, object_count bigint", ("d", 3))
    assert rows(inventory.orphan_rows(unmatched, counts)) == [("d", "p", "orphan", False, 3, 2, "o")]
    objects = table("dataset string, object_type string, object_name string, row_count bigint", ("d", "view", "v", 7))
    assert rows(inventory.orphan_object_rows(objects)) == [("d", "view", "v", 7)]
