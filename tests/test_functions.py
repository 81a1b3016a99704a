import time
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from plumbline.functions import labels, text
from tests.conftest import rows


@pytest.fixture
def one(spark):
    """Values of expressions over one text column ``c``."""

    def evaluate(value, *expressions):
        row = spark.createDataFrame([(value,)], "c string").select(*[e.alias(f"x{i}") for i, e in enumerate(expressions)]).first()
        return row[0] if len(expressions) == 1 else tuple(row)

    return evaluate


C = F.col("c")


def test_severity_cuts(table):
    df = table("n int", *[(n,) for n in (0, 1, 5, 6, 10, 11, 20, 21, 50, 51)], (None,))
    found = {r[0]: (r[1], r[2]) for r in df.select("n", labels.commit_severity(F.col("n")), labels.file_severity(F.col("n"))).collect()}
    assert found == {
        0: ("none", "none"), 1: ("low", "low"), 5: ("low", "low"), 6: ("medium", "low"), 10: ("medium", "low"),
        11: ("medium", "medium"), 20: ("medium", "medium"), 21: ("high", "medium"), 50: ("high", "medium"),
        51: ("high", "high"), None: ("N/A", "N/A"),
    }


def test_ranks(table):
    df = table("s string", ("high",), ("medium",), ("low",), ("none",), ("N/A",), (None,))
    ranked = [tuple(r) for r in df.select(labels.severity_rank(F.col("s")), labels.severity_rank(F.col("s"), 3)).collect()]
    assert ranked == [(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (5, 4)]


@pytest.mark.parametrize(
    "line, wanted",
    [
        ("A\tx.sql", ("A", "x.sql", "right_only")), ("M\tx", ("M", "x", "different_content")), ("D\tx", ("D", "x", "deleted_in_right")),
        ("R100\told\tnew ", ("R100", "new", "renamed_in_right")), ("C75\told\tnew", ("C75", "new", "copied_in_right")),
        ("T\tx", ("T", "x", "different_content")), ("U\tx", ("U", "x", "different_content")), ("X\tx", ("X", "x", "different_content")),
        ("B\tx", ("B", "x", None)), ("", (None, None, None)), ("no tab", (None, None, None)), ("A\t ", (None, None, None)),
    ],
)
def test_status_line(one, line, wanted):
    parsed = text.parse_status(C)
    assert one(line, parsed["raw_change_type"], parsed["file_path"], labels.difference_type(parsed["raw_change_type"])) == wanted


def test_branch_labels(one):
    assert one("origin/test", labels.branch_name(C)) == "test"
    assert one("master", labels.branch_name(C)) is None
    assert one("origin/feature/x", labels.branch_name(C)) == "feature/x"
    assert one("origin/production", labels.discrepancy_key(C, F.lit("origin/master"))) == "prod_not_in_master"
    assert one("origin/production", labels.discrepancy_key(C, F.lit("origin/master"), strict=True)) == "production_not_in_master"


def test_types(one):
    assert one(" BASE TABLE ", labels.canonical_type(C)) == "table"
    assert one("Scalar Function", labels.canonical_type(C)) == "function"
    assert one("external", labels.canonical_type(C)) == "external"
    assert one(None, labels.canonical_type(C)) == ""


def test_paths(one):
    assert one("dbt/dbt/a.sql", labels.norm_path(C)) == "dbt/a.sql"
    assert one("dbt/python/a.sql", labels.norm_path(C)) == "dbt/python/a.sql"
    assert one("dbt/models/a.sql", labels.is_model(C)) is True
    assert one("dbt/target/models/a.sql", labels.is_model(C)) is False
    assert one("x/.gitkeep", text.suffix(C)) == ""
    assert one("x/A.SQL", text.suffix(C)) == "sql"
    assert one("x/a.b.sql", text.stem(C)) == "a.b"
    assert one("x/.gitkeep", text.stem(C)) == ".gitkeep"


def test_numbers_and_blanks(one):
    assert one("N/A", labels.int_or_zero(C)) == 0
    assert one("12", labels.int_or_zero(C)) == 12
    assert one("", labels.blank_to_null(C)) is None
    assert one(None, labels.na_string(C)) == "N/A"
    assert one("", labels.is_blank(C)) is True
    assert one("a b/c", labels.safe_label(C)) == "a_b_c"
    assert one(None, labels.join_errors(C, F.lit(None))) is None
    assert one("a", labels.join_errors(C, F.lit("b"))) == "a; b"


def test_output_url(one):
    link = labels.output_url(C, F.lit("pre"), F.lit("id1"), "https://b/", "bkt")
    assert one("gs://x/y/", link) == "https://b/x/y/"
    assert one(None, link) == "https://b/bkt/pre/id1"
    assert one(None, labels.output_url(C, F.lit(""), F.lit("id1"), "https://b/", "bkt")) == "https://b/bkt/id1"
    assert one(None, labels.output_url(C, F.lit("p"), F.lit(None).cast("string"), "https://b/", "bkt")) is None


def test_normalize_sql(one):
    sql = "SELECT `A`  -- note\r\n\t, b /* multi\nline */ FROM t "
    assert one(sql, text.normalize_sql(C)) == "select a , b from t"
    assert one("a\r\nb\rc", text.normalize_newlines(C)) == "a\nb\nc"


def test_strip_project(one):
    stripped = text.strip_project(C, F.lit("my-proj.x"))
    assert one("from `my-proj.x.d.t` join my-proj.x.d.u, `other.d.t`", stripped) == "from d.t join d.u, `other.d.t`"


@pytest.mark.parametrize(
    "sql, wanted",
    [
        ("create table a.b (x INT64);", ("a", "b", "table")),
        ("CREATE OR REPLACE TABLE IF NOT EXISTS `p-1.d.t-x` (a INT64)", ("d", "t-x", "table")),
        ("alter table d.t add column x INT64; create view d.v as select 1", ("d", "v", "view")),
        ("create materialized view d.m as select 1", ("d", "m", "materialized_view")),
        ("create function d.f() as (1)", ("d", "f", "function")),
        ("create procedure p.d.q() begin end", ("d", "q", "procedure")),
        ("alter table `d.t` add column x INT64", ("d", "t", "alter_table")),
        ("insert into d.t select 1", (None, None, "unknown")),
    ],
)
def test_ddl_target(one, sql, wanted):
    target = text.ddl_target(C)
    assert one(sql, target["dataset"], target["object"], target["kind"]) == wanted


def test_create_columns(one):
    sql = """create table if not exists d.t (
      id INT64 NOT NULL, -- key
      -- skipped STRING,
      `amount` numeric(10, 2) OPTIONS(description="a, b"),
      tags ARRAY<STRUCT<k STRING, v ARRAY<INT64>>>,
      id STRING
    )
    PARTITION BY day"""
    pairs = one(sql, text.create_columns(C))
    assert [tuple(p) for p in pairs] == [
        ("id", "INT64"), ("amount", "NUMERIC(10,2)"), ("tags", "ARRAY<STRUCT<K STRING,V ARRAY<INT64>>>"), ("id", "STRING"),
    ]
    assert one("create table d.t as select 1", text.create_columns(C)) == []


def test_many_columns(one):
    body = ",\n".join(f"c{i} NUMERIC(10, {i % 9})" for i in range(5000))
    sql, begun = f"create table d.t (\n{body}\n) options(x=1)", time.monotonic()
    assert len(one(sql, text.create_columns(C))) == 5000
    assert time.monotonic() - begun < 5


def test_time_of_columns_grows_with_their_number(one):
    def seconds(n):
        body = ",\n".join(f"c{i} STRUCT<a NUMERIC(10, {i % 9}), b INT64>" for i in range(n))
        begun = time.monotonic()
        assert len(one(f"create table d.t (\n{body}\n) options(x=1)", text.create_columns(C))) == n
        return time.monotonic() - begun

    seconds(100)
    few = seconds(5000)
    assert seconds(50000) < 25 * max(few, 1)


def test_columns_with_quotes_comments_and_depth(one):
    deep = "STRUCT<a " * 6 + "ARRAY<INT64>" + ">" * 6
    sql = f"""create table d.t (
      a INT64 OPTIONS(description="net 1) plus (tax"), /* b INT64, ( */
      c STRING DEFAULT 'x, y INT64', -- it's (
      d {deep} NOT NULL,
      e NUMERIC(10, 2) DEFAULT (round(((((1.5))))), 2)
    ) OPTIONS(labels=[("k", "v")]);"""
    kind = "STRUCT<A " * 6 + "ARRAY<INT64>" + ">" * 6
    pairs = one(sql, text.create_columns(C))
    assert [tuple(p) for p in pairs[:3]] == [("a", "INT64"), ("c", "STRING"), ("d", kind)] and tuple(pairs[3]) == ("e", "NUMERIC(10,2)")
    assert one("create table d.t (a INT64, b STRING", text.create_columns(C)) == []
    added = one(f"alter table d.t add column a {deep} OPTIONS(description='add column z INT64'), add column b INT64", text.added_columns(C))
    assert [tuple(p) for p in added] == [("a", kind), ("b", "INT64")]


def test_definition_body(one):
    body = text.definition_body(C)
    for head in ("create view d.v", 'create or replace view `p.d.v` OPTIONS(description="same as before")', "-- create view a.b as x\ncreate view d.v (a, b) -- known as v\n",
                 "create view d.v OPTIONS(description='it\\'s as is')", "create view d.v options(x='" + "y " * 50_000 + "')"):
        assert one(f"{head} AS select a as b;", body).strip() == "select a as b"
    assert one("select '--' as a -- b", body) == "select '--' as a"


def test_added_columns(one):
    pairs = one("ALTER TABLE d.t ADD COLUMN a INT64, ADD COLUMN IF NOT EXISTS `b` array<string>;", text.added_columns(C))
    assert [tuple(p) for p in pairs] == [("a", "INT64"), ("b", "ARRAY<STRING>")]


def test_model_and_dag(one):
    assert one("{{ config(tags=['x'],\n materialized = ' View ') }}", text.materialization(C)) == "view"
    assert one("{{ config(tags=['x']) }} select 1", text.materialization(C)) is None
    assert one("""globals()["b"] = 1\nDAG(dag_id = 'a')\nDAG(dag_id="b")""", text.dag_ids(C)) == ["a", "b"]


CI = """stages:
  - x
variables:
  A: "1"
  B: plain
  no colon here

deploy_to_prod_bq:
  stage: d
  variables:
    A: '2'
    C: x:y
  script:
    - echo: 1
"""


def test_ci_blocks(one):
    top = text.ci_pairs(text.ci_block(C, "variables"), 2)
    assert [tuple(p) for p in one(CI, top)] == [("A", "1"), ("B", "plain")]
    job = text.ci_pairs(text.ci_block(text.ci_block(C, "deploy_to_prod_bq"), "variables", 2), 4)
    assert [tuple(p) for p in one(CI, job)] == [("A", "'2'"), ("C", "x:y")]
    assert one(CI, text.unquote(text.last_value(job, "A"))) == "2"
    assert one(CI, text.last_value(job, "Z")) is None
    tail = text.ci_pairs(text.ci_block(C, "variables", whole_tail=True), 2)
    assert ("C", "x:y") in [tuple(p) for p in one(CI, tail)]


def test_names_and_tokens(one):
    assert one(" a, ,b ,", text.split_names(C)) == ["a", "b"]
    assert one(None, text.split_names(C)) == []
    values = {"ENV": "prod"}
    assert one("x {{ ENV }}", text.substitute(C, F.lit("a.yml"), values)) == "x prod"
    assert one("x {{ ENV }}", text.substitute(C, F.lit("a.bin"), values)) == "x {{ ENV }}"


def test_fingerprint(spark):
    df = spark.createDataFrame([(b"a\r\nb", "x.sql"), (b"a\nb", "y.sql"), (b"a\r\nb", "x.bin"), (b"a\nb", "y.bin"), (b"\xff\r\n", "z.txt")], "c binary, p string")
    found = [r.f for r in df.select(text.fingerprint(F.col("c"), F.col("p")).alias("f")).collect()]
    assert found[0].compare_hash == found[1].compare_hash and found[0].sha256 != found[1].sha256
    assert found[2].compare_hash != found[3].compare_hash
    assert found[0].size_bytes == 4 and found[0].is_text and not found[2].is_text
    assert found[4].compare_hash is not None


def test_header(one):
    header = text.split_header(C)
    assert tuple(one("@@@c|d|a|m|x | y|", header)) == ("c", "d", "a", "m", "x | y|")
    assert one("@@@c|d|a|m", header) is None
    assert one("file.sql", header) is None


def test_parse_ts(one):
    assert one("2024-01-01T10:00:00+02:00", text.parse_ts(C)) == datetime(2024, 1, 1, 8)
    assert one("never", text.parse_ts(C)) is None


def test_definition_body(one):
    body = text.definition_body(C)
    assert one("-- x\nCREATE OR REPLACE VIEW `p.d.v` AS\nselect 1;\n", body).strip() == "select 1"
    assert one("select 1", body) == "select 1"


def test_filter_names(table):
    df = table("n string", ("_x",), ("abc",), ("xyz",))
    assert rows(labels.filter_names(df, "n")) == [("abc",), ("xyz",)]
    assert rows(labels.filter_names(df, "n", "b", None)) == [("abc",)]


def test_map_forms(spark):
    df = spark.createDataFrame([({"b": 2, "a": 1},)], "m map<string,int>")
    assert df.select(labels.map_text(F.col("m"))).first()[0] == "a=1, b=2"
