"""Inventories, environment and orphan comparisons, text functions, sinks and streams."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from bindings.registry import CHECK_VIEWS, query
from plumbline.functions import labels, text
from plumbline.operators import executive, inventory, reconcile, runs
from plumbline.plans import reports
from plumbline.session import cut_lineage, scratch_path
from plumbline.sources import catalog as catalog_source
from plumbline.sources import files as file_source
from plumbline.sources import ledger, published, tracked_files
from plumbline.sources import reports as sinks
from plumbline.streaming import ledger_stream

V = CHECK_VIEWS

# --- files -----------------------------------------------------------------------------
IS_TEXT = "(path LIKE '%.sql' OR path LIKE '%.py')"
UNIX = r"regexp_replace(text, '\r\n?', chr(10), 'g')"
COMPARE = f"CASE WHEN {IS_TEXT} THEN sha256({UNIX}) ELSE sha256(text) END"
V["source_inventory"] = f"""
SELECT product, path, sha256(text) AS sha256, to_base64(unhex(md5(text))) AS md5_base64, octet_length(encode(text)) AS size_bytes, {COMPARE} AS compare_hash, {IS_TEXT} AS is_text
FROM {{source_texts}}"""
V["deployed_inventory"] = V["source_inventory"].replace("{source_texts}", r"(SELECT product, regexp_replace(path, '^(dbt/dbt|python/python)/', split_part(path, '/', 1) || '/') AS path, text FROM {deployed_texts})")


def binary(df):
    return df.select("product", "path", F.col("text").cast("binary").alias("content"))


def source_inventory(v):
    return file_source.file_inventory(binary(v.source_texts))


def deployed_inventory(v):
    return file_source.deployed_inventory(binary(v.deployed_texts))


@query("file_inventory", "SELECT * FROM {source_inventory}")
def _(v):
    return source_inventory(v)


@query("deployed_inventory", "SELECT * FROM {deployed_inventory}")
def _(v):
    return deployed_inventory(v)


def text_tree(v) -> str:
    """All documents as text files, a folder per source."""
    root = scratch_path(v.spark, "tree")
    v.documents.select("source", "text").write.partitionBy("source").text(root)
    return root


def folder():
    return F.regexp_extract("path", "^source=([^/]*)/", 1).alias("folder")


@query("tree_scan", "SELECT source AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1) AS listed, sum(octet_length(encode(coalesce(text, ''))) + 1) AS held FROM {documents} GROUP BY source")
def _(v):
    files = file_source.scan_tree(v.spark, text_tree(v)).where("path LIKE '%.txt'")
    sized = files.select(folder(), "length", F.octet_length("content").cast("bigint").alias("held"))
    return sized.groupBy("folder").agg(F.sum("length").alias("listed"), F.sum("held").alias("held"))


@query("text_scan", """
SELECT source AS folder, md5(line) AS line_md5, count(*) AS lines
FROM (SELECT source, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM {documents}) GROUP BY ALL""")
def _(v):
    files = file_source.scan_text(v.spark, text_tree(v), "*.txt")
    lines = files.select(folder(), F.explode(F.split(F.regexp_replace("text", "\n$", ""), "\n", -1)).alias("line"))
    return lines.groupBy("folder", F.md5("line").alias("line_md5")).agg(F.count(F.lit(1)).alias("lines"))


@query("tracked_inventory", "SELECT source AS folder, sum(octet_length(encode(coalesce(text, ''))) + 1) AS size_bytes FROM {documents} GROUP BY source")
def _(v):
    """Short documents come first, then the others: the second run reads their files alone."""
    root, base = scratch_path(v.spark, "tree"), scratch_path(v.spark, "tracked")
    short = F.coalesce(F.length("text"), F.lit(0)) < 1000
    for part in (v.documents.where(short), v.documents.where(~short)):
        part.select("source", "text").write.mode("append").partitionBy("source").text(root)
        tracked_files.track_files(v.spark, root, base, "*.txt")
    return tracked_files.read_tracked(v.spark, base).groupBy(folder()).agg(F.sum("size_bytes").alias("size_bytes"))


V["file_findings"] = """
SELECT 'gcs' AS area, coalesce(s.product, d.product) AS product, coalesce(s.path, d.path) AS name, cast(NULL AS string) AS dataset,
       CASE WHEN d.path IS NULL THEN 'only_in_source' WHEN s.path IS NULL THEN 'only_in_gcs' ELSE 'content_mismatch' END AS status,
       CASE WHEN d.path IS NULL THEN 'medium' ELSE 'high' END AS severity, split_part(coalesce(s.path, d.path), '/', 1) AS source_technology,
       CASE WHEN d.path IS NULL THEN 'File exists in rendered source snapshot but not in deployed GCS bucket.'
            WHEN s.path IS NULL THEN 'File exists in deployed GCS bucket but not in rendered source snapshot.'
            ELSE 'File exists in both places but content hash differs.' END AS details, s.compare_hash AS source_hash, d.compare_hash AS env_hash
FROM {source_inventory} s FULL JOIN {deployed_inventory} d ON s.product = d.product AND s.path = d.path
WHERE s.compare_hash IS DISTINCT FROM d.compare_hash"""


@query("file_reconcile", "SELECT * FROM {file_findings}")
def _(v):
    return reconcile.compare_files(source_inventory(v), deployed_inventory(v))


# --- definitions and catalog -----------------------------------------------------------
V["ddl_expected"] = """
SELECT product, path, CASE WHEN variant <> 4 THEN dataset END AS dataset, object_name,
       CASE variant WHEN 0 THEN 'table' WHEN 1 THEN 'alter_table' WHEN 2 THEN 'view' WHEN 3 THEN 'procedure' ELSE 'unknown' END AS kind FROM {ddl_sources}
UNION ALL SELECT product, 'bq/' || object_name || '_more.sql' AS path, dataset, object_name, 'alter_table' AS kind FROM {ddl_sources} WHERE variant = 0"""
V["ddl_column_list"] = """
SELECT product, dataset, object_name, c.name AS column_name, c.type AS data_type FROM {ddl_sources} s,
(VALUES (0, 'id', 'INT64'), (0, 'v', 'BYTES'), (0, 'amount', 'NUMERIC(10,2)'), (0, 'tags', 'ARRAY<STRUCT<K STRING,N INT64>>'), (0, 'extra', 'FLOAT64'),
        (1, 'a', 'INT64'), (1, 'b', 'STRING')) AS c(variant, name, type) WHERE c.variant = s.variant"""
V["ddl_objects"] = """
SELECT product, CASE WHEN variant <> 4 THEN dataset END AS dataset, object_name,
       CASE variant WHEN 0 THEN 'table' WHEN 1 THEN 'table' WHEN 2 THEN 'view' WHEN 3 THEN 'procedure' ELSE 'unknown' END AS object_type,
       cast(CASE WHEN variant = 0 THEN 2 ELSE 1 END AS bigint) AS file_count, variant = 0 AS multi_statement, path AS first_path FROM {ddl_sources}"""


def parsed(v):
    return inventory.ddl_files(v.ddl_texts)


@query("ddl_targets", "SELECT * FROM {ddl_expected}")
def _(v):
    return parsed(v).select("product", "path", "dataset", "object_name", "kind")


@query("ddl_columns", "SELECT * FROM {ddl_column_list}")
def _(v):
    return inventory.ddl_columns(parsed(v))


@query("alter_columns", """
SELECT path, 'a' AS name, 'INT64' AS type FROM {ddl_sources} WHERE variant = 1 UNION ALL SELECT path, 'b' AS name, 'STRING' AS type FROM {ddl_sources} WHERE variant = 1
UNION ALL SELECT 'bq/' || object_name || '_more.sql' AS path, 'extra' AS name, 'FLOAT64' AS type FROM {ddl_sources} WHERE variant = 0
UNION ALL SELECT 'bq/' || object_name || '_more.sql' AS path, 'v' AS name, 'BYTES' AS type FROM {ddl_sources} WHERE variant = 0""")
def _(v):
    return v.ddl_texts.select("path", F.inline(text.added_columns(F.col("text"))))


@query("ddl_inventory", "SELECT * FROM {ddl_objects}")
def _(v):
    return inventory.ddl_inventory(parsed(v))


NORMAL = r"""lower(trim(regexp_replace(replace(regexp_replace(regexp_replace(replace(%s, chr(13) || chr(10), chr(10)), '--[^\n]*', '', 'g'), '(?s)/\*.*?\*/', '', 'g'), '`', ''),
 '[\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g')))"""


@query("normalize_sql", f"SELECT doc_id, sha256({NORMAL % 'text'}) AS sql_hash FROM {{sql_texts}}")
def _(v):
    return v.sql_texts.select("doc_id", F.sha2(text.normalize_sql(F.col("text")), 256).alias("sql_hash"))


@query("strip_project", r"""
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '`proj\.([A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)`', '\1', 'g'), '\bproj\.([A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+)\b', '\1', 'g')) AS stripped
FROM {sql_texts}""")
def _(v):
    return v.sql_texts.select("doc_id", F.md5(text.strip_project(F.col("text"), F.lit("proj"))).alias("stripped"))


@query("substitute_tokens", """
SELECT doc_id, md5(CASE WHEN doc_id % 2 = 0 THEN 'p_' || source || ':prod:' || text ELSE '{{{{ GCP_PROJECT }}}}:{{{{ TARGET_ENV }}}}:' || text END) AS rendered FROM {documents}""")
def _(v):
    path = F.when(F.col("doc_id") % 2 == 0, F.lit("bq/a.SQL")).otherwise(F.lit("bq/a.bin"))
    body = F.concat(F.lit("{{ GCP_PROJECT }}:{{ TARGET_ENV }}:"), "text")
    values = {"GCP_PROJECT": F.concat(F.lit("p_"), "source"), "TARGET_ENV": "prod"}
    return v.documents.select("doc_id", F.md5(text.substitute(body, path, values)).alias("rendered"))


V["model_rows"] = f"""
SELECT product, regexp_extract(path, '([^/]*)\\.sql$', 1) AS object_name, path AS relative_path, sha256({NORMAL % 'text'}) AS sql_hash,
       nullif(lower(trim(regexp_extract(regexp_extract(text, '(?is)config\\s*\\((.*?)\\)', 1), '(?i)materialized\\s*=\\s*[''"]([^''"]+)[''"]', 1))), '') AS materialized
FROM {{model_texts}} WHERE path NOT LIKE 'dbt/target/%'"""
V["models"] = "SELECT * FROM {model_rows} QUALIFY row_number() OVER (PARTITION BY product, object_name ORDER BY relative_path DESC) = 1"


@query("model_inventory", "SELECT * FROM {models}")
def _(v):
    return inventory.model_inventory(v.model_texts)


@query("dag_inventory", r"""
SELECT product, relative_path, array_to_string(list_sort(list_distinct(list_concat(g, a))), ',') AS dag_ids FROM (
  SELECT product, path AS relative_path, regexp_extract_all(text, 'globals\(\)\["([^"]+)"\]', 1) AS g, regexp_extract_all(text, 'dag_id\s*=\s*[''"]([^''"]+)[''"]', 1) AS a FROM {dag_texts})
WHERE len(g) + len(a) > 0""")
def _(v):
    return inventory.dag_inventory(v.dag_texts).withColumn("dag_ids", F.array_join("dag_ids", ","))


V["catalog"] = f"""
WITH keyed AS (
  SELECT product, project, dataset, object_name, 't' AS k, replace(lower(object_type), ' ', '_') AS ty, ddl, cast(NULL AS string) AS vq, cast(NULL AS string) AS def FROM {{catalog_tables}}
  UNION ALL SELECT product, project, dataset, object_name, 'c', NULL, NULL, NULL, NULL FROM {{catalog_columns}}
  UNION ALL SELECT product, project, dataset, object_name, 'v', NULL, NULL, view_definition, NULL FROM {{catalog_views}}
  UNION ALL SELECT product, project, dataset, object_name, 'r', lower(object_type), NULL, NULL, routine_definition FROM {{catalog_routines}})
SELECT project, dataset, object_name,
       CASE WHEN bool_or(k = 'r') THEN max(ty) FILTER (WHERE k = 'r') WHEN bool_or(k = 't') THEN max(ty) FILTER (WHERE k = 't') WHEN bool_or(k = 'c') THEN 'unknown' ELSE 'view' END AS object_type,
       CASE WHEN NOT bool_or(k = 'r') THEN max(ddl) END AS ddl, CASE WHEN NOT bool_or(k = 'r') THEN max(vq) END AS view_query, max(def) AS definition_body,
       CASE WHEN bool_or(k = 'r') THEN 0 ELSE count(*) FILTER (WHERE k = 'c') END AS column_count
FROM keyed GROUP BY project, dataset, object_name"""


def catalog_raw(v):
    return catalog_source.catalog_inventory(v.catalog_tables, v.catalog_columns, v.catalog_views, v.catalog_routines)


def catalog(v):
    """Catalog inventory with the product of each dataset."""
    product = F.concat(F.lit("Brand#"), F.regexp_extract("dataset", r"([0-9]+)$", 1))
    return catalog_raw(v).withColumn("product", product)


V["catalog_p"] = "SELECT 'Brand#' || regexp_extract(dataset, '([0-9]+)$', 1) AS product, * FROM {catalog}"


@query("catalog_inventory", "SELECT * FROM {catalog}")
def _(v):
    return catalog_raw(v)


@query("catalog_union", """
SELECT project, dataset, object_name, replace(lower(object_type), ' ', '_') AS object_type FROM {catalog_tables}
UNION ALL SELECT project, dataset, object_name, replace(lower(object_type), ' ', '_') AS object_type FROM {catalog_routines}""")
def _(v):
    return catalog_source.catalog_union(v.catalog_tables, v.catalog_routines)


def finding(status: str, kind: str, details: str, rest: str, dataset: str = "dataset", hashes: str = "cast(NULL AS string) AS source_hash, cast(NULL AS string) AS env_hash") -> str:
    severity = "medium" if status == "only_in_source" else "high"
    return f"""
SELECT 'bigquery' AS area, product, object_name AS name, {dataset} AS dataset, '{status}' AS status, '{severity}' AS severity, {kind} AS source_technology,
       {details} AS details, {hashes} FROM {rest}"""


# Documents are the models of product src…; the objects below are those of the catalog products.
V["model_names"] = "SELECT 'Brand#' || cast(cast(substring(product, 4) AS int) AS string) AS product, object_name, relative_path, materialized FROM {models}"


def models(v):
    product = F.concat(F.lit("Brand#"), F.substring("product", 4, 9))
    return inventory.model_inventory(v.model_texts).withColumn("product", product)


V["f_catalog"] = finding("only_in_bq", "'unknown'", "'Selected GCP environment contains ' || object_type || ' with no matching DDL or dbt model in the selected source snapshot.'",
    """{catalog_p} c WHERE NOT EXISTS (SELECT 1 FROM {ddl_objects} d WHERE d.product = c.product AND d.object_name = c.object_name AND (d.dataset = c.dataset OR d.dataset IS NULL))
    AND NOT EXISTS (SELECT 1 FROM {model_names} m WHERE m.product = c.product AND m.object_name = c.object_name AND m.materialized IS DISTINCT FROM 'ephemeral')""")
V["f_source"] = finding("only_in_source", "kind", "'Object exists in the selected source snapshot but not in the selected GCP dataset inventory. source_kind=' || kind",
    """(SELECT product, dataset, object_name, 'bq' AS kind FROM {ddl_objects} d WHERE NOT EXISTS (SELECT 1 FROM {catalog_p} c WHERE c.product = d.product AND c.object_name = d.object_name AND (c.dataset = d.dataset OR d.dataset IS NULL))
        UNION ALL SELECT product, NULL AS dataset, object_name, 'dbt_model' AS kind FROM {model_names} m WHERE materialized IS DISTINCT FROM 'ephemeral'
        AND NOT EXISTS (SELECT 1 FROM {catalog_p} c WHERE c.product = m.product AND c.object_name = m.object_name)
        AND NOT EXISTS (SELECT 1 FROM {ddl_objects} d WHERE d.product = m.product AND d.object_name = m.object_name))""")
V["f_type"] = finding("type_mismatch", "'bq'", "'Source type=' || source_type || ', selected GCP object type=' || env_type || '.'",
    """(SELECT d.product, d.dataset, d.object_name, d.object_type AS source_type, c.object_type AS env_type FROM {ddl_objects} d
        JOIN {catalog_p} c ON c.product = d.product AND c.dataset = d.dataset AND c.object_name = d.object_name
        WHERE d.object_type <> 'unknown' AND d.object_type <> replace(c.object_type, 'base_table', 'table'))""")


@query("only_in_catalog", "SELECT * FROM {f_catalog}")
def _(v):
    return reconcile.only_in_catalog(catalog(v), inventory.ddl_inventory(parsed(v)), models(v))


@query("only_in_source", "SELECT * FROM {f_source}")
def _(v):
    return reconcile.only_in_source(catalog(v), inventory.ddl_inventory(parsed(v)), models(v))


@query("type_mismatch", "SELECT * FROM {f_type}")
def _(v):
    return reconcile.type_mismatch(catalog(v), inventory.ddl_inventory(parsed(v)))


V["column_diff"] = """
SELECT product, dataset, object_name, column_name, CASE WHEN e IS NULL THEN 'missing' WHEN s IS NULL THEN 'extra' ELSE 'retyped' END AS difference FROM (
  SELECT coalesce(s.product, c.product) AS product, coalesce(s.dataset, c.dataset) AS dataset, coalesce(s.object_name, c.object_name) AS object_name,
         coalesce(s.column_name, c.column_name) AS column_name, s.data_type AS s, c.data_type AS e
  FROM {ddl_column_list} s FULL JOIN {catalog_columns} c ON s.product = c.product AND s.dataset = c.dataset AND s.object_name = c.object_name AND s.column_name = c.column_name)
WHERE (product, dataset, object_name) IN (SELECT (product, dataset, object_name) FROM {ddl_column_list})
  AND (product, dataset, object_name) IN (SELECT (product, dataset, object_name) FROM {catalog_columns})
  AND (s IS NULL OR e IS NULL OR replace(upper(s), ', ', ',') <> replace(upper(e), ', ', ','))"""


V["schema_diff"] = """
SELECT product, dataset, object_name, count(*) FILTER (WHERE difference = 'missing') AS missing_in_prod, count(*) FILTER (WHERE difference = 'extra') AS extra_in_prod,
       count(*) FILTER (WHERE difference = 'retyped') AS type_mismatch
FROM {column_diff} GROUP BY product, dataset, object_name"""
V["f_schema"] = finding("schema_mismatch", "'bq'", "'missing_in_prod=' || missing_in_prod || '; extra_in_prod=' || extra_in_prod || '; type_mismatch=' || type_mismatch", "{schema_diff}")


@query("column_diff", "SELECT * FROM {column_diff}")
def _(v):
    diff = reconcile.column_diff(inventory.ddl_columns(parsed(v)), v.catalog_columns)
    return diff.select("product", "dataset", "object_name", "column_name", "difference")


@query("schema_diff", "SELECT * FROM {schema_diff}")
def _(v):
    return reconcile.schema_diff(inventory.ddl_columns(parsed(v)), v.catalog_columns)


V["wide_columns"] = "SELECT 'p' AS product, 'd' AS dataset, l_returnflag AS object_name, 'c' || l_orderkey || '_' || l_linenumber AS column_name, l_linenumber AS n FROM {lineitem}"


@query("schema_diff_wide", """
SELECT product, dataset, object_name, count(*) FILTER (WHERE n = 2) AS missing_in_prod, count(*) FILTER (WHERE n = 1) AS extra_in_prod, count(*) FILTER (WHERE n = 3) AS type_mismatch
FROM (SELECT DISTINCT * FROM {wide_columns}) GROUP BY ALL""")
def _(v):
    """Three objects that share all order lines as their columns."""
    name = F.concat(F.lit("c"), F.col("l_orderkey"), F.lit("_"), F.col("l_linenumber"))
    columns = v.lineitem.select(
        F.lit("p").alias("product"), F.lit("d").alias("dataset"), F.col("l_returnflag").alias("object_name"), name.alias("column_name"), "l_linenumber"
    )
    source = columns.where("l_linenumber <> 1").withColumn("data_type", F.lit("INT64"))
    actual = columns.where("l_linenumber <> 2").withColumn("data_type", F.when(F.col("l_linenumber") == 3, F.lit("BYTES")).otherwise(F.lit("int64")))
    return reconcile.schema_diff(source, actual)


V["view_pairs"] = f"""
SELECT s.product, s.dataset, s.object_name,
       sha256('select id, ''' || lower(p.p_name) || ''' as n from ' || lower(s.dataset) || '.base') AS source_hash,
       CASE WHEN v.view_definition IS NOT NULL THEN sha256('select id, ''' || lower(p.p_name) || ''' as n from ' || lower(s.dataset) || CASE WHEN s.p_partkey % 4 = 0 THEN '.other' ELSE '.base' END)
            ELSE sha256(lower(c.ddl)) END AS env_hash
FROM {{ddl_sources}} s JOIN {{part}} p ON p.p_partkey = s.p_partkey JOIN {{catalog_p}} c ON c.product = s.product AND c.dataset = s.dataset AND c.object_name = s.object_name
LEFT JOIN {{catalog_views}} v ON v.product = s.product AND v.dataset = s.dataset AND v.object_name = s.object_name
WHERE s.variant = 2 AND (v.view_definition IS NOT NULL OR c.ddl <> '')"""
V["f_definition"] = finding("definition_mismatch", "'bq'", "'Source view definition and selected GCP view definition differ after normalization.'",
    "{view_pairs} WHERE source_hash <> env_hash", hashes="source_hash, env_hash")


@query("definition_diff", "SELECT * FROM {f_definition}")
def _(v):
    rows = parsed(v)
    fragments = inventory.view_fragments(rows, inventory.ddl_inventory(rows))
    return reconcile.definition_mismatch(catalog(v), fragments, F.lit("proj"))


V["split_views"] = """
SELECT product, dataset, object_name, '1.sql' AS path, 'select id, ''' || lower(p_name) || ''' as n' AS text, p_partkey FROM {catalog_tables} WHERE variant = 2
UNION ALL SELECT product, dataset, object_name, '2.sql' AS path, 'from ' || lower(dataset) || '.base' AS text, p_partkey FROM {catalog_tables} WHERE variant = 2"""


@query("definition_diff_split", """
SELECT product, dataset, object_name AS name, sha256(cast(sum(cast('0x' || substring(sha256(path || chr(10) || sha256(text)), 1, 15) AS BIGINT)) AS string)) AS source_hash
FROM {split_views} WHERE p_partkey % 4 = 0 GROUP BY product, dataset, object_name""")
def _(v):
    """Every view in two files; a finding always carries a source hash."""
    views = v.catalog_tables.where("variant = 2").select("product", "dataset", "object_name", "p_name")
    head = F.concat(F.lit("CREATE VIEW proj.d.v AS SELECT id, '"), "p_name", F.lit("' AS n"))
    texts = F.array(F.struct(F.lit("1.sql").alias("path"), head.alias("text")), F.struct(F.lit("2.sql").alias("path"), F.concat(F.lit("FROM `"), "dataset", F.lit(".base`;")).alias("text")))
    fragments = views.select("product", "dataset", "object_name", F.inline(texts))
    actual = v.catalog_views.withColumn("ddl", F.lit(None).cast("string")).withColumnRenamed("view_definition", "view_query")
    return reconcile.definition_mismatch(actual, fragments, F.lit("proj")).select("product", "dataset", "name", "source_hash")


FINDINGS = ["f_catalog", "f_source", "f_type", "f_schema", "f_definition"]
V["catalog_findings"] = " UNION ALL BY NAME ".join(f"SELECT * FROM {{{f}}}" for f in FINDINGS)


def catalog_findings(v):
    return reports.catalog_findings(catalog(v), v.catalog_columns, parsed(v), models(v))


@query("catalog_reconcile", "SELECT * FROM {catalog_findings}")
def _(v):
    return catalog_findings(v)


@query("findings_union", """
SELECT product, CASE WHEN area = 'gcs' THEN 'gcs' ELSE 'bigquery' END AS component_type, source_technology AS object_type, name AS object_name,
       status AS drift_category, source_hash, env_hash, severity FROM (SELECT * FROM {catalog_findings} UNION ALL BY NAME SELECT * FROM {file_findings})""")
def _(v):
    files = reconcile.compare_files(source_inventory(v), deployed_inventory(v))
    return reconcile.ledger_findings(catalog_findings(v), files)


V["source_paths"] = """
SELECT DISTINCT f.product, f.dataset, f.name, f.source_technology, p.path FROM {catalog_findings} f
JOIN (SELECT product, dataset, object_name, 'bq' AS kind, path FROM {ddl_expected}
      UNION ALL SELECT product, NULL, object_name, 'dbt_model', relative_path FROM {model_names}) p
  ON p.kind = f.source_technology AND p.product = f.product AND p.object_name = f.name AND p.dataset IS NOT DISTINCT FROM f.dataset"""
V["finding_sources"] = """
SELECT f.*, coalesce(p.n, 0) AS source_files, p.source_path FROM {catalog_findings} f
LEFT JOIN (SELECT product, dataset, name, source_technology, count(*) AS n, min(path) AS source_path FROM {source_paths} GROUP BY ALL) p
  ON p.source_technology = f.source_technology AND p.product = f.product AND p.name = f.name AND p.dataset IS NOT DISTINCT FROM f.dataset"""


def read_once(v):
    """Definition files and models, whose texts are parsed once for the findings and their sources."""
    return cut_lineage(parsed(v), "parsed"), cut_lineage(models(v), "models")


@query("source_paths", "SELECT * FROM {source_paths}")
def _(v):
    rows, names = read_once(v)
    return reconcile.source_paths(reports.catalog_findings(catalog(v), v.catalog_columns, rows, names), rows, names)


def finding_sources(v):
    rows, names = read_once(v)
    return reconcile.finding_sources(reports.catalog_findings(catalog(v), v.catalog_columns, rows, names), rows, names)


@query("finding_sources", "SELECT * FROM {finding_sources}")
def _(v):
    return finding_sources(v)


def line_sql() -> str:
    name = "CASE WHEN area = 'gcs' THEN '1' ELSE '0' END"
    return f"""
SELECT n AS finding_number, n || '. `' || status || '` `' || name || '` [source=' || source_technology || ']' || coalesce(' [source_path=' || source_path || ']', '') || ': ' || details AS line
FROM (SELECT *, row_number() OVER (ORDER BY {name}, product, coalesce(dataset, ''), name, status) AS n
      FROM (SELECT * FROM {{finding_sources}} UNION ALL BY NAME SELECT * FROM {{file_findings}}))"""


@query("render_findings", line_sql())
def _(v):
    return reports.numbered(finding_sources(v), reconcile.compare_files(source_inventory(v), deployed_inventory(v)))


@query("env_run_summary", """
SELECT (SELECT count(*) FROM {catalog_findings}) AS bigquery_findings, (SELECT count(*) FROM {file_findings}) AS gcs_findings, (SELECT count(*) FROM {ddl_objects}) AS source_bq_objects,
       (SELECT count(*) FROM {model_names}) AS source_dbt_models, (SELECT count(*) FROM {source_inventory}) AS source_files, (SELECT count(*) FROM {catalog}) AS actual_bq_objects,
       (SELECT count(*) FROM {deployed_inventory}) AS actual_gcs_objects""")
def _(v):
    report = reports.env_drift(catalog(v), v.catalog_columns, parsed(v), models(v), source_inventory(v), deployed_inventory(v))
    return report.files["summary"][0]


def scoped(v):
    """The environment report with products that have no target datasets, and a warning of an earlier step."""
    earlier = v.scan_targets.select("product", F.lit("some files were not copied").alias("warning"))
    inputs = (catalog(v), v.catalog_columns, parsed(v), models(v), source_inventory(v), deployed_inventory(v))
    return reports.env_drift(*inputs, targets=v.scan_targets, warnings=earlier, allow_empty=True)


@query("env_scoped_findings", "SELECT * EXCLUDE (source_files, source_path) FROM {finding_sources} WHERE product NOT LIKE '%1'")
def _(v):
    return scoped(v).files["bigquery_findings"][0].drop("source_files", "source_path")


@query("env_warnings", """
SELECT product, 'No datasets resolved. BigQuery comparison will be skipped.' AS warning FROM {scan_targets} WHERE datasets = ''
UNION ALL SELECT product, 'some files were not copied' FROM {scan_targets}""")
def _(v):
    return scoped(v).files["warnings"][0]


# --- CI settings and orphan datasets ---------------------------------------------------
V["settings"] = """
SELECT repo, 'BQ_PROJECT' AS key, 'proj_' || c_nationkey AS value FROM {ci_base}
UNION ALL SELECT repo, 'BQ_DATASET_NAMES' AS key, CASE WHEN c_custkey % 3 = 0 THEN '''ds_' || c_custkey * 3 || '''' ELSE 'ds_' || c_custkey * 3 || ', ds_' || (c_custkey * 3 + 1) || ',' END AS value FROM {ci_base}
UNION ALL SELECT repo, 'ENV' AS key, 'prod' AS value FROM {ci_base}
UNION ALL SELECT repo, 'GCP_BUCKET' AS key, 'b_' || c_mktsegment AS value FROM {ci_base} WHERE c_custkey % 5 = 0"""
V["ci_base"] = "SELECT 'repo_' || c_custkey AS repo, * FROM {customer}"
V["declared"] = """
SELECT repo, 'origin/production' AS git_ref, CASE WHEN c_custkey % 3 = 0 THEN 'ds_' || c_custkey * 3 ELSE 'ds_' || c_custkey * 3 || ', ds_' || (c_custkey * 3 + 1) END AS datasets,
       cast(CASE WHEN c_custkey % 3 = 0 THEN 1 ELSE 2 END AS bigint) AS dataset_count FROM {ci_base}"""
V["refs"] = "SELECT DISTINCT unnest(string_split(datasets, ', ')) AS dataset, repo FROM {declared}"


def declared(v):
    return inventory.repo_datasets(v.ci_texts)


@query("ci_settings", "SELECT * FROM {settings}")
def _(v):
    return inventory.settings_table(v.ci_texts)


@query("repo_dataset_refs", "SELECT * FROM {declared}")
def _(v):
    remote = v.ci_texts.select("repo", "git_ref", "text")
    return inventory.repo_datasets(inventory.branch_texts(remote, remote.withColumn("git_ref", F.lit("production")))).drop("names")


@query("dataset_refs", "SELECT * FROM {refs}")
def _(v):
    return inventory.dataset_refs(declared(v))


@query("dataset_ref_counts", "SELECT dataset, count(*) AS repo_count, min(repo) AS first_repo FROM {refs} GROUP BY dataset")
def _(v):
    return inventory.dataset_ref_counts(inventory.dataset_refs(declared(v)))


@query("resolve_targets", """
SELECT 'repo_' || c_custkey AS product, 'proj_' || c_nationkey AS project, 'prod' AS environment, CASE WHEN c_custkey % 5 = 0 THEN 'b_' || c_mktsegment ELSE 'bucket' END AS bucket,
       CASE WHEN c_custkey % 3 = 0 THEN '''ds_' || c_custkey * 3 || '''' ELSE 'ds_' || c_custkey * 3 || ',ds_' || (c_custkey * 3 + 1) END AS datasets FROM {customer}""")
def _(v):
    defaults = {"project": "proj", "environment": "test", "bucket": "bucket"}
    return inventory.resolve_targets(v.ci_texts.select(F.col("repo").alias("product")), inventory.settings_table(v.ci_texts), defaults)


V["unmatched"] = "SELECT dataset, project_id FROM {catalog_datasets} d WHERE NOT regexp_matches(dataset, '^_') AND NOT EXISTS (SELECT 1 FROM {refs} r WHERE r.dataset = d.dataset)"
V["unmatched_objects"] = "SELECT * FROM {dataset_objects} WHERE dataset IN (SELECT dataset FROM {unmatched})"


def unmatched(v):
    datasets = v.catalog_datasets.select("dataset", "project_id")
    return inventory.unmatched_datasets(datasets, inventory.dataset_refs(declared(v)))


@query("unmatched_datasets", "SELECT * FROM {unmatched}")
def _(v):
    return unmatched(v)


@query("unmatched_objects", "SELECT * FROM {unmatched_objects}")
def _(v):
    return inventory.unmatched_objects(v.dataset_objects, unmatched(v))


V["type_counts"] = """
SELECT dataset, cast(sum(n) AS bigint) AS object_count, '{{{{' || string_agg('"' || object_type || '":' || n, ',' ORDER BY object_type) || '}}}}' AS object_type_counts,
       string_agg(object_type || '=' || n, ', ' ORDER BY object_type) AS breakdown
FROM (SELECT dataset, object_type, count(*) AS n FROM {dataset_objects} GROUP BY ALL) GROUP BY dataset""".replace("'{{{{'", "chr(123)").replace("'}}}}'", "chr(125)")


@query("type_counts", "SELECT * FROM {type_counts}")
def _(v):
    counts = inventory.type_counts(v.dataset_objects)
    column = F.col("object_type_counts")
    return counts.select("dataset", "object_count", labels.map_json(column).alias("object_type_counts"), labels.map_text(column).alias("breakdown"))


@query("dataset_errors", """
SELECT dataset, concat_ws('; ', table_error, routine_error) AS error FROM {catalog_datasets} WHERE coalesce(table_error, routine_error) IS NOT NULL""")
def _(v):
    error = labels.join_errors(F.col("table_error"), F.col("routine_error"))
    return inventory.dataset_errors(v.catalog_datasets.withColumn("error", error))


@query("orphan_rows", """
SELECT u.dataset AS dataset_name, u.project_id, 'orphan' AS orphan_status, false AS source_reference_found, coalesce(t.object_count, 0) AS table_count,
       cast(CASE WHEN coalesce(t.object_count, 0) > 0 THEN 2 ELSE 1 END AS bigint) AS risk_score FROM {unmatched} u LEFT JOIN {type_counts} t ON t.dataset = u.dataset""")
def _(v):
    rows = unmatched(v)
    return inventory.orphan_rows(rows, inventory.type_counts(inventory.unmatched_objects(v.dataset_objects, rows)))


def owned(v):
    return reports.orphan_datasets(v.owned_datasets, v.sized_objects, v.ci_texts)


@query("orphan_facts", """
SELECT u.dataset AS dataset_name, u.project_id, 'orphan' AS orphan_status, false AS source_reference_found, coalesce(t.object_count, 0) AS table_count,
       cast(CASE WHEN coalesce(t.object_count, 0) > 0 THEN 2 ELSE 1 END AS bigint) AS risk_score, o.owner, o.last_modified
FROM {unmatched} u JOIN {owned_datasets} o ON o.dataset = u.dataset LEFT JOIN {type_counts} t ON t.dataset = u.dataset""")
def _(v):
    return owned(v).ledger["orphan_datasets"]


@query("orphan_object_facts", """
SELECT dataset AS dataset_name, object_type, object_name, last_modified, row_count, storage_mb FROM {sized_objects}
WHERE dataset IN (SELECT dataset FROM {unmatched})""")
def _(v):
    return owned(v).ledger["orphan_dataset_objects"]


@query("orphan_run_summary", """
SELECT (SELECT count(*) FROM {catalog_datasets} WHERE NOT regexp_matches(dataset, '^_')) AS datasets_scanned, (SELECT count(*) FROM {customer}) AS repos_scanned,
       (SELECT count(*) FROM {declared} WHERE dataset_count > 0) AS repos_with_dataset_refs, (SELECT count(DISTINCT dataset) FROM {refs}) AS datasets_referenced,
       (SELECT count(*) FROM {unmatched}) AS unmatched_datasets,
       (SELECT count(*) FROM {catalog_datasets} WHERE table_error IS NOT NULL AND dataset IN (SELECT dataset FROM {unmatched})) AS datasets_with_errors""")
def _(v):
    rows, repos = unmatched(v), declared(v)
    error = labels.join_errors(F.col("table_error"), F.col("routine_error"))
    failed = inventory.dataset_errors(v.catalog_datasets.withColumn("error", error)).join(rows, "dataset", "left_semi")
    return executive.count_rows(
        datasets_scanned=labels.filter_names(v.catalog_datasets, "dataset"),
        repos_scanned=v.ci_texts,
        repos_with_dataset_refs=repos.where("dataset_count > 0"),
        datasets_referenced=inventory.dataset_refs(repos).select("dataset").distinct(),
        unmatched_datasets=rows,
        datasets_with_errors=failed,
    )


# --- logs and status lines -------------------------------------------------------------
V["log_rows"] = """
SELECT repo, discrepancy, "commit", created_at, author, author_email, message || mark AS message, file_path FROM (
  SELECT 'r' || o_custkey AS repo, o_orderstatus AS discrepancy, 'c' || o_orderkey AS "commit", cast(cast(o_orderdate AS date) AS string) AS created_at, 'author_' || (o_custkey % 60) AS author,
         'a@x' AS author_email, 'commit | ' || o_orderpriority AS message, unnest(['', '', '', '!']) AS mark, unnest(['dir/a_' || o_orderkey || '.sql', 'dir/b.sql', 'dir/c.sql', 'dir/d.sql']) AS file_path
  FROM {orders})"""


@query("log_rows", "SELECT * FROM {log_rows}")
def _(v):
    return inventory.log_rows(v.log_texts)


V["log_lines"] = r"""
SELECT discrepancy, o_orderkey * 16 + i AS seq, line FROM (SELECT discrepancy, o_orderkey, unnest(l) AS line, unnest(range(len(l))) AS i
FROM (SELECT discrepancy, o_orderkey, string_split(replace(text, chr(13), ''), chr(10)) AS l FROM {log_texts}))"""


@query("log_line_rows", """
SELECT discrepancy, seq, h[1] AS "commit", h[2] AS created_at, h[3] AS author, h[4] AS author_email, array_to_string(h[5:], '|') AS message, trim(line) AS file_path
FROM (SELECT discrepancy, seq, line, string_split(substring(last_value(CASE WHEN starts_with(line, '@@@') AND len(string_split(line, '|')) >= 5 THEN line END IGNORE NULLS)
        OVER (PARTITION BY discrepancy ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 4), '|') AS h FROM {log_lines})
WHERE h IS NOT NULL AND trim(line) <> '' AND NOT starts_with(line, '@@@')""")
def _(v):
    lines = v.log_texts.select("discrepancy", "o_orderkey", F.posexplode(F.split(F.replace("text", F.lit("\r"), F.lit("")), "\n")).alias("i", "line"))
    return inventory.log_line_rows(lines.select("discrepancy", (F.col("o_orderkey") * 16 + F.col("i")).alias("seq"), "line"), ["discrepancy"])


@query("status_lines", """
SELECT l_orderkey, l_linenumber, raw_change_type, file_path, CASE substring(raw_change_type, 1, 1) WHEN 'A' THEN 'right_only' WHEN 'M' THEN 'different_content' WHEN 'R' THEN 'renamed_in_right' WHEN 'C' THEN 'copied_in_right' END AS difference_type
FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 4 THEN 'R100' WHEN l_linenumber = 5 THEN 'C075' ELSE replace(l_returnflag, 'R', 'M') END AS raw_change_type, 'f_' || l_partkey AS file_path FROM {lineitem})
WHERE raw_change_type <> 'N'""")
def _(v):
    line = F.concat(
        F.when(F.col("l_linenumber") == 4, F.lit("R100\told")).when(F.col("l_linenumber") == 5, F.lit("C075\told")).otherwise(F.replace("l_returnflag", F.lit("R"), F.lit("M"))),
        F.lit("\tf_"), F.col("l_partkey").cast("string"),
    )
    rows = v.lineitem.select("l_orderkey", "l_linenumber", text.parse_status(line).alias("s")).select("l_orderkey", "l_linenumber", "s.*")
    known = rows.withColumn("difference_type", labels.difference_type(F.col("raw_change_type")))
    return known.where(F.col("difference_type").isNotNull())


# --- small expressions, over whole tables ----------------------------------------------
@query("severity_grades", """
SELECT l_orderkey, l_linenumber, CASE WHEN q = 0 THEN 'none' WHEN q <= 5 THEN 'low' WHEN q <= 20 THEN 'medium' ELSE 'high' END AS commit_severity,
       CASE WHEN q = 0 THEN 'none' WHEN q <= 10 THEN 'low' WHEN q <= 50 THEN 'medium' ELSE 'high' END AS file_severity,
       CASE WHEN l_returnflag = 'A' THEN 'medium' ELSE 'high' END AS finding_severity, cast(CASE WHEN q > 0 THEN 2 ELSE 1 END AS bigint) AS risk_score,
       CASE WHEN q = 0 THEN 4 WHEN q <= 5 THEN 3 WHEN q <= 20 THEN 2 ELSE 1 END AS severity_rank,
       CASE WHEN q = 0 THEN 4 WHEN q <= 5 THEN 3 WHEN q <= 20 THEN 2 ELSE 1 END AS detail_rank
FROM (SELECT *, cast(l_quantity AS int) - 1 AS q FROM {lineitem})""")
def _(v):
    rows = v.lineitem.withColumn("q", F.col("l_quantity").cast("int") - 1)
    graded = labels.commit_severity(F.col("q"))
    category = F.when(F.col("l_returnflag") == "A", F.lit("only_in_source")).otherwise(F.lit("type_mismatch"))
    return rows.select(
        "l_orderkey", "l_linenumber", graded.alias("commit_severity"), labels.file_severity(F.col("q")).alias("file_severity"),
        labels.finding_severity(category).alias("finding_severity"), labels.risk_score(F.col("q")).alias("risk_score"),
        labels.severity_rank(graded).alias("severity_rank"), labels.severity_rank(graded, 3).alias("detail_rank"),
    )


@query("display_forms", """
SELECT o_orderkey, 'x' || regexp_replace(o_orderpriority, '[^A-Za-z0-9._-]', '_', 'g') AS label, CASE WHEN o_orderstatus = 'P' THEN 'N/A' ELSE o_orderstatus END AS shown,
       CASE WHEN o_orderstatus = 'O' THEN o_orderkey ELSE 0 END AS parsed, date_diff('day', cast(o_orderdate AS date), date '2002-01-01') AS days,
       CASE WHEN o_orderstatus <> 'F' THEN o_orderdate END AS instant
FROM {orders}""")
def _(v):
    number = F.when(F.col("o_orderstatus") == "O", F.col("o_orderkey").cast("string")).when(F.col("o_orderstatus") == "F", F.lit("N/A")).otherwise(F.lit(""))
    iso = F.when(F.col("o_orderstatus") == "F", F.lit("not a date")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    return v.orders.select(
        "o_orderkey", F.concat(F.lit("x"), labels.safe_label(F.col("o_orderpriority"))).alias("label"),
        labels.na_string(labels.blank_to_null(F.replace("o_orderstatus", F.lit("P"), F.lit("")))).alias("shown"),
        labels.int_or_zero(number).alias("parsed"), labels.days_since(F.col("o_orderdate"), F.lit(datetime(2002, 1, 1)).cast("date")).alias("days"),
        text.parse_ts(iso).cast("timestamp_ntz").alias("instant"),
    )


def as_given(runs):
    """Run records with the zone-free times of the given tables."""
    return runs.withColumn("execution_ts", F.col("execution_ts").cast("timestamp_ntz"))


# --- ledger writes, sinks, streams -----------------------------------------------------
@query("ledger_append_twice", "SELECT * FROM {runs}")
def _(v):
    """The same run records sent twice; the guard keeps the second round out."""
    base, as_of = scratch_path(v.spark, "ledger"), datetime(2024, 1, 2)
    for _ in range(2):
        fresh = ledger.new_runs(v.runs, ledger.read_ledger(v.spark, base, "executions"), as_of)
        ledger.append_ledger(fresh, base, "executions")
    return as_given(ledger.read_ledger(v.spark, base, "executions").drop("execution_day"))


def published_once(v) -> str:
    """The daily runs with their evidence, published by a call that is repeated."""
    base = scratch_path(v.spark, "published")
    for _ in range(2):
        published.publish(v.spark, base, v.executions, {"branch_drift_evidence": v.evidence})
    return base


@query("published_evidence", "SELECT * FROM {evidence} e WHERE EXISTS (SELECT 1 FROM {executions} x WHERE x.execution_id = e.execution_id)")
def _(v):
    rows = published.read_published(v.spark, published_once(v), "branch_drift_evidence")
    return rows.select(*v.evidence.columns).withColumn("commit_date", F.col("commit_date").cast(v.evidence.schema["commit_date"].dataType))


@query("published_latest", "SELECT e.* FROM {evidence} e JOIN {latest_commit} l ON l.execution_id = e.execution_id")
def _(v):
    rows = published.read_latest(v.spark, published_once(v), "branch_drift_evidence", "commit_drift")
    return rows.select(*v.evidence.columns).withColumn("commit_date", F.col("commit_date").cast(v.evidence.schema["commit_date"].dataType))


@query("sink_roundtrip", """
SELECT repo, discrepancy, unique_files_affected, unique_commits, status FROM {totals}""")
def _(v):
    path = scratch_path(v.spark, "totals")
    sinks.write_report_csv(v.totals, ["repo", "discrepancy"], path)
    schema = "repo string, discrepancy string, unique_files_affected string, unique_commits string, status string"
    return sinks.read_report_csv(v.spark, path, schema)


@query("run_output", """
SELECT repo, discrepancy, status, 'run-1' AS execution_id, 'content' AS mode, 'out/run-1/totals' AS folder, true AS known, false AS other FROM {totals}""")
def _(v):
    base, folder = scratch_path(v.spark, "output"), ledger.run_path("out/", "run-1", "totals")
    labels.stamp(v.totals.select("repo", "discrepancy", "status"), execution_id="run-1", mode="content").write.parquet(f"{base}/{folder}")
    written = v.spark.read.parquet(f"{base}/{folder}")
    seen = {name: runs.run_exists(written, run) for name, run in (("known", "run-1"), ("other", "run-2"))}
    return labels.stamp(written, folder=folder, **seen)


@query("union_rows", """
SELECT repo, discrepancy, unique_commits, cast(NULL AS string) AS path, cast(NULL AS string) AS compare_hash FROM {totals}
UNION ALL SELECT NULL, NULL, NULL, path, compare_hash FROM {source_inventory}""")
def _(v):
    return sinks.union_rows([v.totals.select("repo", "discrepancy", "unique_commits"), source_inventory(v).select("path", "compare_hash")])


@query("snapshot_json", """
SELECT section, record FROM (
  SELECT 'totals' AS section, chr(123) || '"repo":"' || repo || '","status":"' || status || '"' || chr(125) AS record FROM {totals}
  UNION ALL SELECT 'datasets', chr(123) || '"dataset":"' || dataset || '","table_error":' || coalesce('"' || table_error || '"', 'null') || chr(125) FROM {catalog_datasets})""")
def _(v):
    path = scratch_path(v.spark, "snapshot")
    sinks.write_snapshot_json({"totals": v.totals.select("repo", "status"), "datasets": v.catalog_datasets.select("dataset", "table_error")}, path)
    return v.spark.read.schema("record string, section string").json(path).select("section", "record")


def stream_of_runs(v, folder=None):
    """The event table as a stream of run records."""
    stream = v.spark.readStream.schema(v.events.schema).option("pathGlobFilter", "*.parquet" if folder else "events.parquet").parquet(folder or v.folder)
    kind = (
        F.when(F.col("event_type") == "click", F.lit("commit_drift")).when(F.col("event_type") == "view", F.lit("file_drift"))
        .when(F.col("event_type") == "purchase", F.lit("env_drift")).otherwise(F.lit("orphan_datasets"))
    )
    status = F.when(F.col("value") < 5, F.lit("failed")).when(F.col("value") < 10, F.lit("skipped")).otherwise(F.lit("success"))
    return stream.select(F.col("event_id").cast("string").alias("execution_id"), kind.alias("report_type"), F.col("ts").cast("timestamp").alias("execution_ts"), status.alias("status"))


@query("ingest_stream", "SELECT execution_id, report_type, execution_ts, status FROM {runs}")
def _(v):
    base = scratch_path(v.spark, "stream")
    runs = stream_of_runs(v)
    ledger_stream.ingest_runs(runs.union(runs), f"{base}/out", f"{base}/state").awaitTermination()
    return as_given(ledger_stream.read_ingested(v.spark, f"{base}/out"))


@query("ingest_stream_batches", "SELECT execution_id, report_type, execution_ts, status FROM {runs}")
def _(v):
    """Runs of late days of a month come first, then all: late runs arrive, repeats do not."""
    base = scratch_path(v.spark, "stream")
    for part in (v.events.where(F.dayofmonth("ts") > 15), v.events):
        part.write.mode("append").parquet(f"{base}/in")
        ledger_stream.ingest_runs(stream_of_runs(v, f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return as_given(ledger_stream.read_ingested(v.spark, f"{base}/out"))


@query("ingest_stream_state", "SELECT execution_id, report_type, execution_ts, status FROM {runs}")
def _(v):
    """As above, with the seen ids in a state store."""
    base = scratch_path(v.spark, "stream")
    for part in (v.events.where(F.dayofmonth("ts") > 15), v.events):
        part.write.mode("append").parquet(f"{base}/in")
        ledger_stream.ingest_with_state(stream_of_runs(v, f"{base}/in"), f"{base}/out", f"{base}/state").awaitTermination()
    return as_given(ledger_stream.read_ingested(v.spark, f"{base}/out"))


@query("daily_summary_stream", "SELECT * FROM {daily}")
def _(v):
    base = scratch_path(v.spark, "stream")
    ledger_stream.run_daily_summary(stream_of_runs(v), f"{base}/out", f"{base}/state").awaitTermination()
    return ledger_stream.read_daily_summary(v.spark, f"{base}/out")
