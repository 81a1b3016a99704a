"""Comparing two sides of a snapshot: keys, files, objects, columns, definitions, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline import constants
from plumbline.functions.labels import canonical_type, finding_severity, is_deployable, technology
from plumbline.functions.text import definition_body, normalize_sql, strip_project
from plumbline.session import cut_lineage

FINDING = ["area", "product", "name", "dataset", "status", "severity", "source_technology", "details", "source_hash", "env_hash"]


def keys_union(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).union(b.select(*keys)).distinct()


def keys_except(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).subtract(b.select(*keys))


def keys_intersect(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys).intersect(b.select(*keys))


def sorted_distinct(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).distinct().orderBy(column)


def _finding(area: str, status: Column | str, **given: Column | str | None) -> list[Column]:
    """Columns of a finding row; unset ones are NULL."""
    status = F.lit(status) if isinstance(status, str) else status
    values = {"area": F.lit(area), "status": status, "severity": finding_severity(status), **given}
    out = []
    for name in FINDING:
        value = values.get(name)
        value = value if isinstance(value, Column) else F.lit(value)
        out.append(value.cast("string").alias(name))
    return out


def compare_files(source: DataFrame, deployed: DataFrame) -> DataFrame:
    """Findings of source files against deployed files, by product and path.

    Only path and hash cross the network. Equal files give no row.
    """
    keys = ["product", "path"]
    left = source.select(*keys, F.col("compare_hash").alias("source_hash"))
    right = deployed.select(*keys, F.col("compare_hash").alias("env_hash"))
    both = left.join(right, keys, "full_outer").where(~F.col("source_hash").eqNullSafe(F.col("env_hash")))
    status = (
        F.when(F.col("env_hash").isNull(), F.lit("only_in_source"))
        .when(F.col("source_hash").isNull(), F.lit("only_in_gcs"))
        .otherwise(F.lit("content_mismatch"))
    )
    details = (
        F.when(status == "only_in_source", F.lit(constants.FILE_ONLY_SOURCE))
        .when(status == "only_in_gcs", F.lit(constants.FILE_ONLY_DEPLOYED))
        .otherwise(F.lit(constants.FILE_DIFFERS))
    )
    return both.select(
        *_finding(
            "gcs",
            status,
            product=F.col("product"),
            name=F.col("path"),
            source_technology=technology(F.col("path")),
            details=details,
            source_hash=F.col("source_hash"),
            env_hash=F.col("env_hash"),
        )
    )


def only_in_catalog(catalog: DataFrame, ddl: DataFrame, models: DataFrame) -> DataFrame:
    """Catalog objects that neither a definition nor a deployable model declares.

    Definitions are matched by (product, dataset, object); models, and
    definitions without a dataset, by (product, object), since their dataset is
    set by deployment.
    """
    placed = ddl.where(F.col("dataset").isNotNull()).select("product", "dataset", "object_name")
    by_name = ddl.where(F.col("dataset").isNull()).select("product", "object_name")
    by_name = by_name.unionByName(models.where(is_deployable(F.col("materialized"))).select("product", "object_name"))
    rest = catalog.join(placed, ["product", "dataset", "object_name"], "left_anti")
    rest = rest.join(by_name, ["product", "object_name"], "left_anti")
    return rest.select(
        *_finding(
            "bigquery",
            "only_in_bq",
            product=F.col("product"),
            name=F.col("object_name"),
            dataset=F.col("dataset"),
            source_technology="unknown",
            details=F.format_string(constants.OBJECT_ONLY_CATALOG, F.col("object_type")),
        )
    )


def only_in_source(catalog: DataFrame, ddl: DataFrame, models: DataFrame) -> DataFrame:
    """Definitions and deployable models the catalog lacks; a definition goes before a model of its name."""
    placed = ddl.where(F.col("dataset").isNotNull()).join(
        catalog.select("product", "dataset", "object_name"), ["product", "dataset", "object_name"], "left_anti"
    )
    names = catalog.select("product", "object_name")
    loose = ddl.where(F.col("dataset").isNull()).join(names, ["product", "object_name"], "left_anti")
    missing_models = (
        models.where(is_deployable(F.col("materialized")))
        .join(names, ["product", "object_name"], "left_anti")
        .join(ddl.select("product", "object_name"), ["product", "object_name"], "left_anti")
    )
    columns = ["product", "dataset", "object_name"]
    rows = (
        placed.select(*columns, F.lit("bq").alias("kind"))
        .unionByName(loose.select(*columns, F.lit("bq").alias("kind")))
        .unionByName(
            missing_models.select("product", F.lit(None).cast("string").alias("dataset"), "object_name", F.lit("dbt_model").alias("kind"))
        )
    )
    return rows.select(
        *_finding(
            "bigquery",
            "only_in_source",
            product=F.col("product"),
            name=F.col("object_name"),
            dataset=F.col("dataset"),
            source_technology=F.col("kind"),
            details=F.format_string(constants.OBJECT_ONLY_SOURCE, F.col("kind")),
        )
    )


OBJECT = ["product", "dataset", "object_name"]


def type_mismatch(catalog: DataFrame, ddl: DataFrame) -> DataFrame:
    """Objects on both sides whose known source type is another than the catalog type."""
    both = ddl.select(*OBJECT, F.col("object_type").alias("source_type")).join(
        catalog.select(*OBJECT, F.col("object_type").alias("env_type")), OBJECT
    )
    source, env = canonical_type(F.col("source_type")), canonical_type(F.col("env_type"))
    return both.where(~source.isin("unknown", "") & (source != env)).select(
        *_finding(
            "bigquery",
            "type_mismatch",
            product=F.col("product"),
            name=F.col("object_name"),
            dataset=F.col("dataset"),
            source_technology="bq",
            details=F.format_string(constants.TYPE_DIFFERS, F.col("source_type"), F.col("env_type")),
        )
    )


def column_diff(source: DataFrame, actual: DataFrame, keys: Sequence[str] = OBJECT) -> DataFrame:
    """One row per differing column of the objects that have columns on both sides.

    Inputs hold ``keys, column_name, data_type``. ``difference`` is one of
    missing, extra, retyped. Both sides are united and grouped by column once,
    and that narrow table is written, since it is read for the objects as well.
    """

    def compact(c: Column) -> Column:
        return F.upper(F.regexp_replace(F.trim(c), r"\s*([,<>()])\s*", "$1"))

    keys = list(keys)
    nothing = F.lit(None).cast("string")
    kind = F.coalesce("data_type", F.lit(""))
    rows = source.select(*keys, "column_name", kind.alias("source_type"), nothing.alias("env_type")).unionByName(
        actual.select(*keys, "column_name", nothing.alias("source_type"), kind.alias("env_type"))
    )
    merged = cut_lineage(
        rows.groupBy(*keys, "column_name").agg(F.max("source_type").alias("source_type"), F.max("env_type").alias("env_type")),
        "columns",
    )
    sides = merged.groupBy(*keys).agg(F.count("source_type").alias("in_source"), F.count("env_type").alias("in_env"))
    two_sided = sides.where((F.col("in_source") > 0) & (F.col("in_env") > 0)).select(*keys)
    difference = (
        F.when(F.col("env_type").isNull(), F.lit("missing"))
        .when(F.col("source_type").isNull(), F.lit("extra"))
        .when(compact(F.col("source_type")) != compact(F.col("env_type")), F.lit("retyped"))
    )
    changed = merged.withColumn("difference", difference).where(F.col("difference").isNotNull())
    return changed.join(two_sided, keys, "left_semi")


def schema_diff(source: DataFrame, actual: DataFrame) -> DataFrame:
    """Numbers of differing columns per object; the columns themselves are the rows of :func:`column_diff`."""
    counts = {"missing_in_prod": "missing", "extra_in_prod": "extra", "type_mismatch": "retyped"}
    return column_diff(source, actual).groupBy(*OBJECT).agg(
        *[F.count_if(F.col("difference") == kind).alias(name) for name, kind in counts.items()]
    )


def schema_mismatch(source: DataFrame, actual: DataFrame) -> DataFrame:
    """One finding per object with differing columns, however many they are."""
    return schema_diff(source, actual).select(
        *_finding(
            "bigquery",
            "schema_mismatch",
            product=F.col("product"),
            name=F.col("object_name"),
            dataset=F.col("dataset"),
            source_technology="bq",
            details=F.format_string(constants.SCHEMA_DIFFERS, "missing_in_prod", "extra_in_prod", "type_mismatch"),
        )
    )


def view_text(c: Column, project: Column, body_only: bool = True) -> Column:
    """Comparable form of a view: its body without project names, comments and layout."""
    stripped = strip_project(F.coalesce(c, F.lit("")), project)
    return normalize_sql(definition_body(stripped) if body_only else stripped)


def definition_mismatch(catalog: DataFrame, fragments: DataFrame, project: Column | None = None) -> DataFrame:
    """Views whose source text and catalog text differ after normalisation.

    ``fragments`` has one row per source file of a view (OBJECT, path, text).
    Texts are normalised and hashed where they are read. A view in one file
    compares by hash. A view in several files has as ``source_hash`` one hash
    over the sum of its files' hashes, at every size. Its joined text can equal
    the catalog text only when the lengths add up: for those alone the parts are
    put together and compared, so what is gathered is never longer than a
    definition the catalog holds in one cell.
    """
    project = F.col("project") if project is None else project
    actual = catalog.select(
        *OBJECT, view_text(F.coalesce(F.when(F.col("view_query") != "", F.col("view_query")), F.col("ddl")), project).alias("env_text")
    ).where(F.col("env_text") != "")
    actual = actual.select(*OBJECT, F.length("env_text").alias("env_length"), F.sha2("env_text", 256).alias("env_hash"))
    parts = fragments.select(*OBJECT, "path", view_text(F.col("text"), project).alias("source_text")).where(
        F.col("source_text") != ""
    )
    text_hash = F.sha2("source_text", 256)
    placed = F.conv(F.substring(F.sha2(F.concat("path", F.lit("\n"), text_hash), 256), 1, 15), 16, 10).cast("decimal(20,0)")
    sizes = parts.select(*OBJECT, F.length("source_text").alias("n"), text_hash.alias("h"), placed.alias("placed"))
    summed = sizes.groupBy(*OBJECT).agg(
        F.count(F.lit(1)).alias("files"),
        (F.sum("n") + F.count(F.lit(1)) - 1).alias("source_length"),
        F.max("h").alias("one_hash"),
        F.sha2(F.sum("placed").cast("string"), 256).alias("files_hash"),
    )
    paired = cut_lineage(summed.join(actual, OBJECT), "views")  # one narrow row per view, read three times
    split = paired.where((F.col("files") > 1) & (F.col("source_length") == F.col("env_length"))).select(*OBJECT)
    joined = (
        parts.join(split, OBJECT, "left_semi")
        .groupBy(*OBJECT)
        .agg(F.sort_array(F.collect_list(F.struct("path", "source_text"))).alias("parts"))
        .select(*OBJECT, F.sha2(F.array_join(F.col("parts.source_text"), " "), 256).alias("joined_hash"))
    )
    compared = F.when(F.col("files") == 1, F.col("one_hash")).otherwise(F.col("joined_hash"))
    hashed = paired.join(joined, OBJECT, "left").withColumn(
        "source_hash", F.when(F.col("files") == 1, F.col("one_hash")).otherwise(F.col("files_hash"))
    )
    return hashed.where(~compared.eqNullSafe(F.col("env_hash"))).select(
        *_finding(
            "bigquery",
            "definition_mismatch",
            product=F.col("product"),
            name=F.col("object_name"),
            dataset=F.col("dataset"),
            source_technology="bq",
            details=F.lit(constants.DEFINITION_DIFFERS),
            source_hash=F.col("source_hash"),
            env_hash=F.col("env_hash"),
        )
    )


def ledger_findings(catalog_findings: DataFrame, file_findings: DataFrame) -> DataFrame:
    """Both kinds of findings as rows of the findings ledger table, tagged by component."""

    def rows(df: DataFrame, component: str) -> DataFrame:
        return df.select(
            "product",
            F.lit(component).alias("component_type"),
            F.col("source_technology").alias("object_type"),
            F.col("name").alias("object_name"),
            F.col("status").alias("drift_category"),
            "source_hash",
            "env_hash",
            "severity",
        )

    return rows(catalog_findings, "bigquery").unionByName(rows(file_findings, "gcs"))


def source_paths(findings: DataFrame, ddl_files: DataFrame, models: DataFrame) -> DataFrame:
    """Source paths of catalog findings as rows: the definition files of the object, or the model file.

    ``ddl_files`` holds product, dataset, object_name, path. An object with very
    many files stays as many rows.
    """
    keys = ["product", "dataset", "name", "source_technology"]
    files = ddl_files.select("product", "dataset", F.col("object_name").alias("name"), F.lit("bq").alias("source_technology"), "path")
    model_files = models.select(
        "product",
        F.lit(None).cast("string").alias("dataset"),
        F.col("object_name").alias("name"),
        F.lit("dbt_model").alias("source_technology"),
        F.col("relative_path").alias("path"),
    )
    found = findings.select(*keys).distinct()
    paths = files.unionByName(model_files).distinct()
    return paths.join(found, [paths[k].eqNullSafe(found[k]) for k in keys], "left_semi")


def finding_sources(findings: DataFrame, ddl_files: DataFrame, models: DataFrame) -> DataFrame:
    """Catalog findings, one row each, with the number of source files and the first of them by path."""
    keys = ["product", "dataset", "name", "source_technology"]
    first = source_paths(findings, ddl_files, models).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("source_files"), F.min("path").alias("source_path")
    )
    joined = findings.join(first, [findings[k].eqNullSafe(first[k]) for k in keys], "left")
    return joined.select(findings["*"], F.coalesce("source_files", F.lit(0)).alias("source_files"), "source_path")


REPORT_KEY = ["repo", "discrepancy", "commit", "file_path"]


def report_diff(
    old: DataFrame, new: DataFrame, order: str, keys: Sequence[str] = REPORT_KEY, ignore_case: bool = False
) -> DataFrame:
    """Rows of one report only, with ``side``; the last of repeated rows (by ``order``) stands for a key.

    One-sided keys are found from the keys alone. Where few keys are one-sided,
    adaptive execution sends them to the rows, so the other columns of rows that
    agree stay where they are read. With ``ignore_case`` keys are compared, and
    shown, in lower case.
    """
    if ignore_case:
        lowered = {k: F.lower(F.col(k)) for k in keys}
        old, new = old.withColumns(lowered), new.withColumns(lowered)
    payload = [c for c in old.columns if c not in (*keys, order)]
    tagged = old.withColumn("side", F.lit("old")).unionByName(new.withColumn("side", F.lit("new")))
    lonely = (
        tagged.select(*keys, "side").groupBy(*keys).agg(F.min("side").alias("_first"), F.max("side").alias("_last"))
        .where(F.col("_first") == F.col("_last")).select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    )
    rows = tagged.join(lonely, [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_semi")
    row = F.struct(*[F.col(c) for c in payload], F.lit(1).alias("_present"))
    last = rows.groupBy("side", *keys).agg(F.max_by(row, order).alias("row"))
    side = F.when(F.col("side") == "old", F.lit("only_in_old")).otherwise(F.lit("only_in_new"))
    return last.select(side.alias("side"), *keys, *[F.col(f"row.{c}").alias(c) for c in payload])


def pair_delta(old: DataFrame, new: DataFrame) -> DataFrame:
    """Row counts per repository and direction in both reports, where they differ."""
    pair = ["repo", "discrepancy"]
    tagged = old.select(*pair, F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(
        new.select(*pair, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    counted = tagged.groupBy(*pair).agg(F.sum("o").alias("count_old"), F.sum("n").alias("count_new"))
    return counted.withColumn("delta", F.col("count_new") - F.col("count_old")).where(F.col("delta") != 0)


def one_row(*frames: DataFrame) -> DataFrame:
    """One-row frames side by side, without a cross join."""
    names = [name for frame in frames for name in frame.columns]
    rows = frames[0]
    for frame in frames[1:]:
        rows = rows.unionByName(frame, allowMissingColumns=True)
    return rows.agg(*[F.max(name).alias(name) for name in names])


def diff_summary(old: DataFrame, new: DataFrame, keys: Sequence[str] = REPORT_KEY) -> DataFrame:
    """Row counts, one-sided key counts and changed pairs of two reports, as one row."""
    tagged = old.select(*keys, F.lit(1).alias("o"), F.lit(0).alias("n")).unionAll(
        new.select(*keys, F.lit(0).alias("o"), F.lit(1).alias("n"))
    )
    by_key = tagged.groupBy(*keys).agg(F.sum("o").alias("o"), F.sum("n").alias("n"))
    rows = by_key.agg(
        F.coalesce(F.sum("o"), F.lit(0)).alias("rows_old"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_new"),
        F.coalesce(F.sum("n") - F.sum("o"), F.lit(0)).alias("delta_rows"),
        F.count_if(F.col("n") == 0).alias("only_in_old"),
        F.count_if(F.col("o") == 0).alias("only_in_new"),
    )
    pairs = (
        by_key.groupBy("repo", "discrepancy")
        .agg((F.sum("n") - F.sum("o")).alias("delta"))
        .agg(F.count_if(F.col("delta") != 0).alias("changed_repo_discrepancy_pairs"))
    )
    return one_row(rows, pairs)
