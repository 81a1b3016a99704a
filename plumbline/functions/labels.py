"""Predicates, labels, grades and display forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.constants import (
    BASE_PROBLEM,
    COMMIT_CUTS,
    COMMIT_PROBLEM,
    DIFFERENCE_TYPES,
    DIRECTIONS,
    FILE_CUTS,
    NOT_AVAILABLE,
    REMOTE,
    SEVERITY_RANKS,
    TIPS_PROBLEM,
    TYPE_ALIASES,
)


def is_blank(c: Column) -> Column:
    return c.isNull() | (c == "")


def is_present(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def filter_names(df: DataFrame, column: str, include: str = ".*", exclude: str | None = "^_") -> DataFrame:
    """Keep names that contain a match of ``include`` and none of ``exclude``."""
    kept = F.col(column).rlike(include)
    if exclude:
        kept = kept & ~F.col(column).rlike(exclude)
    return df.where(kept)


def lookup(c: Column, mapping: dict, default: Column | None = None) -> Column:
    """Value of ``c`` in a small fixed mapping, else ``default``."""
    found = None
    for key, value in mapping.items():
        test = c == F.lit(key)
        found = F.when(test, F.lit(value)) if found is None else found.when(test, F.lit(value))
    return found if default is None else found.otherwise(default)


def branch_name(ref: Column) -> Column:
    """Branch of a remote ref; NULL when the ref has no remote part."""
    return F.nullif(F.regexp_extract(ref, REMOTE + "(.+)", 1), F.lit(""))


def direction(right: Column, left: Column, verb: str) -> Column:
    return F.concat(branch_name(right), F.lit(f" {verb} "), branch_name(left))


def discrepancy_key(right: Column, left: Column, strict: bool = False) -> Column:
    """Evidence key of a KPI row.

    Evidence shortens ``production`` to ``prod``; ``strict`` keeps the long
    name, as the dashboard query in the field does, so those rows stay unmatched.
    """

    def name(ref: Column) -> Column:
        branch = branch_name(ref)
        return branch if strict else F.when(branch == "production", F.lit("prod")).otherwise(branch)

    return F.concat(name(right), F.lit("_not_in_"), name(left))


def severity_rank(c: Column, levels: int = 4) -> Column:
    """Sort rank of a severity; detail views rank only the first three (``levels=3``)."""
    ranks = {name: rank for name, rank in SEVERITY_RANKS.items() if rank <= levels}
    return lookup(c, ranks, F.lit(levels + 1))


def severity(n: Column, cuts: tuple[int, int]) -> Column:
    low, medium = cuts
    return (
        F.when(n.isNull(), F.lit(NOT_AVAILABLE))
        .when(n == 0, F.lit("none"))
        .when(n <= low, F.lit("low"))
        .when(n <= medium, F.lit("medium"))
        .otherwise(F.lit("high"))
    )


def commit_severity(n: Column) -> Column:
    return severity(n, COMMIT_CUTS)


def file_severity(n: Column) -> Column:
    return severity(n, FILE_CUTS)


def finding_severity(category: Column) -> Column:
    return F.when(category == "only_in_source", F.lit("medium")).otherwise(F.lit("high"))


def risk_score(object_count: Column) -> Column:
    return F.when(object_count > 0, F.lit(2)).otherwise(F.lit(1)).cast("bigint")


def na_string(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(NOT_AVAILABLE))


def int_or_zero(c: Column) -> Column:
    return F.coalesce(c.try_cast("bigint"), F.lit(0).cast("bigint"))


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def change_code(raw: Column) -> Column:
    """Change letter without its similarity digits."""
    return F.regexp_replace(raw, "[0-9]+$", "")


def difference_type(raw: Column) -> Column:
    """Kind of difference of a name-status code; NULL when the code is unknown."""
    return lookup(change_code(raw), DIFFERENCE_TYPES)


def norm_type(c: Column) -> Column:
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def canonical_type(c: Column) -> Column:
    cleaned = norm_type(F.trim(F.coalesce(c, F.lit(""))))
    return lookup(cleaned, TYPE_ALIASES, cleaned)


def technology(path: Column) -> Column:
    return (
        F.when(path.startswith("dbt/"), F.lit("dbt"))
        .when(path.startswith("python/"), F.lit("python"))
        .otherwise(F.lit("unknown"))
    )


def norm_path(path: Column) -> Column:
    """Undo the doubled area folder that a recursive copy leaves behind."""
    return F.regexp_replace(path, r"^(dbt|python)/\1/", "$1/")


def in_compared_areas(path: Column) -> Column:
    return path.startswith("dbt/") | path.startswith("python/")


def is_model(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.array_contains(parts, "models") & ~F.array_contains(parts, "target")


def is_deployable(materialized: Column) -> Column:
    return ~materialized.eqNullSafe("ephemeral")


def stamp(df: DataFrame, **values) -> DataFrame:
    """Add run-constant columns such as execution_id, run_date or a mode."""
    return df.select("*", *[F.lit(value).alias(name) for name, value in values.items()])


def output_url(path: Column, prefix: Column, execution_id: Column, browser: str, bucket: str) -> Column:
    """Browser link of a run's output; rebuilt from prefix and id when no path is stored."""
    stored = F.concat(F.lit(browser), F.regexp_replace(path, "^gs://", ""))
    folder = F.concat(F.when(prefix != "", F.concat(prefix, F.lit("/"))).otherwise(F.lit("")), execution_id)
    rebuilt = F.concat(F.lit(f"{browser}{bucket}/"), folder)
    return F.coalesce(F.when(is_present(path), stored), F.when(is_present(execution_id), rebuilt))


def short_id(c: Column) -> Column:
    return F.substring(c, 1, 8)


def status_label(c: Column) -> Column:
    return F.coalesce(c, F.lit("unknown"))


def days_since(ts: Column, as_of: Column) -> Column:
    return F.date_diff(as_of, F.to_date(ts)).cast("bigint")


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(a: Column, b: Column) -> Column:
    return F.try_divide(a, b)


def map_json(entries: Column) -> Column:
    return F.to_json(entries)


def map_text(entries: Column) -> Column:
    """``k=v, k=v`` of a map, in key order."""
    pairs = F.array_sort(F.map_entries(entries))
    shown = F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.array_join(shown, ", ")


def safe_label(c: Column) -> Column:
    return F.regexp_replace(c, "[^A-Za-z0-9._-]", "_")


def content_problem(mode: str, left: Column, right: Column) -> Column:
    """Problem statement of a file-drift row."""
    if mode == "merge_base":
        return F.format_string(BASE_PROBLEM, left, right, right)
    return F.format_string(TIPS_PROBLEM, left, right)


def commit_problem(left: Column, right: Column) -> Column:
    """Problem statement of a commit-drift row."""
    return F.format_string(COMMIT_PROBLEM, branch_name(right), branch_name(left))


def ref(branch: Column) -> Column:
    return F.concat(F.lit(REMOTE), branch)


def directions() -> Column:
    """The six directed pairs as an array of structs, to explode per repository."""
    return F.array(
        *[
            F.struct(
                F.lit(name).alias("discrepancy"),
                F.lit(left).alias("left_name"),
                F.lit(right).alias("right_name"),
            )
            for name, left, right in DIRECTIONS
        ]
    )


def join_errors(*errors: Column) -> Column:
    """Partial errors of one dataset as one text; NULL when there is none."""
    return F.nullif(F.concat_ws("; ", *errors), F.lit(""))
