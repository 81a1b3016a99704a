"""Report files: CSV, JSON snapshots and numbered text."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.operators.skew import rank_within


# Values are kept as they are: blanks at their ends, quotes and line ends.
WRITE = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
READ = {**WRITE, "multiLine": True}


def read_report_csv(spark: SparkSession, path: str, schema: str | None = None, multi_line: bool = True) -> DataFrame:
    """Report rows as strings; give ``schema`` to skip reading the header first.

    A value may hold line ends, so a file is one task, and the writer makes many
    files. ``multi_line=False`` splits large files whose values hold none.
    """
    reader = spark.read.options(**READ).option("multiLine", multi_line)
    return (reader.schema(schema) if schema else reader).csv(path)


def write_report_csv(df: DataFrame, sort_columns: Sequence[str], path: str) -> None:
    """Sorted rows under a fixed header; the range sort keeps the part files in order."""
    ordered = df.orderBy(*sort_columns) if sort_columns else df
    ordered.write.mode("overwrite").options(**WRITE).option("maxRecordsPerFile", 1_000_000).csv(path)


def union_rows(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows under the union of the columns, in order of first appearance."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def write_union_csv(frames: Sequence[DataFrame], path: str) -> None:
    union_rows(frames).write.mode("overwrite").options(**WRITE).csv(path)


def snapshot_rows(sections: dict[str, DataFrame]) -> DataFrame:
    """One JSON record per row of every section, so no section is gathered whole."""
    return union_rows(
        [
            df.select(F.lit(name).alias("section"), F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
            for name, df in sections.items()
        ]
    )


def write_snapshot_json(sections: dict[str, DataFrame], path: str) -> None:
    snapshot_rows(sections).write.mode("overwrite").partitionBy("section").json(path)


def render_findings(findings: DataFrame) -> DataFrame:
    """Numbered finding lines over both sections, catalog findings first.

    Expects ``section`` (order of the section), ``seq`` (order inside it),
    ``status``, ``name``, ``source_technology``, ``source_path`` and ``details``.
    """
    numbered = rank_within(findings, [], ["section", "seq"], "finding_number")
    where = F.coalesce(F.concat(F.lit(" [source_path="), F.col("source_path"), F.lit("]")), F.lit(""))
    head = F.format_string(
        "%d. `%s` `%s` [source=%s]", "finding_number", "status", "name", F.coalesce("source_technology", F.lit("unknown"))
    )
    line = F.concat(head, where, F.lit(": "), F.coalesce("details", F.lit("None")))
    return numbered.select("finding_number", line.alias("line"))


def write_text_report(lines: DataFrame, order: Sequence[str], path: str) -> None:
    lines.orderBy(*order).select("line").write.mode("overwrite").text(path)
