"""Row orders of reports, which comparisons without order cannot see."""

import pytest

from bindings import bound
from plumbline.sources import reports

FOLDER = "/root/testdata/sf0.001"
RANK = {"high": 1, "medium": 2, "low": 3, "none": 4}


def rank(name, levels=4):
    found = RANK.get(name, 9)
    return found if found <= levels else 9


class Down:
    """A value that sorts from high to low, NULL last."""

    def __init__(self, value):
        self.value = value

    def __eq__(self, other):
        return self.value == other.value

    def __lt__(self, other):
        if self.value is None or other.value is None:
            return other.value is None and self.value is not None
        return self.value > other.value


def up(*values):
    """Values that sort from low to high, NULL first."""
    return tuple((v is not None, v) if v is not None else (False, 0) for v in values)


ORDERS = {
    "commit_kpi_report": lambda r: (rank(r.severity), Down(r.unique_commits), *up(r.repo, r.left_branch)),
    "file_kpi_report": lambda r: (rank(r.severity), Down(r.unique_files), *up(r.repo, r.left_branch)),
    "orphan_summary_report": lambda r: (Down(r.risk_score), Down(r.total_storage_mb), *up(r.dataset_name)),
    "commit_detail": lambda r: (*up(r.repo, r.drift_direction), Down(r.commit_date), *up(r.commit_sha, r.file_path)),
    "file_detail": lambda r: up(r.repo, r.drift_direction, r.file_path),
    "env_detail": lambda r: (rank(r.severity, 3), *up(r.product, r.component_type, r.object_name)),
    "orphan_detail": lambda r: (Down(r.risk_score), *up(r.dataset_name, r.object_type, r.object_name)),
}


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_rows_come_in_order(spark, name):
    got = bound()[name](spark, FOLDER).collect()
    keys = [ORDERS[name](row) for row in got]
    assert len(got) > 3 and any(a != b for a, b in zip(keys, keys[1:]))
    assert all(not b < a for a, b in zip(keys, keys[1:])), name


def test_written_report_is_sorted_across_its_files(spark, tmp_path):
    path, small = str(tmp_path / "report"), "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(small, "false")  # a report this small would be one file
    rows = spark.range(5000).selectExpr("concat('r', id % 7) AS repo", "lpad(id, 5, '0') AS path").repartition(6)
    try:
        reports.write_report_csv(rows, ["repo", "path"], path)
    finally:
        spark.conf.unset(small)
    files = sorted(p for p in (tmp_path / "report").iterdir() if p.name.startswith("part-"))
    assert len(files) > 1
    lines = [line for p in files for line in p.read_text(encoding="utf-8-sig").splitlines() if "repo" not in line]
    cells = [tuple(c.strip('"') for c in line.split(",")) for line in lines]
    assert len(cells) == 5000 and cells == sorted(cells)
