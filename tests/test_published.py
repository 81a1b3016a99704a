import pytest

from plumbline.sources import published
from plumbline.sources.schemas import LEDGER
from tests.conftest import rows

RUNS = "execution_id string, report_type string, execution_ts timestamp, status string"
KPIS = "execution_id string, run_date date, repo string"
FINDINGS = "execution_id string, object_name string"


def day(spark, text):
    return spark.sql(f"SELECT timestamp'{text}' AS t").first().t


@pytest.fixture
def parts(spark, table):
    def make(*ids):
        runs = table(RUNS, *[(i, "commit_drift", day(spark, f"2024-01-{k + 1:02d}"), "success") for k, i in enumerate(ids)])
        kpis = table(KPIS, *[(i, None, f"repo{k}") for i in ids for k in range(3)])
        findings = table(FINDINGS, *[(i, f"object{k}") for i in ids for k in range(2)])
        return runs, {"branch_drift_kpis": kpis, "env_drift_findings": findings}

    return make


def count(spark, base):
    return [published.read_published(spark, base, n).count() for n in ("executions", "branch_drift_kpis", "env_drift_findings")]


def test_a_run_that_ends_between_two_tables_is_repeated_whole(spark, parts, tmp_path, monkeypatch):
    base, write = str(tmp_path), published.write_child
    runs, children = parts("a", "b")

    def ended(rows, base, name, *more):
        if name == "env_drift_findings":
            raise OSError("the driver is lost")
        write(rows, base, name, *more)

    monkeypatch.setattr(published, "write_child", ended)
    with pytest.raises(OSError):
        published.publish(spark, base, runs, children)
    assert count(spark, base) == [0, 0, 0]
    assert published.unpublished(spark, base, "branch_drift_kpis").count() == 1
    monkeypatch.setattr(published, "write_child", write)
    assert published.publish(spark, base, runs, children) == 2
    assert count(spark, base) == [2, 6, 4]
    assert published.publish(spark, base, *parts("b", "c")) == 1  # b is known
    assert count(spark, base) == [3, 9, 6]
    assert published.publish(spark, base, runs, children) == 0
    assert count(spark, base) == [3, 9, 6]


def test_of_two_attempts_at_once_one_counts(spark, parts, tmp_path, monkeypatch):
    base, write = str(tmp_path), published.write_child
    runs, children = parts("a")

    def other_first(rows, base, name, *more):
        monkeypatch.setattr(published, "write_child", write)
        published.publish(spark, base, runs, children)
        write(rows, base, name, *more)

    monkeypatch.setattr(published, "write_child", other_first)
    published.publish(spark, base, runs, children)
    assert count(spark, base) == [1, 3, 2]


def test_one_run_reads_its_own_files(spark, parts, tmp_path):
    base = str(tmp_path)
    published.publish(spark, base, *parts("a", "b/1 =x", "7"))
    published.publish(spark, base, *parts("d"))
    one = published.read_run(spark, base, "branch_drift_kpis", "b/1 =x")
    assert one.columns == LEDGER["branch_drift_kpis"].schema.fieldNames()
    assert {(r.execution_id, r.run_date, r.repo) for r in one.collect()} == {("b/1 =x", None, f"repo{k}") for k in range(3)}
    scan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(run" in scan or "PartitionFilters: [isnotnull(attempt" in scan
    for file in tmp_path.glob("branch_drift_kpis/*/*/*.parquet"):
        if "/run=b" not in str(file):
            file.write_bytes(b"not a table")  # a read that opened it would fail
    assert published.read_run(spark, base, "branch_drift_kpis", "b/1 =x").count() == 3
    with pytest.raises(Exception, match="not a Parquet file|CANNOT_READ|FAILED_READ"):
        published.read_published(spark, base, "branch_drift_kpis").collect()
    assert published.read_run(spark, base, "env_drift_findings", "7").count() == 2
    assert published.read_run(spark, base, "branch_drift_kpis", "none").count() == 0
    assert rows(published.read_latest(spark, base, "env_drift_findings", "commit_drift").select("execution_id")) == [("7",)] * 2
    assert published.read_latest(spark, base, "env_drift_findings", "env_drift").count() == 0


def test_odd_calls(spark, table, parts, tmp_path):
    base = str(tmp_path)
    with pytest.raises(ValueError, match="child tables"):
        published.publish(spark, base, *parts("a")[:1], {"executions": parts("a")[0]})
    runs, children = parts("a")
    stray = children["env_drift_findings"].unionByName(table(FINDINGS, ("z", "of another run")))
    assert published.publish(spark, base, runs.unionByName(runs), {"env_drift_findings": stray, "branch_drift_kpis": children["branch_drift_kpis"].where("false")}) == 1
    assert count(spark, base) == [1, 0, 2]
    assert published.publish(spark, str(tmp_path / "new"), runs.where("false"), children) == 0
