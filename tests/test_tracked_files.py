import hashlib
import os

import pytest

from plumbline.sources import tracked_files
from plumbline.sources.files import file_inventory, scan_tree


def put(root, name, data, at=None):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)
    if at is not None:
        os.utime(path, (at, at))


def found(spark, base):
    return {r.path: r.sha256 for r in tracked_files.read_tracked(spark, base).collect()}


def wanted(root):
    return {str(p.relative_to(root)): hashlib.sha256(p.read_bytes()).hexdigest() for p in root.rglob("*") if p.is_file() and p.name != ".gitkeep"}


def rows_of(spark, base, gen):
    return sorted((r.path, r.gone) for r in spark.read.parquet(f"{base}/rows/gen={gen}").collect())


def test_only_changed_files_are_read(spark, tmp_path):
    root, base = tmp_path / "tree", str(tmp_path / "inventory")
    for i in range(12):
        put(root, f"dbt/m{i}.sql", b"select %d\r\n" % i, 1_700_000_000 + i)
    put(root, "dbt/.gitkeep", b"")
    tracked_files.track_files(spark, str(root), base)
    assert found(spark, base) == wanted(root) and len(wanted(root)) == 12

    held = wanted(root)
    put(root, "dbt/m3.sql", b"select 9\r\n", 1_700_000_003)  # same size and time: would change its hash if it were read
    put(root, "dbt/m5.sql", b"select 55\r\n", 1_700_000_100)
    tracked_files.track_files(spark, str(root), base)
    assert rows_of(spark, base, 1) == [("dbt/m5.sql", False)]
    after = found(spark, base)
    assert after["dbt/m5.sql"] == hashlib.sha256(b"select 55\r\n").hexdigest()
    assert after["dbt/m3.sql"] == held["dbt/m3.sql"]

    put(root, "dbt/deep/old name.sql", b"x", 1_600_000_000)  # older than all that was read
    put(root, "dbt/m1.sql", b"longer text", 1_500_000_000)
    (root / "dbt/m0.sql").unlink()
    tracked_files.track_files(spark, str(root), base)
    assert rows_of(spark, base, 2) == [("dbt/deep/old name.sql", False), ("dbt/m0.sql", True), ("dbt/m1.sql", False)]
    assert {k: v for k, v in found(spark, base).items() if k != "dbt/m3.sql"} == {k: v for k, v in wanted(root).items() if k != "dbt/m3.sql"}
    tracked_files.track_files(spark, str(root), base)
    assert rows_of(spark, base, 3) == []


def test_same_as_whole_inventory_and_return_of_a_file(spark, tmp_path):
    root, base = tmp_path / "tree", str(tmp_path / "inventory")
    put(root, "dbt/a.sql", b"a\r\nb")
    put(root, "python/b.py", b"\xff\xfe")
    tracked_files.track_files(spark, str(root), base)
    columns = ["path", "sha256", "md5_base64", "size_bytes", "compare_hash", "is_text"]
    whole = file_inventory(scan_tree(spark, str(root))).select(columns)
    assert sorted(map(tuple, tracked_files.read_tracked(spark, base).select(columns).collect())) == sorted(map(tuple, whole.collect()))
    (root / "dbt/a.sql").unlink()
    tracked_files.track_files(spark, str(root), base)
    assert set(found(spark, base)) == {"python/b.py"}
    put(root, "dbt/a.sql", b"again")
    tracked_files.track_files(spark, str(root), base, glob="*.sql")
    assert found(spark, base) == {"dbt/a.sql": hashlib.sha256(b"again").hexdigest()}


def test_ended_run_and_empty_folder(spark, tmp_path, monkeypatch):
    root, base = tmp_path / "tree", str(tmp_path / "inventory")
    root.mkdir()
    tracked_files.track_files(spark, str(root), base)
    assert found(spark, base) == {}
    put(root, "a.txt", b"1")

    def lost(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as patch:
        patch.setattr(tracked_files, "fingerprint", lost)
        with pytest.raises(RuntimeError, match="lost"):
            tracked_files.track_files(spark, str(root), base)
    assert found(spark, base) == {}
    assert tracked_files.track_files(spark, str(root), base) == 1
    assert found(spark, base) == wanted(root)
