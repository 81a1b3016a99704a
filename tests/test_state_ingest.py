from datetime import datetime

from plumbline.streaming import ledger_stream
from tests.conftest import rows

SCHEMA = "execution_id string, execution_ts timestamp, status string"


def test_batches_read_no_earlier_output(spark, table, tmp_path):
    """Each start writes to a folder of its own, so only the state can tell repeats."""
    source, state = str(tmp_path / "in"), str(tmp_path / "state")

    def send(number, *records):
        table(SCHEMA, *[(i, datetime(2024, 1, day), s) for i, day, s in records]).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        query = ledger_stream.ingest_with_state(stream, str(tmp_path / f"out{number}"), state)
        query.awaitTermination()
        progress = query.lastProgress
        written = spark.read.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / f"out{number}"))
        return rows(written.select("execution_id", "status")), progress

    first, _ = send(0, ("a", 9, "late"), ("a", 8, "early"), ("b", 9, "ok"))
    assert first == [("a", "early"), ("b", "ok")]
    second, progress = send(1, ("a", 1, "again"), ("c", 1, "old"), ("b", 9, "ok"), (None, 3, "nameless"))
    assert second == [("c", "old"), (None, "nameless")]
    assert progress["numInputRows"] == 4
    assert "RocksDB" in str(progress["stateOperators"][0]["customMetrics"]) or "rocksdb" in str(progress["stateOperators"][0]["customMetrics"])
    third, progress = send(2, ("c", 2, "again"), (None, 4, "nameless"), ("d", 5, "new"))
    assert third == [("d", "new")]
    assert progress["stateOperators"][0]["numRowsTotal"] == 5
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass", "").endswith("RocksDBStateStoreProvider") is False


def test_same_rows_as_the_plain_ingest(spark, table, tmp_path):
    source = str(tmp_path / "in")
    records = [(f"r{i % 7}", datetime(2024, 1, 1 + i % 5), f"s{i}") for i in range(40)]
    table(SCHEMA, *records).write.parquet(source)
    stream = lambda: spark.readStream.schema(SCHEMA).parquet(source)
    ledger_stream.ingest_runs(stream(), str(tmp_path / "plain"), str(tmp_path / "s1")).awaitTermination()
    ledger_stream.ingest_with_state(stream(), str(tmp_path / "kept"), str(tmp_path / "s2")).awaitTermination()
    plain, kept = (rows(ledger_stream.read_ingested(spark, str(tmp_path / name))) for name in ("plain", "kept"))
    assert plain == kept and len(kept) == 7
