"""Incremental variants of the ledger ingest and of the daily run summary."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from plumbline.sources.ledger import append_ledger, read_ledger


def _earlier_batches(spark: SparkSession, base: str, batch_id: int) -> DataFrame | None:
    """What batches before this one wrote; None before the first."""
    try:
        written = spark.read.option("basePath", base).parquet(f"{base}/batch=*")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return None
    return written.where(F.col("batch") < batch_id)


def ingest_runs(runs: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Append new run records to the ledger; processes what is there and ends.

    A run is new when no earlier batch wrote its id, however late it arrives;
    of equal ids in one batch the earliest record stands. Each batch writes its
    own folder key, so a batch replayed after a failure overwrites what it
    wrote before. The ids of earlier batches are all that is read of them.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        spark, columns = batch.sparkSession, batch.columns
        row = F.struct("execution_ts", *[c for c in columns if c not in ("execution_id", "execution_ts")])
        fresh = batch.groupBy("execution_id").agg(F.min(row).alias("r")).select("execution_id", "r.*").select(*columns)
        known = _earlier_batches(spark, base, batch_id)
        if known is not None:
            fresh = fresh.join(known.select("execution_id"), "execution_id", "left_anti")
        fresh.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return (
        runs.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


#: State of seen runs lies on the executors' disks, and a batch saves only what it changed.
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def first_arrivals(runs: DataFrame) -> DataFrame:
    """Streaming: the earliest record of each run id, when its id is met for the first time.

    The state of an id is its record and the first and last batch time it came at. Update mode emits the ids of a batch;
    one whose two times are equal is new. There is no watermark, so an id is known for good, and a clock that is set
    back makes no repeat new. Records without an id share one state: the first of them stands.
    """
    others = [c for c in runs.columns if c not in ("execution_id", "execution_ts")]
    dated = runs.withColumn("_at", F.current_timestamp())
    kept = dated.groupBy("execution_id").agg(F.min(F.struct("_at", "execution_ts", *others)).alias("r"), F.max("_at").alias("_last"))
    return kept.where(F.col("r._at") == F.col("_last")).select("execution_id", "r.execution_ts", *[f"r.{c}" for c in others]).select(*runs.columns)


def ingest_with_state(runs: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """As :func:`ingest_runs`, with the seen ids in a state store: a batch reads nothing that earlier batches wrote.

    The number of state partitions is fixed by the first start (``spark.sql.shuffle.partitions``). A batch that is
    replayed has the same times, state and folder, and overwrites what it wrote before.
    """
    spark = runs.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    writer = first_arrivals(runs).writeStream.outputMode("update").foreachBatch(write)
    before = {key: spark.conf.get(key, None) for key in STATE_STORE}
    try:
        for key, value in STATE_STORE.items():
            spark.conf.set(key, value)
        return writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def read_ingested(spark: SparkSession, base: str) -> DataFrame:
    return spark.read.parquet(base).drop("batch")


def publish_ingested(spark: SparkSession, base: str, ledger_base: str) -> None:
    """Append the ingested runs that the ledger does not hold; a second call appends nothing."""
    held = read_ledger(spark, ledger_base, "executions").select("execution_id")
    fresh = read_ingested(spark, base).join(held, "execution_id", "left_anti")
    append_ledger(fresh, ledger_base, "executions")


def daily_counts(runs: DataFrame) -> DataFrame:
    """Streaming counterpart of the daily summary: counts per day and report.

    There is no watermark, so a late run still counts in its day. The state has
    one row per day and report type and does not grow with the runs.
    """
    return runs.groupBy(F.to_date("execution_ts").alias("execution_date"), "report_type").agg(
        F.count_if(F.col("status") == "success").alias("success_count"),
        F.count_if(F.col("status") == "failed").alias("failure_count"),
        F.count(F.lit(1)).alias("total_count"),
    )


def run_daily_summary(runs: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Keep the daily summary up to date; every batch writes the rows it changed."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/batch={batch_id}")

    return (
        daily_counts(runs)
        .writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def read_daily_summary(spark: SparkSession, base: str) -> DataFrame:
    """The newest state of each day and report, with its success rate."""
    changes = spark.read.parquet(base)
    counts = ["success_count", "failure_count", "total_count"]
    newest = changes.groupBy("execution_date", "report_type").agg(F.max_by(F.struct(*counts), "batch").alias("c"))
    return newest.select(
        "execution_date", "report_type", "c.*", F.try_divide("c.success_count", "c.total_count").alias("success_rate")
    )
