"""Running a stream over what is there, into a table of the checkpoint folder."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from wayfold.session import ensure_checkpoint

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The Parquet file or folder at path as a stream with its schema; the pattern lets a single file be a source."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{path[:-1]}[{path[-1]}]")


def drained(stream: DataFrame, label: str) -> DataFrame:
    """The rows that the stream appends for all input present now; exactly once, restartable from its checkpoint. Raises if it fails."""
    spark = stream.sparkSession
    ensure_checkpoint(spark)
    setting = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, ROCKSDB)
    where = f"{spark.sparkContext.getCheckpointDir()}/wayfold/{label}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("path", f"{where}/rows").option("checkpointLocation", f"{where}/state").outputMode("append").trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        spark.conf.set(setting, before)
    return spark.read.schema(stream.schema).parquet(f"{where}/rows")
