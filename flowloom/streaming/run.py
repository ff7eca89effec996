"""Running streams to the end of their input, and tables replayed as streams."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import scratch_path

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def state_settings(spark: SparkSession, partitions: int | None = None) -> Iterator[None]:
    """Settings that a stream takes over when it starts: a state store on disk that uploads its changes only, and the number of state
    partitions, which can't be changed later (default: the cores)."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB,
              "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
              "spark.sql.shuffle.partitions": str(partitions or spark.sparkContext.defaultParallelism)}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_to_end(stream: DataFrame, label: str, partitions: int | None = None, path: str | None = None,
               checkpoint: str | None = None) -> str:
    """Process what is there in micro-batches into a parquet folder with a commit log; returns the folder."""
    spark = stream.sparkSession
    path = path or scratch_path(spark, label)
    with state_settings(spark, partitions):
        query = (stream.writeStream.format("parquet").outputMode("append").option("path", path)
                 .option("checkpointLocation", checkpoint or scratch_path(spark, f"{label}-state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return path


def write_in_turn(rows: DataFrame, turn: Column, turns: int, label: str, parts: int = 4) -> str:
    """The rows as files that appear turn by turn, as a recorder would leave them; returns the folder."""
    path = scratch_path(rows.sparkSession, label)
    for i in range(turns):
        rows.filter(turn == i).repartition(parts).write.mode("append").parquet(path)
    return path


def read_in_turn(spark: SparkSession, path: str, schema, files: int = 4) -> DataFrame:
    """The folder as a stream, ``files`` files a micro-batch, oldest first."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)
