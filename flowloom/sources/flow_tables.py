"""The flow table: write, read, merge, count."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

ROWS_PER_FILE = 1_000_000


def write_flows(flows: DataFrame, path: str) -> None:
    """One folder per source. Rerunning a source replaces its folder only.

    Sources are dealt out by range first, so that a source lies in few files however many tasks made its flows, and
    a large one in several of bounded length.
    """
    (flows.repartitionByRange("source_file", "flow_id").write.option("maxRecordsPerFile", ROWS_PER_FILE).mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("source_file").parquet(path))


def has_flows(spark: SparkSession, path: str) -> bool:
    """Whether anything has been written to ``path``."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def read_flows(spark: SparkSession, path: str, sources: list[str] | None = None) -> DataFrame:
    """Read a flow table; naming ``sources`` prunes to their folders."""
    found = spark.read.option("mergeSchema", "false").parquet(path).schema
    # Read as text: inference would make one number of the sources 01, 1 and 1.0.
    typed = StructType([StructField(f.name, StringType() if f.name == "source_file" else f.dataType) for f in found])
    flows = spark.read.schema(typed).parquet(path)
    return flows if sources is None else flows.filter(F.col("source_file").isin(sources))


def merge_flows(tables: list[DataFrame]) -> DataFrame:
    """Bag union; the same flow id under two sources stays two flows."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def total_flows(flows: DataFrame) -> DataFrame:
    """Flows per source and, with a null source, over all."""
    return (flows.rollup("source_file").agg(F.count(F.lit(1)).alias("n_flows")))
