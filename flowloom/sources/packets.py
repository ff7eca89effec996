"""Payload-byte packet tables: read, check, profile, resume."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import tokens as K


def payload_columns(max_len: int = S.PAYLOAD_MAX_LEN) -> list[str]:
    return [f"payload_byte_{i}" for i in range(1, max_len + 1)]


def pack_bytes(columns: list[str]) -> Column:
    """One BINARY from one integer column per byte; null is a zero byte."""
    cells = F.array(*[F.coalesce(F.col(c).cast("bigint"), F.lit(0)) for c in columns])
    chars = F.transform(cells, lambda b: F.char(b.bitwiseAND(255)))
    return F.encode(F.array_join(chars, ""), "ISO-8859-1")


def pack_payload(wide: DataFrame, max_len: int = S.PAYLOAD_MAX_LEN, keep: list[str] | None = None) -> DataFrame:
    """Meta columns plus ``payload``, cut to its length; only the first ``max_len`` byte columns are used."""
    length = K.cut_length(F.col("payload_length"), max_len)
    return (wide.withColumn("payload", F.substring(pack_bytes(payload_columns(max_len)), F.lit(1), length))
            .select(*(keep or []), *S.META_COLUMNS, "payload"))


def read_payload_packets(spark: SparkSession, paths: str | list[str],
                         max_len: int = S.PAYLOAD_MAX_LEN) -> DataFrame:
    """Packet rows of one or many parquet files, each with its ``source_file``.

    The scan reads the seven meta columns and the first ``max_len`` byte columns.
    """
    paths = [paths] if isinstance(paths, str) else paths
    wide = spark.read.parquet(*paths).withColumn("source_file", F.col("_metadata.file_path"))
    return pack_payload(wide, max_len, ["source_file"])


def check_sources(expected: DataFrame, packets: DataFrame) -> DataFrame:
    """Rows per expected ``source_file``; ``error`` names a source without rows."""
    counts = packets.groupBy("source_file").agg(F.count(F.lit(1)).alias("n_rows"))
    n = F.coalesce("n_rows", F.lit(0).cast("bigint"))
    return (expected.select("source_file").distinct().join(counts, "source_file", "left")
            .select("source_file", n.alias("n_rows"),
                    F.when(n == 0, F.concat(F.lit("No rows read from "), F.col("source_file"))).alias("error")))


def require_rows(expected: DataFrame, packets: DataFrame) -> DataFrame:
    """``check_sources`` that fails the job on the first empty source."""
    checked = check_sources(expected, packets)
    return checked.withColumn("n_rows", F.when(F.col("error").isNotNull(), F.raise_error(F.col("error")).cast("bigint"))
                              .otherwise(F.col("n_rows"))).drop("error")


def pending_sources(expected: DataFrame, flows: DataFrame) -> DataFrame:
    """Expected sources that have no partition in the written flow table yet."""
    return expected.select("source_file").distinct().join(
        flows.select("source_file").distinct(), "source_file", "left_anti")


def ingest_profile(flows: DataFrame) -> DataFrame:
    """Per source: flows, packets kept, attack rate, bytes. Writes nothing.

    ``flow_bytes`` is the dense size of a flow: 16 x 128 payload bytes, 16 lengths and
    eight 4-byte fields.
    """
    dense = S.MAX_PACKETS_PER_FLOW * (S.PAYLOAD_MAX_LEN + 1) + 4 * (S.HEADER_FIELDS + 3)
    return (flows.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_flows"),
        F.sum("npkts").alias("n_packets"),
        F.avg("npkts").alias("mean_packets"),
        F.avg("label_bin").alias("attack_rate"),
        F.sum(F.aggregate("packets", F.lit(0), lambda a, p: a + p["length"]).cast("bigint")).alias("payload_bytes"),
        *[F.count_if(F.col("label_cls") == i).alias(f"class_{i}") for i in range(10)])
        .withColumn("dense_bytes", F.col("n_flows") * dense))
