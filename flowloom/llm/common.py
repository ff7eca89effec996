"""Small helpers shared by the operators of this package."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.session import apply_settings

# Texts per Arrow batch: bounds what a Python worker holds when texts are long.
BATCH_ROWS = 512
EMIT_BYTES = 8 << 20


def tuned(spark: SparkSession) -> SparkSession:
    """The library's settings and Arrow batches that stay small when texts are long."""
    apply_settings(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return tuned(spark).read.parquet(f"{sf_dir}/{table}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` only, so that other columns can't clash; a null text is empty."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def keep_rows(docs: DataFrame, key: Column, kept: DataFrame) -> DataFrame:
    """One row of ``docs`` for each (key, doc_id) of ``kept``; ``key`` stands for the text, null ids meet null ids."""
    mine, theirs, their_id = (free_name(docs, base) for base in ("_text_key", "_kept_key", "_kept_id"))
    left = docs.withColumn(mine, key)
    right = kept.select(F.col("key").alias(theirs), F.col("doc_id").alias(their_id))
    found = left.join(right, (left[mine] == right[theirs]) & left["doc_id"].eqNullSafe(right[their_id]), "left_semi")
    return found.dropDuplicates([mine, "doc_id"]).drop(mine)


def crc_mod(column: str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")), F.lit(n)).cast("int")


def batches(rows: Iterator[tuple], schema: pa.Schema, weight: int | None = None,
            most_rows: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches, cut by rows and by the bytes of column ``weight``."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        if weight is not None:
            size += len(row[weight])
        if len(held) >= most_rows or size >= EMIT_BYTES:
            yield _batch(held, schema)
            held, size = [], 0
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(column, type=field.type) for column, field in zip(zip(*rows), schema, strict=True)], schema=schema)
