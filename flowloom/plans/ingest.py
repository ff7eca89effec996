"""Payload files to the flow table, resumable per file."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.operators.assemble import assemble_flows
from flowloom.session import materialize
from flowloom.sources.flow_tables import has_flows, read_flows, write_flows
from flowloom.sources.packets import check_sources, pending_sources, read_payload_packets


def source_name(path: str) -> str:
    """A path as ``_metadata.file_path`` has it."""
    return re.sub("^file:/+", "file:/", path if "://" in path or path.startswith("file:") else f"file:{path}")


def ingest(spark: SparkSession, paths: list[str], out: str) -> DataFrame:
    """Assemble the files that ``out`` has no flows of yet, and write them; one row per file: source_file, n_rows,
    status (``done before``, ``written`` or the reason it failed).

    A source is a file's path as Spark names it. A file without rows fails and the others are written. Run again
    after a loss, only files without flows are read.
    """
    # The list of files is the caller's argument, not data.
    named = {source_name(p): p for p in paths}
    listed = spark.createDataFrame([(n,) for n in named], "source_file STRING")
    pending = listed if not has_flows(spark, out) else pending_sources(listed, read_flows(spark, out))
    todo = [r["source_file"] for r in pending.collect()]
    before = listed.join(pending, "source_file", "left_anti").select(
        "source_file", F.lit(None).cast("bigint").alias("n_rows"), F.lit("done before").alias("status"))
    if not todo:
        return before
    packets = read_payload_packets(spark, [named[n] for n in todo])
    # Counts read no payload column; the check is stored, since the write below must not change what it saw.
    checked = materialize(check_sources(pending, packets.select("source_file")), "ingest-check")
    write_flows(assemble_flows(packets), out)
    return before.unionByName(checked.select(
        "source_file", "n_rows", F.coalesce("error", F.lit("written")).alias("status")))
