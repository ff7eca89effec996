"""Reports and envelopes as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000
REPORT_FIELDS = ["flow", "packets", "anomaly_score", "anomaly", "mismatch_findings",
                 "mismatch_detected", "root_cause", "suggested_actions"]


def report_json(reports: DataFrame, keep: list[str | Column] | None = None) -> DataFrame:
    """One JSON text per flow; the columns before it order and group the reports."""
    return reports.select(*(keep or []), "capture", "first_seen", "flow", F.to_json(F.struct(*REPORT_FIELDS)).alias("json"))


def write_reports(reports: DataFrame, path: str) -> None:
    """One folder per capture; captures are dealt out by range first, so each lies in few files."""
    (reports.select("capture", *REPORT_FIELDS).repartitionByRange("capture", "flow")
     .write.option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("capture").json(path))
