"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

``packets_per_s`` is the rate of a whole diagnosis over ``LARGE_PACKETS`` generated packets, a third of them in one
flow, read from parquet: the rate to hold against the published one of about 15,000 packets/s for one process.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from flowloom.plans import diagnose, fixtures  # noqa: E402
from flowloom.plans.catalog import QUERIES  # noqa: E402
from flowloom.session import build_session, scratch_path  # noqa: E402

HEADLINE = [
    "diagnose_captures", "diagnose_flows", "inspect_flows", "aggregate_by_src", "aggregate_by_dst", "plain_scores",
    "assemble_capture_flows", "assemble_flows", "flow_tokens", "flow_table_roundtrip", "ingest_profile",
    "read_payload_packets", "read_captures", "header_fields", "labelled_flows", "tabular_examples", "train_val_split",
    "assign_batches", "class_weights", "pack_bucketed", "pack_ffd", "padding_report", "roc_auc", "average_ranks",
    "score_summary", "evaluate", "flow_features", "train_detector",
]


LARGE_PACKETS = 3_000_000


def packets_per_s(spark) -> float:
    """Packets a second from a stored packet table to reports."""
    n = F.col("id")
    hot = n % 3 == 0
    path = scratch_path(spark, "bench-packets")
    spark.range(LARGE_PACKETS).select(
        F.lit("all").alias("capture"), n.alias("arrival"),
        F.when(hot, "10.0.0.1").otherwise(F.concat(F.lit("10.0."), (n % 200).cast("string"), F.lit("."), (n % 250).cast("string"))).alias("src"),
        F.when(hot, "10.1.0.1").otherwise(F.concat(F.lit("10.1.1."), (n % 20).cast("string"))).alias("dst"),
        F.when(hot, 40000).otherwise(F.lit(30000) + n % 97).cast("int").alias("sport"), F.lit(443).alias("dport"), F.lit(6).alias("proto"),
        F.when(n % 5 == 0, "S").otherwise("PA").alias("flags"), (F.lit(64) - n % 9).cast("int").alias("ttl"),
        F.encode(F.repeat(F.lit("x"), 600), "UTF-8").alias("payload"),
        (n % 97 != 0).alias("ip_checksum_ok"), F.lit(True).alias("l4_checksum_ok")).write.parquet(path)
    packets = spark.read.parquet(path)
    start = time.perf_counter()
    diagnose.diagnose_captures(packets, fixtures.wire_scores(packets)).write.format("noop").mode("overwrite").save()
    return round(LARGE_PACKETS / (time.perf_counter() - start))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "flowloom-bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    names = sys.argv[1:] or HEADLINE
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                      **({} if sys.argv[1:] else {"packets_per_s": packets_per_s(spark)})}))
    spark.stop()


if __name__ == "__main__":
    main()
