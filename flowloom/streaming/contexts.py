"""The cross-flow contexts over event-time windows of a packet or flow stream.

Distinct pairs are counted exactly by two chained aggregates: one row per window and pair, then one per window and
key. A source or target with most of the traffic is spread by its pairs, and state is dropped once the watermark has
passed the window. With ``error`` a sketch takes the place of the first step: one row of state per key and window and
a relative error of that size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom.functions.signatures import bare_syn
from flowloom.operators.verdicts import Limits

SOURCE, SOURCE_PAIR = ["src"], ["dst", "dport"]
TARGET, TARGET_PAIR = ["dst", "dport"], ["src", "sport"]


def exact_contexts(rows: DataFrame, window: list[str], key: list[str], pair: list[str], n_pairs: str) -> DataFrame:
    """Per ``window`` (event-time columns), ``key``: packets, distinct pairs, bare-SYN ratio. ``rows`` has
    ``n_packets`` and ``syn_only_count``; it may be a stream."""
    pairs = rows.groupBy(*window, *key, *pair).agg(F.sum("n_packets").alias("p"), F.sum("syn_only_count").alias("s"))
    whole = pairs.groupBy(*window, *key).agg(F.sum("p").alias("n_packets"), F.count(F.lit(1)).alias(n_pairs),
                                             F.sum("s").alias("s"))
    return whole.withColumn("syn_only_ratio", F.col("s") / F.col("n_packets")).drop("s")


def _windowed(packets: DataFrame, key: list[str], pair: list[str], n_pairs: str, width: str, slide: str | None,
              late: str, error: float | None) -> DataFrame:
    window = F.window("ts", width, slide) if slide else F.window("ts", width)
    syn = F.coalesce(bare_syn(F.col("proto"), F.col("flags")), F.lit(False))
    timed = packets.withWatermark("ts", late)
    if error is None:
        rows = timed.select(window.alias("window"), *key, *pair, F.lit(1).alias("n_packets"), syn.cast("int").alias("syn_only_count"))
        found = exact_contexts(rows, ["window"], key, pair, n_pairs)
    else:
        found = timed.groupBy(window.alias("window"), *key).agg(
            F.count(F.lit(1)).alias("n_packets"),
            F.approx_count_distinct(F.concat_ws("|", *pair), error).alias(n_pairs), F.avg(syn.cast("double")).alias("syn_only_ratio"))
    return found.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *key,
                        "n_packets", n_pairs, "syn_only_ratio")


def source_windows(packets: DataFrame, width: str = "1 minute", slide: str | None = None,
                   late: str = "1 minute", error: float | None = None) -> DataFrame:
    """Per window and source: packets, distinct (dst, dport) pairs, bare-SYN ratio. Needs ``ts``."""
    return _windowed(packets, SOURCE, SOURCE_PAIR, "n_distinct_dst_ports", width, slide, late, error)


def target_windows(packets: DataFrame, width: str = "1 minute", slide: str | None = None,
                   late: str = "1 minute", error: float | None = None) -> DataFrame:
    """Per window and (dst, dport): packets, distinct (src, sport) pairs, bare-SYN ratio."""
    return _windowed(packets, TARGET, TARGET_PAIR, "n_distinct_sources", width, slide, late, error)


def scans(windows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Windows in which a source looks like a port scan."""
    return windows.filter(F.col("n_distinct_dst_ports") >= limits.port_scan_min_ports)


def floods(windows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Windows in which a target looks SYN-flooded."""
    return windows.filter((F.col("n_distinct_sources") >= limits.syn_flood_min_sources)
                          & (F.col("n_packets") >= limits.syn_flood_min_packets)
                          & (F.col("syn_only_ratio") >= limits.syn_flood_min_ratio))
