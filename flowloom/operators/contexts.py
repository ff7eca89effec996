"""Cross-flow contexts: what one source touched, what one target received.

Both read the per-flow summary, not packets. Each first reduces to distinct pairs,
so a source or target with most of the traffic is spread by its pairs, and the
second aggregate combines on the map side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema as S


def _context(flows: DataFrame, key: list[str], pair: list[str], n_pairs: str) -> DataFrame:
    pairs = flows.groupBy(*key, *pair).agg(
        F.sum("n_packets").alias("p"), F.sum("syn_only_count").alias("s"),
        F.count(F.lit(1)).alias("f"))
    return pairs.groupBy(*key).agg(
        F.sum("p").alias("n_packets"), F.count(F.lit(1)).alias(n_pairs),
        (F.sum("s") / F.sum("p")).alias("syn_only_ratio"), F.sum("f").alias("n_flows"))


def aggregate_by_src(flows: DataFrame) -> DataFrame:
    """Per source: packets, distinct (dst, dport) pairs, bare-SYN ratio."""
    return _context(flows, S.SRC_KEY, ["dst", "dport"], "n_distinct_dst_ports")


def aggregate_by_dst(flows: DataFrame) -> DataFrame:
    """Per (dst, dport): packets, distinct (src, sport) pairs, bare-SYN ratio."""
    return _context(flows, S.DST_KEY, ["src", "sport"], "n_distinct_sources")
