"""Wire packets to flows: arrival index, cap, per-flow summary.

The packet table may hold one flow with a third of all rows. Only the first
packets of a flow matter, so the cap is a ``row_number() <= n`` filter: Spark runs
it as a group limit on every input partition before the shuffle, and a flow sends
at most ``n`` rows per input partition whatever its size. The uncapped count is a
separate partial aggregate, because a ``count`` over the same window would switch
that limit off.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import signatures as G

# Tie-break for packets that arrive under the same number.
_TIES = ["flags", "ttl", "payload_len"]


def packet_index(packets: DataFrame, key: list[str] | None = None, order: list[str] | None = None,
                 max_packets: int = S.MAX_PACKETS_PER_FLOW) -> DataFrame:
    """0-based arrival index inside the flow; packets beyond the cap are dropped."""
    key = key or S.FLOW_KEY
    w = Window.partitionBy(*key).orderBy(*(order or ["arrival"]))
    return (packets.withColumn("_rn", F.row_number().over(w))
            .filter(F.col("_rn") <= max_packets)
            .withColumn("packet_index", F.col("_rn") - 1).drop("_rn"))


def packet_counts(packets: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Uncapped packets per flow; reads the key columns only."""
    return packets.groupBy(*(key or S.FLOW_KEY)).agg(F.count(F.lit(1)).alias("packets"))


def slim(packets: DataFrame, registry: dict[int, G.Signature] | None = None,
         rules: list[str] | None = None) -> DataFrame:
    """Replace the payload by what the rules need of it, before any shuffle."""
    from flowloom.operators.rules import rule_bits

    named = packets.withColumn("signature", G.port_signature(F.col("sport"), F.col("dport"), registry))
    return named.select(
        *[c for c in named.columns if c not in ("payload", "ip_checksum_ok", "l4_checksum_ok")],
        F.length("payload").alias("payload_len"), rule_bits(registry, rules).alias("rule_bits"))


def summarize_flows(packets: DataFrame, key: list[str] | None = None,
                    max_packets: int = S.MAX_PACKETS_PER_FLOW,
                    registry: dict[int, G.Signature] | None = None,
                    rules: list[str] | None = None) -> DataFrame:
    """One row per flow over its capped packets: statistics, TTL range, flagged packets.

    One shuffle: window and aggregate share the partitioning by flow.
    """
    key = key or S.FLOW_KEY
    capped = packet_index(slim(packets, registry, rules), key, ["arrival", *_TIES], max_packets)
    flagged = F.struct("packet_index", "rule_bits", "src", "dst", "sport", "dport", "flags",
                       "payload_len", "signature")
    first = F.min_by(F.struct("src", "sport", "dst", "dport", "proto", "arrival"), "packet_index")
    flows = (capped.groupBy(*key).agg(
        first.alias("first"),
        F.count(F.lit(1)).cast("int").alias("n_packets"),
        F.size(F.collect_set("sport")).alias("n_distinct_src_ports"),
        F.size(F.collect_set("dport")).alias("n_distinct_dst_ports"),
        F.count_if(G.bare_syn(F.col("proto"), F.col("flags"))).cast("int").alias("syn_only_count"),
        F.count_if(G.with_ack(F.col("proto"), F.col("flags"))).cast("int").alias("ack_count"),
        F.min("ttl").alias("ttl_min"), F.max("ttl").alias("ttl_max"),
        F.array_sort(F.collect_list(F.when(F.col("rule_bits") != 0, flagged))).alias("flagged")))
    return flows.withColumn("syn_only_ratio", F.col("syn_only_count") / F.col("n_packets"))


def assemble_capture_flows(packets: DataFrame, max_packets: int = S.MAX_PACKETS_PER_FLOW,
                           max_len: int = S.PAYLOAD_MAX_LEN) -> DataFrame:
    """Capture flows with their first payloads and header fields, ready for a detector."""
    from flowloom.functions import tokens as K

    cut = packets.withColumn("payload", K.cut_payload(F.col("payload"), max_len))
    capped = packet_index(cut, order=["arrival", "flags", "ttl", "payload"], max_packets=max_packets)
    flows = capped.groupBy(*S.FLOW_KEY).agg(
        F.min("arrival").alias("first_arrival"),
        F.count(F.lit(1)).cast("int").alias("npkts"),
        F.array_sort(F.collect_list(F.struct(
            F.col("packet_index").alias("slot"), F.length("payload").alias("length"), "payload"))).alias("packets"))
    proto_id = K.protocol_id(F.col("proto"))
    return (flows.withColumn("proto_id", proto_id)
            .withColumn("sport_bucket", K.port_bucket(F.col("sport")))
            .withColumn("dport_bucket", K.port_bucket(F.col("dport")))
            .withColumn("headers", K.header_vector(proto_id, F.col("sport"), F.col("dport"), F.col("npkts"))))
