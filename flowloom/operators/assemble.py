"""Payload packets to training flows.

As for wire flows, the packet cap is a group limit that runs before the shuffle,
so the shuffle moves at most 16 cut payloads per flow and input partition, and
window and aggregate share it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import tokens as K
from flowloom.operators.ranks import first_n


def first_packets(packets: DataFrame, max_packets: int = S.MAX_PACKETS_PER_FLOW) -> DataFrame:
    """Packets in slots 0..max-1 by packet id; all other columns break ties."""
    ties = [c for c in packets.columns if c not in (*S.SHARD_KEY, "packet_id")]
    w = Window.partitionBy(*S.SHARD_KEY).orderBy("packet_id", *ties)
    return (packets.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= max_packets)
            .withColumn("slot", F.col("_rn") - 1).drop("_rn"))


def assemble_flows(packets: DataFrame, max_packets: int = S.MAX_PACKETS_PER_FLOW,
                   max_len: int = S.PAYLOAD_MAX_LEN, proto_vocab: int = S.PROTO_VOCAB) -> DataFrame:
    """One row per (source_file, flow_id): packets, header fields and labels.

    Protocol, ports and label come from the first packet.
    """
    length = K.cut_length(F.col("payload_length"), max_len)
    slim = packets.select(
        *S.SHARD_KEY, "packet_id", "source_port", "destination_port", "protocol", "attack_label",
        length.alias("length"), F.substring("payload", F.lit(1), length).alias("payload"))
    first = ("protocol", "source_port", "destination_port", "attack_label")
    flows = first_packets(slim, max_packets).groupBy(*S.SHARD_KEY).agg(
        F.array_sort(F.collect_list(F.struct("slot", "length", "payload"))).alias("packets"),
        F.min_by(F.struct(*first), "slot").alias("_first"),
        F.count(F.lit(1)).cast("int").alias("npkts"))
    meta = F.col("_first")
    proto_id = K.protocol_id(K.protocol_number(meta["protocol"]), proto_vocab)
    cls = K.class_id(meta["attack_label"])
    return flows.select(
        *S.SHARD_KEY, "packets", "npkts", proto_id.alias("proto_id"),
        K.port_bucket(meta["source_port"]).alias("sport_bucket"),
        K.port_bucket(meta["destination_port"]).alias("dport_bucket"),
        K.header_vector(proto_id, meta["source_port"], meta["destination_port"], F.col("npkts")).alias("headers"),
        K.label_binary(cls).alias("label_bin"), cls.alias("label_cls"))


def cap_flows(flows: DataFrame, max_flows: int) -> DataFrame:
    """The first ``max_flows`` flows of each source in flow id order; ranks keys, not payloads."""
    keys = first_n(flows.select(*S.SHARD_KEY), ["source_file"], ["flow_id"], max_flows)
    return flows.join(keys, S.SHARD_KEY, "left_semi")


def cap_rows(table: DataFrame, order: list[str], max_rows: int) -> DataFrame:
    """The first ``max_rows`` rows; ``order`` must be unique."""
    return first_n(table, [], order, max_rows)


def with_tokens(flows: DataFrame, max_packets: int = S.MAX_PACKETS_PER_FLOW,
                max_len: int = S.PAYLOAD_MAX_LEN) -> DataFrame:
    """Late projection: ``tokens``, a dense max_packets x max_len array per flow."""
    real = F.transform("packets", lambda p: K.tokenize(p["payload"], p["length"], max_len))
    empty = F.array_repeat(F.array_repeat(F.lit(S.PAD_ID), max_len), F.lit(max_packets) - F.size("packets"))
    return flows.withColumn("tokens", F.concat(real, empty))


def class_balance(flows: DataFrame) -> DataFrame:
    return flows.groupBy("label_cls").agg(F.count(F.lit(1)).alias("n_flows"))


def attack_rate(flows: DataFrame) -> DataFrame:
    return flows.agg(F.count(F.lit(1)).alias("n_flows"), F.avg("label_bin").alias("attack_rate"))
