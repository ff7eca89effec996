"""Constants, key columns and struct types shared by all modules."""

from __future__ import annotations

from pyspark.sql import types as T

# Token space of one payload byte: fixed values.
PAD_ID = 0
BOS_ID = 1
EOS_ID = 2
BYTE_OFFSET = 3
BYTE_VOCAB = 259

# Flow shape: fixed values.
PAYLOAD_MAX_LEN = 128
MAX_PACKETS_PER_FLOW = 16
HEADER_FIELDS = 5
NUM_PORT_BUCKETS = 4
PROTO_VOCAB = 132

TCP = 6
UDP = 17

# A wire flow is a directed 5-tuple inside one capture.
FLOW_KEY = ["capture", "src", "sport", "dst", "dport", "proto"]
SRC_KEY = ["capture", "src"]
DST_KEY = ["capture", "dst", "dport"]

# A training flow is a flow id inside one source file.
SHARD_KEY = ["source_file", "flow_id"]

WIRE_SCHEMA = T.StructType([
    T.StructField("capture", T.StringType()),
    T.StructField("arrival", T.LongType()),
    T.StructField("src", T.StringType()),
    T.StructField("dst", T.StringType()),
    T.StructField("sport", T.IntegerType()),
    T.StructField("dport", T.IntegerType()),
    T.StructField("proto", T.IntegerType()),
    T.StructField("flags", T.StringType()),
    T.StructField("ttl", T.IntegerType()),
    T.StructField("payload", T.BinaryType()),
    T.StructField("ip_checksum_ok", T.BooleanType()),
    T.StructField("l4_checksum_ok", T.BooleanType()),
])

FINDING = T.StructType([
    T.StructField("code", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("packet_index", T.IntegerType()),
    T.StructField("message", T.StringType()),
    T.StructField("evidence", T.MapType(T.StringType(), T.StringType())),
])

META_COLUMNS = ["flow_id", "packet_id", "source_port", "destination_port",
                "protocol", "payload_length", "attack_label"]
