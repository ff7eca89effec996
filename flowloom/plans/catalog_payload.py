"""Queries over payload packets, captures and labelled flow tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions import frames as FR
from flowloom.functions import tokens as K
from flowloom.operators import assemble as A
from flowloom.operators import detector as DT
from flowloom.operators import metrics as M
from flowloom.operators import prepare as B
from flowloom.plans import diagnose as P
from flowloom.plans import fixtures as FX
from flowloom.plans import frames_fixture as FF
from flowloom.plans.ingest import ingest
from flowloom.session import materialize, scratch_path
from flowloom.sources import captures as C
from flowloom.sources import flow_tables as FT
from flowloom.sources import labelled as L
from flowloom.sources import packets as PK

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def _packets(spark: SparkSession, sf: str) -> DataFrame:
    return FX.payload_packets(spark, sf)


def _long(spark: SparkSession, sf: str) -> DataFrame:
    """All packets as one source: flows of up to hundreds of packets."""
    return FX.one_source(_packets(spark, sf))


def _flows(spark: SparkSession, sf: str) -> DataFrame:
    return A.assemble_flows(_packets(spark, sf))


def _join(values: Column) -> Column:
    return F.array_join(values.cast("array<string>"), ",")


def _payload_hash(packets: Column) -> Column:
    return F.md5(F.array_join(F.transform(packets, lambda p: F.hex(p["payload"])), ","))


# --- sources --------------------------------------------------------------------------

def _wide(packets: DataFrame) -> DataFrame:
    """One column per payload byte, as the files have it."""
    cells = [F.conv(F.substring("payload_hex", 2 * i - 1, 2), 16, 10).cast("smallint").alias(f"payload_byte_{i}")
             for i in range(1, S.PAYLOAD_MAX_LEN + 1)]
    spare = F.lit(255).cast("smallint").alias(f"payload_byte_{S.PAYLOAD_MAX_LEN + 1}")
    return packets.select(*S.META_COLUMNS, *cells, spare)


def read_payload_packets(spark, sf):
    """The wide table of one column per byte, written and read back."""
    path = scratch_path(spark, "payload-bytes")
    _wide(_packets(spark, sf)).write.parquet(path)
    return PK.read_payload_packets(spark, path).select(
        "packet_id", "flow_id", "source_port", "destination_port", "protocol",
        c("payload_length").cast("bigint").alias("payload_length"), "attack_label", F.hex("payload").alias("payload_hex"))


def packets_by_source(spark, sf):
    return _packets(spark, sf).groupBy("source_file").agg(
        F.count(F.lit(1)).alias("n_packets"), F.count_distinct("flow_id").alias("n_flows"))


def _expected(spark, sf):
    return FX.table(spark, sf, "nation").select(
        F.concat(F.lit("src"), c("n_nationkey").cast("string")).alias("source_file"))


def empty_sources(spark, sf):
    return PK.check_sources(_expected(spark, sf), _packets(spark, sf))


def flow_table_roundtrip(spark, sf):
    path = scratch_path(spark, "flow-table")
    FT.write_flows(_flows(spark, sf), path)
    return FT.read_flows(spark, path).select(
        "source_file", "flow_id", "npkts", "proto_id", "label_bin", "label_cls", _join(c("headers")).alias("headers"),
        _payload_hash(c("packets")).alias("payload_md5"))


def merge_flows(spark, sf):
    packets = _packets(spark, sf)
    odd = packets.filter(c("packet_id") % 2 == 1).withColumn("source_file", F.lit("odd"))
    even = packets.filter(c("packet_id") % 2 == 0).withColumn("source_file", F.lit("even"))
    return FT.merge_flows([A.assemble_flows(odd), A.assemble_flows(even)]).select("source_file", "flow_id", "npkts")


def pending_sources(spark, sf):
    path = scratch_path(spark, "flow-table")
    packets = _packets(spark, sf)
    FT.write_flows(A.assemble_flows(packets.filter(c("source_file").startswith("src1"))), path)
    return PK.pending_sources(packets, FT.read_flows(spark, path))


def ingest_profile(spark, sf):
    return PK.ingest_profile(_flows(spark, sf)).withColumns({
        "mean_packets": F.round("mean_packets", 6), "attack_rate": F.round("attack_rate", 6)})


def total_flows(spark, sf):
    return FT.total_flows(_flows(spark, sf)).withColumn("source_file", F.coalesce("source_file", F.lit("(all)")))


def decode_captures(spark, sf):
    """Documents as request inputs: raw bytes, base64 text, a field map, broken text, nothing."""
    raw = F.encode("text", "UTF-8")
    b64 = F.regexp_replace(F.base64(raw), "\\s", "")
    kind = c("doc_id") % 5
    requests = FX.table(spark, sf, "documents").select(
        "doc_id",
        F.when(kind == 0, raw).alias("raw"),
        F.when(kind == 1, b64).when(kind == 2, F.concat(F.lit("!!"), c("text"))).alias("b64"),
        F.when(kind == 3, F.create_map(F.when(c("doc_id") % 2 == 0, "pcap_base64").otherwise("pcap"), b64))
        .alias("fields"))
    return C.decode_captures(requests, "raw", "b64", "fields").select(
        "doc_id", F.length("content").alias("n_bytes"), F.md5(F.hex("content")).alias("content_md5"),
        c("error").isNotNull().alias("failed"))


def read_captures(spark, sf):
    packets = C.read_captures(spark, FF.capture_folder(spark, sf), chunk_bytes=1 << 16)
    return packets.select("ts_us", "src", "dst", "sport", "dport", "proto", "flags", "ttl",
                          F.hex("payload").alias("payload_hex"), "ip_checksum_ok", "l4_checksum_ok")


def _file(name: str = "capture") -> Column:
    return F.regexp_extract(name, "f([0-9]+)\\.cap$", 1).cast("bigint").alias("file")


def capture_errors(spark, sf):
    """One row per file that can't be read, with the kind of its error."""
    _, errors = C.read_captures(spark, FF.mixed_capture_folder(spark, sf), on_error="keep")
    return errors.select(_file(), F.when(c("error").contains("block length"), "broken block")
                         .when(c("error").contains("not a capture file"), "not a capture file")
                         .otherwise(c("error")).alias("reason"))


def capture_frame_counts(spark, sf):
    """Frames per readable file: classic, newer, old packet blocks, compressed."""
    index = materialize(C.index_captures(spark, FF.mixed_capture_folder(spark, sf), chunk_bytes=1 << 12), "capture-index")
    return (C.read_frames(index).groupBy("capture").agg(F.count(F.lit(1)).alias("n_frames"),
                                                         F.max("frame_no").alias("last_frame"))
            .select(_file(), "n_frames", "last_frame"))


def ingest_job(spark, sf):
    """Two of three sets of files are new, one was ingested before."""
    rows = _wide(_packets(spark, sf))
    names = []
    for part in range(3):
        path = scratch_path(spark, f"payload-part{part}")
        rows.filter(c("packet_id") % 3 == part).repartitionByRange("flow_id").write.parquet(path)
        names.append(list(spark.read.parquet(path).inputFiles()))
    out = scratch_path(spark, "flow-table")
    ingest(spark, names[0], out)
    done = ingest(spark, [n for part in names for n in part], out)
    flows = FT.read_flows(spark, out).agg(F.lit("flows").alias("status"), F.count(F.lit(1)).alias("n_rows"))
    status = F.when(c("status").startswith("No rows"), "failed").otherwise(c("status"))
    counts = done.groupBy(status.alias("status")).agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"))
    return counts.filter("status <> 'failed'").unionByName(flows)


def ipv4_only(spark, sf):
    return FR.ipv4_only(FF.wire_frames(spark, sf)).select(
        c("frame_no").alias("event_id"), "link_type", F.hex(F.substring("ip", 1, 1)).alias("first_byte"))


def header_fields(spark, sf):
    return FR.header_fields(FF.wire_frames(spark, sf), checksums=False).select(
        c("frame_no").alias("event_id"), "src", "dst", "sport", "dport", "proto", "flags", "ttl",
        F.hex("payload").alias("payload_hex"))


def ip_checksum(spark, sf):
    return FR.header_fields(FF.wire_frames(spark, sf)).select(c("frame_no").alias("event_id"), "ip_checksum_ok")


def l4_checksum(spark, sf):
    return FR.header_fields(FF.wire_frames(spark, sf)).select(c("frame_no").alias("event_id"), "l4_checksum_ok")


# --- column functions -----------------------------------------------------------------

def payload_cut(spark, sf):
    raw = F.encode("text", "UTF-8")
    return FX.table(spark, sf, "documents").select(
        "doc_id", F.hex(K.cut_payload(raw)).alias("payload_hex"), K.cut_length(F.length(raw)).alias("length"))


def label_binary(spark, sf):
    return _packets(spark, sf).select("packet_id", K.label_binary(K.class_id(c("attack_label"))).alias("label_bin"))


def class_id(spark, sf):
    return _packets(spark, sf).select("packet_id", "attack_label", K.class_id(c("attack_label")).alias("label_cls"))


def port_bucket(spark, sf):
    text = F.when(c("doc_id") % 7 == 0, "n/a").otherwise(c("port").cast("string"))
    return FX.table(spark, sf, "documents").withColumn("port", (c("doc_id") * 7919) % 65536 - 100).select(
        "doc_id", K.port_bucket(c("port")).alias("bucket"), K.port_bucket(text).alias("text_bucket"))


def protocol_number(spark, sf):
    return _packets(spark, sf).select("packet_id", K.protocol_number(c("protocol")).alias("number"))


def proto_id(spark, sf):
    return _packets(spark, sf).select("packet_id", K.protocol_id(K.protocol_number(c("protocol"))).alias("proto_id"))


def tokenize(spark, sf):
    return _packets(spark, sf).select("packet_id", _join(K.tokenize(c("payload"), c("payload_length"))).alias("tokens"))


# --- flow assembly --------------------------------------------------------------------

def first_packets(spark, sf):
    return A.first_packets(_long(spark, sf)).select("flow_id", "packet_id", "slot")


def assemble_flows(spark, sf):
    return A.assemble_flows(_long(spark, sf)).select(
        "flow_id", "npkts", _join(F.transform("packets", lambda p: p["length"])).alias("lengths"),
        _payload_hash(c("packets")).alias("payload_md5"))


def flow_metadata(spark, sf):
    return A.assemble_flows(_long(spark, sf)).select(
        "flow_id", "proto_id", "sport_bucket", "dport_bucket", "label_cls", "label_bin")


def header_vector(spark, sf):
    return A.assemble_flows(_long(spark, sf)).select("flow_id", _join(c("headers")).alias("headers"))


def flow_packet_counts(spark, sf):
    packets = _long(spark, sf)
    counts = packets.groupBy("flow_id").agg(F.count(F.lit(1)).alias("n_packets"))
    return counts.withColumn("npkts", F.least("n_packets", F.lit(S.MAX_PACKETS_PER_FLOW)).cast("int"))


def flow_tokens(spark, sf):
    tokens = F.transform("tokens", lambda p: F.aggregate(p, F.lit(0), lambda a, t: a + t))
    return A.with_tokens(A.assemble_flows(_long(spark, sf))).select(
        "flow_id", F.size("tokens").alias("n_slots"), F.size(F.flatten("tokens")).alias("n_tokens"),
        _join(tokens).alias("slot_sums"))


def real_packet_count(spark, sf):
    # Flows whose packets partly carry nothing.
    packets = _long(spark, sf).withColumn("payload_length", F.when(c("packet_id") % 3 == 0, 0).otherwise(c("payload_length")))
    return A.assemble_flows(packets).select("flow_id", "npkts", K.real_packet_count(c("packets")).alias("n_real"))


def class_balance(spark, sf):
    return A.class_balance(A.assemble_flows(_packets(spark, sf)))


def attack_rate(spark, sf):
    return A.attack_rate(_flows(spark, sf)).withColumn("attack_rate", F.round("attack_rate", 6))


def cap_flows(spark, sf):
    return A.cap_flows(_flows(spark, sf), 5).select("source_file", "flow_id")


def cap_rows(spark, sf):
    return A.cap_rows(_packets(spark, sf), ["packet_id"], 100).select("packet_id", "flow_id")


# --- labelled flow tables -------------------------------------------------------------

def _labelled(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as a labelled flow CSV, written and read back as text columns."""
    path = scratch_path(spark, "labelled-csv")
    FX.table(spark, sf, "orders").select(
        c("o_orderkey").alias("id"), c("o_orderpriority").alias("proto"),
        F.when(c("o_orderkey") % 17 == 0, "nan").otherwise((c("o_orderkey") % 23).cast("string")).alias("Spkts"),
        (c("o_custkey") % 5).alias("dpkts"), (c("o_custkey") % 28 == 0).cast("int").alias("label")
    ).write.option("header", True).csv(path)
    return L.read_labelled_csv(spark, path)


def _examples(spark: SparkSession, sf: str) -> DataFrame:
    table = _labelled(spark, sf)
    return L.labelled_flows(table, L.protocol_dictionary(table))


def labelled_flows(spark, sf):
    return _examples(spark, sf).select("id", "proto_id", "sport_bucket", "dport_bucket", "npkts", "label", "fields")


def protocol_dictionary(spark, sf):
    d = L.protocol_dictionary(_labelled(spark, sf))
    return d.withColumn("proto_vocab", L.proto_vocab(d).scalar())


def derived_packets(spark, sf):
    return _labelled(spark, sf).select("id", K.derived_packets(c("Spkts"), c("dpkts")).alias("npkts"))


def proxy_bytes(spark, sf):
    return _examples(spark, sf).select("id", F.hex(K.proxy_bytes([c("fields")], c("npkts") - 1)).alias("last_slot"))


def tabular_examples(spark, sf):
    return L.with_proxy_packets(_examples(spark, sf)).select(
        "id", _join(c("headers")).alias("headers"), F.size("packets").alias("n_slots"),
        _payload_hash(c("packets")).alias("payload_md5"))


def tokenizer_parity(spark, sf):
    """Tokens from the flow table against tokens from captured bytes, at the tested lengths."""
    lengths = F.element_at(F.array(*[F.lit(x) for x in (0, 1, 7, 64, 128)]), (c("packet_id") % 5 + 1).cast("int"))
    packets = _packets(spark, sf).withColumn("flow_id", c("packet_id")).withColumn("payload_length", lengths)
    stored = A.assemble_flows(packets)
    stored = stored.select("flow_id", K.tokenize(c("packets")[0]["payload"], c("packets")[0]["length"]).alias("a"))
    wire = packets.select("flow_id", K.tokenize(
        F.rpad(F.substring("payload", F.lit(1), lengths), lengths, F.unhex(F.lit("00")))).alias("b"))
    return stored.join(wire, "flow_id", "full").agg(
        F.count(F.lit(1)).alias("n_flows"), F.count_if(~c("a").eqNullSafe(c("b"))).alias("n_unequal"))


def proxy_locality(spark, sf):
    """Rows that differ in one digit of one field: how alike are their proxies?"""
    rows = FX.table(spark, sf, "orders").select("o_orderkey")
    pair = [F.transform(K.byte_values(K.proxy_bytes([c("o_orderkey"), F.lit(d)], F.lit(0))), lambda b: b.cast("double"))
            for d in ("0.100", "0.101")]
    bytes_ = rows.select(F.explode(F.arrays_zip(pair[0].alias("a"), pair[1].alias("b"))).alias("p")).select("p.*")
    return bytes_.agg(F.count(F.lit(1)).alias("n_bytes"), F.count_if(c("a") == c("b")).alias("n_equal"),
                      F.round(F.corr("a", "b"), 6).alias("correlation"))


# --- detector -------------------------------------------------------------------------

def flow_features(spark, sf):
    return DT.token_counts(A.assemble_flows(_long(spark, sf)), ["flow_id"])


def _split_flows(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    flows = materialize(_flows(spark, sf), "flows")
    split = materialize(B.train_val_split(flows, S.SHARD_KEY), "split")
    return split.filter("is_train"), split.filter("NOT is_train")


def train_detector(spark, sf):
    train, val = _split_flows(spark, sf)
    weights = B.class_weights(train, "label_bin", 2)
    model = DT.train_detector(train, weights=weights)
    return M.evaluate(DT.predict_logits(model, val), 2)


def score_flows(spark, sf):
    train, val = _split_flows(spark, sf)
    return DT.score_flows(DT.train_detector(train), val, S.SHARD_KEY)


def score_captures(spark, sf):
    """A detector trained on payload flows, at work on captured packets: scores and reports."""
    train, _ = _split_flows(spark, sf)
    packets = FX.wire_packets(spark, sf)
    scores = DT.score_captures(DT.train_detector(train), packets)
    return P.diagnose_captures(packets, scores).select(
        "flow", "anomaly_score", "anomaly", c("root_cause")["tag"].alias("tag"))


def train_class_detector(spark, sf):
    train, val = _split_flows(spark, sf)
    model = DT.train_detector(train, "class", B.class_weights(train, "label_cls", 10))
    return M.evaluate(DT.predict_logits(model, val, "class"), 10, "class")


def score_with(spark, sf):
    """A caller's scorer: share of printable bytes in the first packet."""
    import pandas as pd

    def printable(batch: pd.DataFrame) -> pd.Series:
        return batch["head"].map(lambda b: sum(32 <= x < 127 for x in b) / max(1, len(b)))

    flows = A.assemble_flows(_long(spark, sf)).select("flow_id", c("packets")[0]["payload"].alias("head"))
    return DT.score_with(flows, ["flow_id"], printable).withColumn("score", F.round("score", 6))


def ceiling_probe(spark, sf):
    rows = FX.table(spark, sf, "orders").select(
        "o_orderkey", (c("o_custkey") % 28 == 0).cast("int").alias("label"),
        (c("o_custkey") % 28).alias("cust_mod"), c("o_totalprice").alias("price"),
        F.least(c("o_orderkey") % 23 + c("o_custkey") % 5, F.lit(16)).alias("npkts"),
        F.ascii("o_orderpriority").alias("proto"))
    split = B.train_val_split(rows, ["o_orderkey"])
    return DT.ceiling_probe(split.filter("is_train"), split.filter("NOT is_train"),
                            ["cust_mod", "price", "npkts", "proto"], ["npkts", "proto"])


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    read_payload_packets, packets_by_source, empty_sources, flow_table_roundtrip, merge_flows, pending_sources,
    ingest_profile, total_flows, decode_captures, read_captures, capture_errors, capture_frame_counts, ingest_job, ipv4_only, header_fields, ip_checksum, l4_checksum,
    payload_cut, label_binary, class_id, port_bucket, protocol_number, proto_id, tokenize, first_packets,
    assemble_flows, flow_metadata, header_vector, flow_packet_counts, flow_tokens, real_packet_count, class_balance,
    attack_rate, cap_flows, cap_rows, labelled_flows, protocol_dictionary, derived_packets, proxy_bytes,
    tabular_examples, tokenizer_parity, proxy_locality, flow_features, train_detector, train_class_detector,
    score_flows, score_captures, score_with, ceiling_probe)}
