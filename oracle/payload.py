"""Expected results over payload packets, frames and labelled tables."""

from __future__ import annotations

from flowloom.dimensions import ATTACK_CLASSES, PROTOCOL_NUMBERS
from flowloom.plans import fixtures as FX
from oracle.wire import WIRE, fill, q

CLASSES = "[" + ", ".join(q(n) for n in ATTACK_CLASSES) + "]"
PROTOS = "protos(name, number) AS (VALUES " + ", ".join(f"({q(n)}, {v})" for n, v in PROTOCOL_NUMBERS.items()) + ")"

CLS = f"""CASE WHEN trim(lower(attack_label)) IN ('', 'nan', 'none', '-') THEN 0
    WHEN list_position({CLASSES}, trim(lower(attack_label))) > 0 THEN list_position({CLASSES}, trim(lower(attack_label))) - 1
    WHEN starts_with(trim(lower(attack_label)), 'normal') THEN 0 ELSE 1 END"""
NUMBER = """coalesce(TRY_CAST(trim(protocol) AS BIGINT),
    (SELECT CAST(number AS BIGINT) FROM protos WHERE name = trim(lower(protocol))),
    256 + CAST('0x' || substr(md5(trim(lower(protocol))), 1, 2) AS BIGINT))"""


def bucket(port: str) -> str:
    return f"CASE WHEN {port} IS NULL OR {port} < 0 THEN 0 WHEN {port} < 1024 THEN 1 WHEN {port} < 49152 THEN 2 ELSE 3 END"


PACKETS = f"""
{PROTOS},
pk AS (SELECT *, CAST(least(payload_length, 128) AS INT) AS len, upper(substr(payload_hex, 1, 2 * CAST(least(payload_length, 128) AS INT))) AS cut,
    CAST({CLS} AS INT) AS cls, {NUMBER} AS number FROM ({fill(FX.PAYLOAD_PACKETS)}))"""


def flows(source: str, packets: str = "pk", length: str = "len", cut: str = "cut") -> str:
    """``kept`` packets and ``flow`` rows grouped by source expression and flow id."""
    return f"""
kept AS (SELECT * FROM (SELECT * EXCLUDE (source_file), {source} AS source_file, {length} AS klen, {cut} AS kcut,
    CAST(row_number() OVER (PARTITION BY {source}, flow_id ORDER BY packet_id) - 1 AS INT) AS slot,
    count(*) OVER (PARTITION BY {source}, flow_id) AS total FROM {packets}) WHERE slot < 16),
flow AS (SELECT source_file, flow_id, CAST(count(*) AS INT) AS npkts, any_value(total) AS total,
    string_agg(CAST(klen AS VARCHAR), ',' ORDER BY slot) AS lengths, md5(string_agg(kcut, ',' ORDER BY slot)) AS payload_md5,
    sum(klen) AS n_bytes, CAST(greatest(1, count(*) FILTER (WHERE klen > 0)) AS INT) AS n_real,
    CAST(arg_min(number, slot) % 132 AS INT) AS proto_id, CAST(arg_min({bucket('source_port')}, slot) AS INT) AS sport_bucket,
    CAST(arg_min({bucket('destination_port')}, slot) AS INT) AS dport_bucket, arg_min(cls, slot) AS label_cls,
    CAST(arg_min(cls, slot) <> 0 AS INT) AS label_bin FROM kept GROUP BY source_file, flow_id)"""


ONE = flows("'all'")
BY_SOURCE = flows("source_file")
HEADERS = "concat(proto_id, ',', sport_bucket, ',', dport_bucket, ',', npkts, ',0') AS headers"


def byte_list(hex_text: str, n: str) -> str:
    return f"list_transform(range(0, CAST({n} AS BIGINT)), lambda i: CAST('0x' || substr({hex_text}, 2 * i + 1, 2) AS INT))"


TOKENS = """list_transform(range(0, 128), lambda i: CASE WHEN i < len THEN
    3 + CAST('0x' || substr(cut, 2 * i + 1, 2) AS INT) ELSE 0 END)"""


def sha_blocks(prefix: str) -> str:
    return "upper(concat(" + ", ".join(f"sha256(concat({prefix}, '|{b}'))" for b in range(4)) + "))"


LABELLED = """
lab AS (SELECT o_orderkey AS id, o_orderpriority AS proto,
    CASE WHEN o_orderkey % 17 = 0 THEN 'nan' ELSE CAST(o_orderkey % 23 AS VARCHAR) END AS spkts, o_custkey % 5 AS dpkts,
    CAST(o_custkey % 28 = 0 AS INT) AS label FROM orders),
dict AS (SELECT proto, CAST(row_number() OVER (ORDER BY proto) - 1 AS INT) AS proto_id, count(*) AS n_rows FROM lab GROUP BY proto),
ex AS (SELECT CAST(id AS VARCHAR) AS id, proto_id, CAST(greatest(1, least(16, (CASE WHEN spkts = 'nan' THEN 0 ELSE id % 23 END) + dpkts)) AS INT) AS npkts,
    label, concat(id, '|', proto, '|', spkts, '|', dpkts) AS fields FROM lab JOIN dict USING (proto))"""

FRAME_FLAGS = "CASE flags WHEN 'RS' THEN 'SR' WHEN 'PA' THEN 'PA' WHEN 'FA' THEN 'FA' ELSE flags END"
FRAME_COLUMNS = f"src, dst, sport0 AS sport, dport0 AS dport, proto, {FRAME_FLAGS} AS flags, ttl, upper(payload_hex) AS payload_hex"
# Ports are a transport field: protocol 1 has none. Every 53rd frame is IPv6.
FRAMES = f"""{WIRE}, fr AS (SELECT *, CASE WHEN proto = 1 THEN 0 ELSE sport END AS sport0,
    CASE WHEN proto = 1 THEN 0 ELSE dport END AS dport0, l4_checksum_ok OR proto = 1 AS l4_ok
    FROM wire WHERE event_id % 53 <> 0)"""

ORACLES = {
    "read_payload_packets": f"""WITH {PACKETS} SELECT packet_id, flow_id, source_port, destination_port, protocol, payload_length,
        attack_label, cut AS payload_hex FROM pk""",
    "packets_by_source": f"WITH {PACKETS} SELECT source_file, count(*) AS n_packets, count(DISTINCT flow_id) AS n_flows FROM pk GROUP BY source_file",
    "empty_sources": f"""WITH {PACKETS}, n AS (SELECT source_file, count(*) AS n FROM pk GROUP BY source_file)
        SELECT concat('src', n_nationkey) AS source_file, coalesce(n, 0) AS n_rows,
        CASE WHEN n IS NULL THEN concat('No rows read from src', n_nationkey) END AS error
        FROM nation LEFT JOIN n ON n.source_file = concat('src', n_nationkey)""",
    "flow_table_roundtrip": f"WITH {PACKETS}, {BY_SOURCE} SELECT source_file, flow_id, npkts, proto_id, label_bin, label_cls, {HEADERS}, payload_md5 FROM flow",
    "merge_flows": f"""WITH {PACKETS}, {flows("CASE packet_id % 2 WHEN 1 THEN 'odd' ELSE 'even' END")} SELECT source_file, flow_id, npkts FROM flow""",
    "pending_sources": "SELECT DISTINCT source AS source_file FROM documents WHERE source NOT LIKE 'src1%'",
    "ingest_profile": f"""WITH {PACKETS}, {BY_SOURCE} SELECT source_file, count(*) AS n_flows, CAST(sum(npkts) AS BIGINT) AS n_packets,
        round(avg(npkts), 6) AS mean_packets, round(avg(label_bin), 6) AS attack_rate, CAST(sum(n_bytes) AS BIGINT) AS payload_bytes,
        {", ".join(f"count(*) FILTER (WHERE label_cls = {i}) AS class_{i}" for i in range(10))},
        count(*) * (16 * 129 + 32) AS dense_bytes FROM flow GROUP BY source_file""",
    "total_flows": f"""WITH {PACKETS}, {BY_SOURCE} SELECT source_file, count(*) AS n_flows FROM flow GROUP BY source_file
        UNION ALL SELECT '(all)', count(*) FROM flow""",
    "decode_captures": """SELECT doc_id, CASE WHEN doc_id % 5 IN (0, 1, 3) THEN CAST(octet_length(encode(text)) AS INT) END AS n_bytes,
        CASE WHEN doc_id % 5 IN (0, 1, 3) THEN md5(hex(encode(text))) END AS content_md5, doc_id % 5 IN (2, 4) AS failed FROM documents""",
    "read_captures": f"WITH {FRAMES} SELECT 1700000000000000 + event_id AS ts_us, {FRAME_COLUMNS}, ip_checksum_ok, l4_ok AS l4_checksum_ok FROM fr",
    "capture_errors": """SELECT DISTINCT event_id // 200 AS file, CASE WHEN (event_id // 200) % 6 = 4 THEN 'broken block'
        ELSE 'not a capture file' END AS reason FROM events WHERE (event_id // 200) % 6 >= 4""",
    "capture_frame_counts": """SELECT event_id // 200 AS file, count(*) AS n_frames, count(*) - 1 AS last_frame FROM events
        WHERE (event_id // 200) % 6 < 4 GROUP BY event_id // 200""",
    "ingest_job": f"""WITH {PACKETS} SELECT 'done before' AS status, CAST(0 AS BIGINT) AS n_rows
        UNION ALL SELECT 'written', count(*) FROM pk WHERE packet_id % 3 > 0
        UNION ALL SELECT 'flows', count(*) FROM (SELECT DISTINCT packet_id % 3, flow_id FROM pk)""",
    "ipv4_only": f"""WITH {WIRE} SELECT event_id, CAST(CASE event_id % 4 WHEN 0 THEN 228 WHEN 1 THEN 101 ELSE 1 END AS INT) AS link_type,
        '45' AS first_byte FROM wire WHERE event_id % 53 <> 0""",
    "header_fields": f"WITH {FRAMES} SELECT event_id, {FRAME_COLUMNS} FROM fr",
    "ip_checksum": f"WITH {FRAMES} SELECT event_id, ip_checksum_ok FROM fr",
    "l4_checksum": f"WITH {FRAMES} SELECT event_id, l4_ok AS l4_checksum_ok FROM fr",
    "payload_cut": "SELECT doc_id, substr(hex(encode(text)), 1, 256) AS payload_hex, CAST(least(octet_length(encode(text)), 128) AS INT) AS length FROM documents",
    "label_binary": f"WITH {PACKETS} SELECT packet_id, CAST(cls <> 0 AS INT) AS label_bin FROM pk",
    "class_id": f"WITH {PACKETS} SELECT packet_id, attack_label, cls AS label_cls FROM pk",
    "port_bucket": f"""WITH p AS (SELECT doc_id, (doc_id * 7919) % 65536 - 100 AS port FROM documents)
        SELECT doc_id, CAST({bucket('port')} AS INT) AS bucket,
        CAST(CASE WHEN doc_id % 7 = 0 THEN 0 ELSE {bucket('port')} END AS INT) AS text_bucket FROM p""",
    "protocol_number": f"WITH {PACKETS} SELECT packet_id, number FROM pk",
    "proto_id": f"WITH {PACKETS} SELECT packet_id, CAST(number % 132 AS INT) AS proto_id FROM pk",
    "tokenize": f"WITH {PACKETS} SELECT packet_id, array_to_string({TOKENS}, ',') AS tokens FROM pk",
    "first_packets": f"WITH {PACKETS}, {ONE} SELECT flow_id, packet_id, slot FROM kept",
    "assemble_flows": f"WITH {PACKETS}, {ONE} SELECT flow_id, npkts, lengths, payload_md5 FROM flow",
    "flow_metadata": f"WITH {PACKETS}, {ONE} SELECT flow_id, proto_id, sport_bucket, dport_bucket, label_cls, label_bin FROM flow",
    "header_vector": f"WITH {PACKETS}, {ONE} SELECT flow_id, {HEADERS} FROM flow",
    "flow_packet_counts": f"WITH {PACKETS}, {ONE} SELECT flow_id, total AS n_packets, npkts FROM flow",
    "flow_tokens": f"""WITH {PACKETS}, {ONE}, s AS (SELECT flow_id, slot, CAST(list_sum({TOKENS}) AS BIGINT) AS t FROM kept),
        g AS (SELECT flow_id, unnest(range(0, 16)) AS slot FROM flow)
        SELECT flow_id, CAST(16 AS INT) AS n_slots, CAST(2048 AS INT) AS n_tokens,
        string_agg(CAST(coalesce(t, 0) AS VARCHAR), ',' ORDER BY slot) AS slot_sums
        FROM g LEFT JOIN s USING (flow_id, slot) GROUP BY flow_id""",
    "real_packet_count": f"""WITH {PACKETS}, {flows("'all'", "pk", "CASE WHEN packet_id % 3 = 0 THEN 0 ELSE len END", "cut")}
        SELECT flow_id, npkts, n_real FROM flow""",
    "class_balance": f"WITH {PACKETS}, {BY_SOURCE} SELECT label_cls, count(*) AS n_flows FROM flow GROUP BY label_cls",
    "attack_rate": f"WITH {PACKETS}, {BY_SOURCE} SELECT count(*) AS n_flows, round(avg(label_bin), 6) AS attack_rate FROM flow",
    "cap_flows": f"""WITH {PACKETS}, {BY_SOURCE} SELECT source_file, flow_id FROM
        (SELECT *, row_number() OVER (PARTITION BY source_file ORDER BY flow_id) AS r FROM flow) WHERE r <= 5""",
    "cap_rows": f"WITH {PACKETS} SELECT packet_id, flow_id FROM pk ORDER BY packet_id LIMIT 100",
    "labelled_flows": f"""WITH {LABELLED} SELECT id, proto_id, CAST(1 AS INT) AS sport_bucket, CAST(1 AS INT) AS dport_bucket, npkts,
        label, fields FROM ex""",
    "protocol_dictionary": f"""WITH {LABELLED} SELECT proto, proto_id, n_rows,
        greatest(2, (SELECT count(*) FROM dict) + 1) AS proto_vocab FROM dict""",
    "derived_packets": f"WITH {LABELLED} SELECT id, npkts FROM ex",
    "proxy_bytes": f"WITH {LABELLED} SELECT id, {sha_blocks("fields, '|', npkts - 1")} AS last_slot FROM ex",
    "tabular_examples": f"""WITH {LABELLED}, s AS (SELECT *, unnest(range(0, npkts)) AS slot FROM ex),
        h AS (SELECT id, md5(string_agg({sha_blocks("fields, '|', slot")}, ',' ORDER BY slot)) AS payload_md5 FROM s GROUP BY id)
        SELECT id, concat(proto_id, ',1,1,', npkts, ',0') AS headers, npkts AS n_slots, payload_md5 FROM ex JOIN h USING (id)""",
    "tokenizer_parity": "SELECT count(*) AS n_flows, CAST(0 AS BIGINT) AS n_unequal FROM documents",
    "proxy_locality": f"""WITH h AS (SELECT {sha_blocks("o_orderkey, '|0.100|0'")} AS a, {sha_blocks("o_orderkey, '|0.101|0'")} AS b FROM orders),
        p AS (SELECT unnest({byte_list('a', '128')}) AS a, unnest({byte_list('b', '128')}) AS b FROM h)
        SELECT count(*) AS n_bytes, count(*) FILTER (WHERE a = b) AS n_equal, round(corr(a, b), 6) AS correlation FROM p""",
    "flow_features": f"""WITH {PACKETS}, {ONE}, t AS (SELECT flow_id, unnest({byte_list('kcut', 'klen')}) + 3 AS token FROM kept)
        SELECT flow_id, token, count(*) AS n FROM t GROUP BY flow_id, token""",
    "score_with": f"""WITH {PACKETS}, {ONE}, t AS (SELECT flow_id, unnest({byte_list('kcut', 'klen')}) AS b FROM kept WHERE slot = 0)
        SELECT flow_id, round(avg(CASE WHEN b BETWEEN 32 AND 126 THEN 1.0 ELSE 0.0 END), 6) AS score FROM t GROUP BY flow_id""",
}
