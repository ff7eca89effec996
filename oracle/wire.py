"""Expected results over wire packets, written directly in SQL."""

from __future__ import annotations

from flowloom.dimensions import ACTIONS, CAUSE_LABELS, RULES, SEVERITY_RANK
from flowloom.plans import fixtures as FX


def fill(text: str) -> str:
    out = text.replace("{enc}", "encode(text)").replace("{list}", "list_value").replace("{item}", "list_extract")
    for t in ("documents", "labels", "events", "lineitem", "orders", "embeddings"):
        out = out.replace("{" + t + "}", t)
    return out


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


KEY = "src, sport, dst, dport, proto"
FLOW = "concat(src, ':', sport, ' -> ', dst, ':', dport, ' (proto ', proto, ')')"


def _sig(port: str) -> str:
    return f"CASE {port} WHEN 80 THEN 'http' WHEN 8080 THEN 'http' WHEN 443 THEN 'tls' WHEN 22 THEN 'ssh' WHEN 53 THEN 'dns' END"


HTTP = "(" + " OR ".join(f"starts_with(payload_hex, '{p.encode().hex().upper()}')" for p in
                         ("GET ", "POST ", "PUT ", "HEAD ", "DELETE ", "OPTIONS ", "HTTP/1.")) + ")"
TLS = "(length(payload_hex) >= 6 AND substr(payload_hex, 1, 2) IN ('14','15','16','17') AND substr(payload_hex, 3, 2) = '03')"
SSH = "starts_with(payload_hex, '5353482D')"
DNS = ("CASE WHEN length(payload_hex) >= 24 THEN CAST('0x' || substr(payload_hex, 9, 4) AS INT) <= 16 "
       "AND CAST('0x' || substr(payload_hex, 13, 4) AS INT) <= 64 ELSE false END")
BARE = "(proto = 6 AND flags = 'S')"

WIRE = f"""
wire AS (SELECT *, {FLOW} AS flow, CAST(length(payload_hex) / 2 AS INT) AS plen,
    coalesce({_sig('dport')}, {_sig('sport')}) AS sig FROM ({fill(FX.WIRE_PACKETS)})),
capped AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY flow ORDER BY event_id) - 1 AS INT) AS idx
    FROM wire) WHERE idx < 16),
score AS (SELECT flow, any_value(src) AS src, any_value(dst) AS dst, any_value(dport) AS dport,
    min(event_id) AS first_seen, count(*) AS packets,
    CAST((min(event_id) * 7919) % 20000 AS DOUBLE) / 20000 AS score FROM wire GROUP BY flow)"""


FROM_TABLE = f"({fill(FX.WIRE_PACKETS)})"
# As read from capture files: every 53rd frame is IPv6, and protocol 1 has neither ports nor a transport checksum.
FROM_FILES = f"""(SELECT * REPLACE (CASE WHEN proto = 1 THEN 0 ELSE sport END AS sport, CASE WHEN proto = 1 THEN 0 ELSE dport END AS dport,
    l4_checksum_ok OR proto = 1 AS l4_checksum_ok, CASE flags WHEN 'RS' THEN 'SR' ELSE flags END AS flags)
    FROM {FROM_TABLE} WHERE event_id % 53 <> 0)"""


def findings(key: str, capped: str, name: str) -> str:
    """Finding rows per ``key``: rule number, index, code, message, evidence."""
    port = "CASE WHEN dport <> 0 THEN dport ELSE sport END"
    rules = [
        ("ip_checksum_mismatch", "NOT ip_checksum_ok",
         "concat('IP header checksum does not match the recomputed value for packet ', idx, ' (', src, ' -> ', dst, '); packet is corrupted, was tampered with in transit, or was crafted.')",
         "concat('dst=', dst, ';src=', src)"),
        ("l4_checksum_mismatch", "NOT l4_checksum_ok",
         "concat('Transport-layer (TCP/UDP) checksum mismatch on packet ', idx, '; segment content does not match what its own header claims.')",
         "concat('dport=', dport, ';sport=', sport)"),
        ("tcp_syn_fin_violation", "proto = 6 AND contains(flags, 'S') AND contains(flags, 'F')",
         "concat('Packet ', idx, ' sets both SYN and FIN — not a legal TCP state transition; classic scanner/evasion signature.')",
         "concat('flags=', flags)"),
        ("tcp_syn_with_payload", "proto = 6 AND contains(flags, 'S') AND NOT contains(flags, 'A') AND plen > 0",
         "concat('Packet ', idx, ' carries a payload on a bare SYN (no ACK) — a connection has not been established yet.')",
         "concat('flags=', flags, ';payload_len=', plen)"),
        ("tcp_syn_rst_violation", "proto = 6 AND flags IN ('RS', 'SR')",
         "concat('Packet ', idx, ' sets both SYN and RST simultaneously.')", "concat('flags=', flags)"),
        ("dns_payload_anomalous", f"sig = 'dns' AND plen > 0 AND (plen > 300 OR NOT ({DNS}))",
         "concat('Packet ', idx, ' on DNS port (', sport, '/', dport, ') has a payload that doesn''t look like a well-formed DNS message and/or is oversized (', plen, ' bytes) — consistent with DNS tunneling or amplification abuse.')",
         "concat('payload_len=', plen)"),
        ("port_protocol_mismatch",
         f"plen > 0 AND ((sig = 'http' AND NOT {HTTP}) OR (sig = 'tls' AND NOT {TLS}) OR (sig = 'ssh' AND NOT {SSH}))",
         f"concat('Packet ', idx, ' on port ', {port}, ' (expected ''', sig, ''') has a payload that doesn''t match the expected ''', sig, ''' signature — traffic may be tunneled, misconfigured, or mislabeled.')",
         f"concat('expected_protocol=', sig, ';port=', {port})"),
    ]
    parts = [f"SELECT {key} AS k, idx, {i} AS ruleno, {q(code)} AS code, {msg} AS message, {ev} AS evidence "
             f"FROM {capped} WHERE {cond}" for i, (code, cond, msg, ev) in enumerate(rules)]
    parts.append(f"""SELECT k, 99 AS idx, 7 AS ruleno, 'ttl_inconsistency' AS code,
        concat('TTL varies by ', hi - lo, ' across packets claiming to be the same flow (min=', lo, ', max=', hi, ') — possible source-address spoofing or asymmetric routing.') AS message,
        concat('ttl_max=', hi, ';ttl_min=', lo) AS evidence
        FROM (SELECT {key} AS k, min(ttl) AS lo, max(ttl) AS hi, count(*) AS n FROM {capped} GROUP BY {key})
        WHERE n >= 3 AND hi - lo > 10""")
    values = ", ".join(f"({q(code)}, {q(sev)}, {SEVERITY_RANK[sev]}, {q(cause)})" for code, sev, cause in RULES)
    return f"""
{name}_dim(code, severity, sevrank, cause) AS (VALUES {values}),
{name} AS (SELECT u.*, d.severity, d.sevrank, d.cause,
    CAST(row_number() OVER (PARTITION BY k ORDER BY idx, ruleno) - 1 AS INT) AS position,
    count(*) OVER (PARTITION BY k, d.cause) AS freq,
    CASE WHEN idx = 99 THEN -1 ELSE idx END AS packet_index
    FROM ({" UNION ALL ".join(parts)}) u JOIN {name}_dim d USING (code))"""


FOUND = findings("flow", "capped", "found")
CONTEXT = f"""
by_src AS (SELECT src, count(*) AS n_packets, count(DISTINCT concat(dst, '|', dport)) AS n_pairs,
    avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END) AS ratio FROM capped GROUP BY src),
by_dst AS (SELECT dst, dport, count(*) AS n_packets, count(DISTINCT concat(src, '|', sport)) AS n_sources,
    avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END) AS ratio FROM capped GROUP BY dst, dport)"""


def _tops(name: str, found: str) -> str:
    return f"""
{name}_best AS (SELECT k, cause, sevrank, freq FROM (SELECT *, row_number() OVER (
    PARTITION BY k ORDER BY sevrank DESC, freq DESC, position) AS r FROM {found}) WHERE r = 1),
{name}_codes AS (SELECT k, string_agg(code, ',' ORDER BY position) AS codes FROM {found} GROUP BY k),
{name}_support AS (SELECT k, string_agg(message, '; ' ORDER BY position) FILTER (WHERE nth <= 3) AS quoted,
    string_agg(code, ',' ORDER BY position) AS codes
    FROM (SELECT f.*, row_number() OVER (PARTITION BY f.k ORDER BY position) AS nth
          FROM {found} f JOIN {name}_best b ON f.k = b.k AND f.cause = b.cause) GROUP BY k),
{name} AS (SELECT b.*, c.codes AS all_codes, s.quoted, s.codes AS support_codes
    FROM {name}_best b JOIN {name}_codes c USING (k) JOIN {name}_support s USING (k))"""


LABELS = "label_dim(tag, label) AS (VALUES " + ", ".join(f"({q(t)}, {q(l)})" for t, l in CAUSE_LABELS.items()) + ")"
ACTION_DIM = "action_dim(tag, n_actions, actions) AS (VALUES " + ", ".join(
    f"({q(t)}, {len(a)}, {q(' | '.join(a))})" for t, a in ACTIONS.items()) + ")"


def verdicts(contexts: bool) -> str:
    """The report of every flow; with or without the cross-flow contexts."""
    src = "s.n_pairs" if contexts else "CAST(NULL AS BIGINT)"
    flood = "(d.n_sources >= 8 AND d.n_packets >= 10 AND d.ratio >= 0.8)" if contexts else "false"
    return f"""
judged AS (SELECT w.flow, w.first_seen, w.packets, w.score, w.src, {src} AS n_pairs, d.n_sources, d.n_packets AS dpk, d.ratio,
    t.cause, t.sevrank, t.freq, t.quoted, t.support_codes, coalesce(t.all_codes, '') AS all_codes,
    CASE WHEN {src} >= 8 THEN 'port_scan_reconnaissance' WHEN {flood} THEN 'syn_flood_dos'
         WHEN t.cause IS NOT NULL THEN t.cause WHEN w.score >= 0.5 THEN 'model_flagged_anomaly'
         ELSE 'benign' END AS tag
    FROM score w LEFT JOIN by_src s USING (src) LEFT JOIN by_dst d ON w.dst = d.dst AND w.dport = d.dport
    LEFT JOIN tops t ON t.k = w.flow),
report AS (SELECT j.flow, j.first_seen, j.packets, round(j.score, 6) AS anomaly_score, j.score > 0.5 AS anomaly,
    j.all_codes <> '' AS mismatch_detected, j.all_codes AS finding_codes, j.tag, l.label,
    round(CASE WHEN n_pairs >= 8 THEN least(CAST(0.95 AS DOUBLE), 0.5 + 0.05 * n_pairs)
         WHEN j.tag = 'syn_flood_dos' THEN least(CAST(0.95 AS DOUBLE), 0.6 + 0.3 * ratio)
         WHEN cause IS NOT NULL THEN least(CAST(0.97 AS DOUBLE), 0.5 + 0.12 * freq + 0.1 * sevrank)
         WHEN score >= 0.5 THEN score ELSE 1.0 - score END, 6) AS confidence,
    CASE WHEN n_pairs >= 8 THEN concat('Source ', src, ' touched ', n_pairs, ' distinct destination ports across the capture (>= 8) => reconnaissance / port-scan pattern.')
         WHEN j.tag = 'syn_flood_dos' THEN concat('Target received ', dpk, ' packets from ', n_sources, ' distinct source (ip, port) pairs, ', printf('%.0f', ratio * 100), '% bare-SYN with no completed handshake => SYN-flood / connection-exhaustion pattern.')
         WHEN cause IS NOT NULL THEN concat(freq, ' structural finding(s) map to ''', l.label, ''': ', quoted)
         WHEN score >= 0.5 THEN concat('No structural rule matched, but the model''s P(anomaly) = ', printf('%.3f', score), ' >= threshold 0.50; flagging for manual review — this is the model''s learned judgement, not a rule.')
         ELSE concat('No structural findings and P(anomaly) = ', printf('%.3f', score), ' is below threshold 0.50.') END AS reasoning,
    CASE WHEN j.tag IN ('port_scan_reconnaissance', 'syn_flood_dos') THEN all_codes
         WHEN cause IS NOT NULL THEN support_codes ELSE '' END AS contributing,
    a.actions
    FROM judged j JOIN label_dim l ON l.tag = j.tag JOIN action_dim a ON a.tag = j.tag)"""


TOPS = _tops("tops", "found")
ALL = ",".join([WIRE, FOUND, CONTEXT, TOPS, LABELS, ACTION_DIM, verdicts(True)])
ALONE = ",".join([WIRE, FOUND, CONTEXT, TOPS, LABELS, ACTION_DIM, verdicts(False)])
REPORT_COLUMNS = ("flow, packets, anomaly_score, anomaly, mismatch_detected, finding_codes, tag, label, confidence, "
                  "reasoning, contributing, actions")

# The source as the flow: its first 16 packets.
SRC_CAPPED = """
scapped AS (SELECT * FROM (SELECT * EXCLUDE (idx), CAST(row_number() OVER (PARTITION BY src ORDER BY event_id) - 1 AS INT) AS idx
    FROM (SELECT *, 0 AS idx FROM wire)) WHERE idx < 16)"""
SRC_STATS = f"""
stats AS (SELECT src, CAST(count(*) AS INT) AS n_packets, CAST(count(DISTINCT sport) AS INT) AS n_distinct_src_ports,
    CAST(count(DISTINCT dport) AS INT) AS n_distinct_dst_ports,
    CAST(count(*) FILTER (WHERE {BARE}) AS INT) AS syn_only_count,
    CAST(count(*) FILTER (WHERE proto = 6 AND contains(flags, 'A')) AS INT) AS ack_count,
    round(avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END), 6) AS syn_only_ratio,
    avg(CASE WHEN {BARE} THEN 1.0 ELSE 0.0 END) AS raw_ratio FROM scapped GROUP BY src)"""
SRC_ALL = ",".join([WIRE, SRC_CAPPED, SRC_STATS, findings("src", "scapped", "sfound"),
                    "scodes AS (SELECT k AS src, string_agg(code, ',' ORDER BY position) AS codes FROM sfound GROUP BY k)"])
SCAN = "(n_distinct_dst_ports >= 8 AND n_packets >= 8)"
SFLOOD = "(n_packets >= 10 AND n_distinct_src_ports >= 8 AND raw_ratio >= 0.8)"


def _rule(code: str) -> str:
    return f"WITH {WIRE}, {FOUND} SELECT k AS flow, packet_index, code, severity, message FROM found WHERE code = {q(code)}"


def _text() -> str:
    per_finding = f"""lines AS (SELECT k AS flow, string_agg(concat('    [', severity, '] ', code, ': ', message), chr(10) ORDER BY position) AS body,
        count(*) AS n FROM found GROUP BY k)"""
    return f"""WITH {ALL}, {per_finding}
SELECT r.flow, concat(CASE WHEN anomaly THEN '[ANOMALY]' ELSE '[NORMAL] ' END, ' score=', printf('%.4f', anomaly_score), ' | ', r.flow,
    ' | packets=', packets, chr(10), '  root cause : ', label, ' (tag=', tag, ', confidence=', printf('%.2f', confidence), ')', chr(10),
    '    reason   : ', reasoning, chr(10),
    CASE WHEN n IS NULL THEN '  mismatches : none' ELSE concat('  mismatches : ', n, ' finding(s)', chr(10), body) END, chr(10),
    '  suggested actions:', chr(10), '    - ', replace(actions, ' | ', concat(chr(10), '    - '))) AS text
FROM report r LEFT JOIN lines USING (flow)"""


ORACLES = {
    "flow_key": f"WITH {WIRE} SELECT event_id, flow FROM wire",
    "plain_scores": f"WITH {WIRE} SELECT flow, score, score > 0.5 AS anomaly, packets FROM score",
    "score_records_join": f"""WITH {WIRE}, n AS (SELECT flow, count(*) AS n FROM capped GROUP BY flow),
        s AS (SELECT score, CASE WHEN CAST(round(score * 20000) AS INT) % 7 = 0 THEN
              regexp_replace(flow, 'proto [0-9]+', concat('proto ', 100 + CAST(regexp_extract(flow, 'proto ([0-9]+)', 1) AS INT)))
              ELSE flow END AS flow FROM score)
        SELECT s.flow, round(score, 6) AS score, coalesce(n.n, 0) AS n_records FROM s LEFT JOIN n USING (flow)""",
    "source_context_join": f"""WITH {WIRE}, {CONTEXT} SELECT flow, n_pairs AS n_distinct_dst_ports, n_packets AS src_packets,
        round(ratio, 6) AS syn_only_ratio FROM score JOIN by_src USING (src)""",
    "target_context_join": f"""WITH {WIRE}, {CONTEXT} SELECT flow, n_sources AS n_distinct_sources, n_packets AS dst_packets,
        round(ratio, 6) AS syn_only_ratio FROM score JOIN by_dst USING (dst, dport)""",
    "finding_cause": f"WITH {WIRE}, {FOUND} SELECT k AS flow, packet_index, code, cause, sevrank AS severity_rank FROM found",
    "cause_label": f"WITH {ALL} SELECT flow, tag, label FROM report",
    "suggest_actions": f"""WITH {WIRE}, {FOUND}, {TOPS}, {ACTION_DIM},
        named AS (SELECT s.flow, coalesce(t.cause, 'no_such_cause') AS tag FROM score s LEFT JOIN tops t ON t.k = s.flow)
        SELECT flow, n.tag, CAST(a.n_actions AS BIGINT) AS n_actions, a.actions FROM named n
        JOIN action_dim a ON a.tag = CASE WHEN n.tag = 'no_such_cause' THEN 'model_flagged_anomaly' ELSE n.tag END""",
    "port_signature": f"WITH {WIRE} SELECT event_id, sig AS signature FROM wire",
    "assemble_capture_flows": f"""WITH {WIRE} SELECT flow, min(event_id) AS first_arrival, CAST(count(*) AS INT) AS npkts,
        CAST(any_value(proto) % 132 AS INT) AS proto_id,
        concat(any_value(proto) % 132, ',', any_value(CASE WHEN sport < 1024 THEN 1 WHEN sport < 49152 THEN 2 ELSE 3 END), ',',
               any_value(CASE WHEN dport < 1024 THEN 1 WHEN dport < 49152 THEN 2 ELSE 3 END), ',', count(*), ',0') AS headers,
        string_agg(CAST(least(plen, 128) AS VARCHAR), ',' ORDER BY idx) AS lengths,
        string_agg(substr(payload_hex, 1, 256), ',' ORDER BY idx) AS payloads FROM capped GROUP BY flow""",
    "aggregate_by_src": f"WITH {WIRE}, {CONTEXT} SELECT src, n_packets, n_pairs AS n_distinct_dst_ports, round(ratio, 6) AS syn_only_ratio FROM by_src",
    "aggregate_by_dst": f"WITH {WIRE}, {CONTEXT} SELECT dst, dport, n_packets, n_sources AS n_distinct_sources, round(ratio, 6) AS syn_only_ratio FROM by_dst",
    "flow_stats": f"WITH {WIRE}, {SRC_CAPPED}, {SRC_STATS} SELECT * EXCLUDE (raw_ratio) FROM stats",
    "ttl_spread": f"WITH {WIRE} SELECT flow, CAST(count(*) AS INT) AS n_packets, min(ttl) AS ttl_min, max(ttl) AS ttl_max FROM capped GROUP BY flow",
    "cause_frequency": f"WITH {WIRE}, {FOUND} SELECT k AS flow, cause, count(*) AS n_findings FROM found GROUP BY k, cause",
    "cause_summary": f"WITH {ALL} SELECT tag, count(*) AS n_flows FROM report GROUP BY tag",
    "packet_index": f"WITH {WIRE} SELECT flow, event_id, idx AS packet_index FROM capped",
    "top_finding": f"WITH {WIRE}, {FOUND}, {TOPS} SELECT k AS flow, cause, sevrank AS severity_rank, CAST(freq AS INT) AS supporting FROM tops",
    "cap_reports": f"WITH {ALL} SELECT flow, first_seen, tag FROM report ORDER BY first_seen LIMIT 200",
    "report_envelope": f"WITH {WIRE} SELECT 'all' AS capture, count(*) AS n_flows, count(*) > 200 AS truncated FROM score",
    "top_flows": f"WITH {ALL} SELECT flow, anomaly_score, label AS cause FROM report ORDER BY anomaly_score DESC, first_seen LIMIT 10",
    "flag_sets": f"""WITH {WIRE} SELECT event_id, array_to_string(list_sort(list_distinct(string_split(flags, ''))), '') AS flag_set,
        contains(flags, 'S') AS has_syn, contains(flags, 'A') AS has_ack, flags IN ('RS', 'SR') AS is_syn_rst, {BARE} AS bare_syn FROM wire""",
    "signature_checks": f"WITH {WIRE} SELECT event_id, {HTTP} AS http, {TLS} AS tls, {SSH} AS ssh, {DNS} AS dns FROM wire",
    "finding_messages": f"WITH {WIRE}, {FOUND} SELECT k AS flow, packet_index, code, message FROM found",
    "finding_evidence": f"WITH {WIRE}, {FOUND} SELECT k AS flow, packet_index, code, evidence FROM found",
    "rule_ip_checksum": _rule("ip_checksum_mismatch"), "rule_l4_checksum": _rule("l4_checksum_mismatch"),
    "rule_syn_fin": _rule("tcp_syn_fin_violation"), "rule_syn_payload": _rule("tcp_syn_with_payload"),
    "rule_syn_rst": _rule("tcp_syn_rst_violation"), "rule_dns": _rule("dns_payload_anomalous"),
    "rule_port_protocol": _rule("port_protocol_mismatch"), "rule_ttl": _rule("ttl_inconsistency"),
    "inspect_flows": f"WITH {WIRE}, {FOUND} SELECT k AS flow, position, packet_index, code, severity FROM found",
    "rca_port_scan": f"WITH {ALL} SELECT flow, tag, confidence, reasoning FROM report WHERE tag = 'port_scan_reconnaissance'",
    "rca_syn_flood": f"WITH {ALL} SELECT flow, tag, confidence, reasoning FROM report WHERE tag = 'syn_flood_dos'",
    "rca_flow_scan": f"""WITH {SRC_ALL} SELECT src, round(least(CAST(0.95 AS DOUBLE), 0.5 + 0.05 * n_distinct_dst_ports), 6) AS confidence,
        concat(n_distinct_dst_ports, ' distinct destination ports probed from a single source within one flow window (>= 8) => reconnaissance / port-scan pattern.') AS reasoning,
        coalesce(codes, '') AS contributing FROM stats LEFT JOIN scodes USING (src) WHERE {SCAN}""",
    "rca_flow_flood": f"""WITH {SRC_ALL} SELECT src, round(least(CAST(0.95 AS DOUBLE), 0.6 + 0.3 * raw_ratio), 6) AS confidence,
        concat(n_packets, ' packets, ', n_distinct_src_ports, ' distinct source ports, ', CAST(round_even(raw_ratio * 100, 0) AS INT), '% bare-SYN with no completed handshake => SYN-flood / connection-exhaustion pattern.') AS reasoning,
        coalesce(codes, '') AS contributing FROM stats LEFT JOIN scodes USING (src) WHERE NOT {SCAN} AND {SFLOOD}""",
    "rca_structural": f"WITH {ALL} SELECT flow, tag, confidence, reasoning FROM report WHERE tag IN (SELECT DISTINCT cause FROM found_dim)",
    "rca_model": f"WITH {ALL} SELECT flow, tag, confidence, reasoning FROM report WHERE tag = 'model_flagged_anomaly'",
    "rca_benign": f"WITH {ALL} SELECT flow, tag, confidence, reasoning FROM report WHERE tag = 'benign'",
    "rca_reasoning": f"WITH {ALL} SELECT flow, tag, reasoning FROM report",
    "rca_contributing": f"WITH {ALL} SELECT flow, tag, contributing FROM report",
    "diagnose_flows": f"WITH {ALONE} SELECT {REPORT_COLUMNS} FROM report",
    "diagnose_captures": f"WITH {ALL} SELECT {REPORT_COLUMNS} FROM report",
    "diagnose_capture_files": f"WITH {ALL.replace(FROM_TABLE, FROM_FILES, 1)} SELECT {REPORT_COLUMNS} FROM report",
    "response_envelopes": f"""WITH {WIRE.replace(FROM_TABLE, FROM_FILES, 1)},
n AS (SELECT event_id // 200 AS request, count(DISTINCT flow) AS n_flows FROM wire GROUP BY 1),
r AS (SELECT DISTINCT event_id // 200 AS request FROM events)
SELECT CAST(request AS VARCHAR) AS request, CASE WHEN request % 3 < 2 THEN 'wire' END AS model,
    CASE WHEN request % 3 < 2 THEN coalesce(n_flows, 0) END AS n_flows,
    CASE WHEN request % 3 < 2 THEN CAST(coalesce(n_flows, 0) > 7 AS VARCHAR) END AS truncated, request % 3 = 2 AS failed,
    CAST(CASE WHEN request % 3 < 2 THEN least(coalesce(n_flows, 0), 7) ELSE 0 END AS INT) AS n_results
FROM r LEFT JOIN n USING (request)""",
    "text_report": _text(),
}
