"""Small lookup tables. All are bounded by the literals below, so broadcasting is safe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Results depend on these exact names, numbers and texts.
# ---------------------------------------------------------------------------

# Traffic classes; the position is the class id and 0 is benign.
ATTACK_CLASSES = ["normal", "analysis", "backdoor", "dos", "exploits",
                  "fuzzers", "generic", "reconnaissance", "shellcode", "worms"]

# Protocol names and their IANA numbers.
PROTOCOL_NUMBERS = {
    "hopopt": 0, "icmp": 1, "igmp": 2, "ggp": 3, "ipv4": 4, "st": 5, "tcp": 6, "cbt": 7,
    "egp": 8, "igp": 9, "udp": 17, "dccp": 33, "ipv6": 41, "rsvp": 46, "gre": 47, "esp": 50,
    "ah": 51, "icmpv6": 58, "eigrp": 88, "ospf": 89, "pim": 103, "vrrp": 112, "l2tp": 115,
    "sctp": 132,
}

# Protocol rules in reporting order: code, severity, cause.
RULES = [
    ("ip_checksum_mismatch", "high", "packet_corruption_or_tampering"),
    ("l4_checksum_mismatch", "high", "packet_corruption_or_tampering"),
    ("tcp_syn_fin_violation", "high", "scanner_or_evasion_tooling"),
    ("tcp_syn_with_payload", "medium", "protocol_state_violation"),
    ("tcp_syn_rst_violation", "medium", "scanner_or_evasion_tooling"),
    ("dns_payload_anomalous", "medium", "dns_tunneling_or_amplification"),
    ("port_protocol_mismatch", "low", "protocol_payload_mismatch"),
    ("ttl_inconsistency", "low", "possible_source_spoofing"),
]
SEVERITY_RANK = {"info": 0, "low": 1, "medium": 2, "high": 3}

# Root-cause labels.
CAUSE_LABELS = {
    "packet_corruption_or_tampering": "Packet corruption or on-path tampering",
    "scanner_or_evasion_tooling": "Scanner / evasion tooling (illegal TCP flag combinations)",
    "protocol_state_violation": "TCP protocol state-machine violation",
    "dns_tunneling_or_amplification": "Possible DNS tunneling or amplification abuse",
    "protocol_payload_mismatch": "Payload does not match the protocol expected on this port",
    "possible_source_spoofing": "Possible source-address spoofing / asymmetric routing",
    "port_scan_reconnaissance": "Port-scan reconnaissance (many destination ports, one source)",
    "syn_flood_dos": "SYN flood / connection exhaustion (many source ports, incomplete handshakes)",
    "model_flagged_anomaly": "Model flagged this flow as anomalous; no specific structural cause matched",
    "benign": "No anomaly indicators found",
}

# Suggested actions per cause, in order.
ACTIONS = {
    "port_scan_reconnaissance": [
        "Rate-limit or temporarily block the source IP at the edge firewall/ACL.",
        "Check whether the destination host(s) expose any of the probed ports unnecessarily and close/firewall the unused ones.",
        "Correlate the source IP against threat-intel feeds and internal asset inventory (is this an authorized scanner, e.g. a vuln-management job?).",
        "Enable/verify port-scan detection thresholds on the IDS/IPS in front of this segment.",
    ],
    "syn_flood_dos": [
        "Enable SYN cookies on the target host/load-balancer.",
        "Rate-limit new connections per source IP at the firewall or L4 load balancer.",
        "Lower the SYN-RECEIVED timeout / increase the backlog queue temporarily to absorb the burst.",
        "If sustained, engage upstream DDoS scrubbing / blackhole the offending source ranges.",
    ],
    "packet_corruption_or_tampering": [
        "Check the physical/link layer on the path (bad cable, failing NIC, duplex mismatch) — checksum errors are often hardware, not malicious.",
        "If corruption is isolated to one path, capture at both ends to localize the failing hop.",
        "If checksums are intentionally wrong (some crafted-packet tools do this), treat as a potential evasion/fuzzing attempt and inspect the source further.",
    ],
    "scanner_or_evasion_tooling": [
        "Illegal TCP flag combinations (SYN+FIN, SYN+RST) are a strong scanner/evasion signature — block the source IP and open an investigation.",
        "Verify your IDS/IPS has signatures for stealth-scan flag patterns enabled.",
        "Check the destination host's logs for any resulting connection attempts.",
    ],
    "protocol_state_violation": [
        "Inspect the sending host/application for a broken TCP implementation (payload on a bare SYN is invalid) — this can also be crafted traffic.",
        "If reproducible from a known-good client, check for a NIC offload / TCP stack bug.",
    ],
    "dns_tunneling_or_amplification": [
        "Inspect the DNS payload for encoded/exfiltrated data (tunneling tools typically use TXT/NULL records with high-entropy subdomains).",
        "Apply DNS response-size limits and enable response-rate limiting (RRL) on authoritative/recursive resolvers to blunt amplification abuse.",
        "Restrict which hosts are allowed to query external DNS directly (force internal resolvers) to make tunneling easier to detect.",
    ],
    "protocol_payload_mismatch": [
        "Confirm whether this is intentional (e.g. a service legitimately running on a non-standard port) and update asset documentation if so.",
        "If unexpected, treat as possible protocol tunneling/evasion and inspect the payload contents more closely.",
        "Consider deep-packet-inspection rules that key on payload signature rather than port number for this segment.",
    ],
    "possible_source_spoofing": [
        "Enable/verify ingress and egress filtering (BCP38/uRPF) at your network edge to drop spoofed-source traffic.",
        "Cross-check the TTL/path against known-good baselines for this source; large swings can also just mean route changes, not spoofing — confirm before blocking.",
    ],
    "model_flagged_anomaly": [
        "No specific rule fired, but the model's learned score is high — queue for manual analyst review rather than auto-remediating.",
        "If this repeats for the same flow signature, consider adding a dedicated structural rule for it.",
        "Re-run with a model checkpoint trained on real labelled traffic if you are still on a smoke-test/synthetic checkpoint — untrained models over-flag indiscriminately.",
    ],
    "benign": ["No action needed."],
}
DEFAULT_ACTION_TAG = "model_flagged_anomaly"

CODE_TO_CAUSE = {code: cause for code, _, cause in RULES}
RULE_CODES = [code for code, _, _ in RULES]


# ---------------------------------------------------------------------------
# The same tables as literals inside an expression, and as DataFrames.
# ---------------------------------------------------------------------------

def literal_map(mapping: dict) -> Column:
    """A map literal; constant-folded once per plan, so a lookup needs no join."""
    return F.create_map(*[F.lit(x) for pair in mapping.items() for x in pair])


def lookup(mapping: dict, key: Column) -> Column:
    return F.try_element_at(literal_map(mapping), key)


def attack_classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(ATTACK_CLASSES)), "class_id INT, class_name STRING")


def protocol_numbers(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(PROTOCOL_NUMBERS.items()), "name STRING, number INT")


def finding_causes(spark: SparkSession) -> DataFrame:
    rows = [(code, sev, SEVERITY_RANK[sev], cause) for code, sev, cause in RULES]
    return spark.createDataFrame(rows, "code STRING, severity STRING, severity_rank INT, cause STRING")


def cause_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(CAUSE_LABELS.items()), "tag STRING, label STRING")


def action_table(spark: SparkSession) -> DataFrame:
    """One row per cause; edit or replace it and pass it to ``suggest_actions``."""
    return spark.createDataFrame(list(ACTIONS.items()), "tag STRING, actions ARRAY<STRING>")
