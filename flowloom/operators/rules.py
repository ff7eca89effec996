"""Protocol rules: per-packet bits before the shuffle, finding rows and lists after it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.dimensions import RULES, RULE_CODES
from flowloom.functions import signatures as G
from flowloom.functions.text import fill
from flowloom.schema import FINDING, TCP

SEVERITY = {code: severity for code, severity, _ in RULES}
TTL_RULE = "ttl_inconsistency"
PACKET_RULES = [code for code in RULE_CODES if code != TTL_RULE]

# Limits of the TTL rule.
TTL_MIN_PACKETS = 3
TTL_MAX_SPREAD = 10

# Message texts.
MESSAGES = {
    "ip_checksum_mismatch": "IP header checksum does not match the recomputed value for packet {} ({} -> {}); packet is corrupted, was tampered with in transit, or was crafted.",
    "l4_checksum_mismatch": "Transport-layer (TCP/UDP) checksum mismatch on packet {}; segment content does not match what its own header claims.",
    "tcp_syn_fin_violation": "Packet {} sets both SYN and FIN — not a legal TCP state transition; classic scanner/evasion signature.",
    "tcp_syn_with_payload": "Packet {} carries a payload on a bare SYN (no ACK) — a connection has not been established yet.",
    "tcp_syn_rst_violation": "Packet {} sets both SYN and RST simultaneously.",
    "dns_payload_anomalous": "Packet {} on DNS port ({}/{}) has a payload that doesn't look like a well-formed DNS message and/or is oversized ({} bytes) — consistent with DNS tunneling or amplification abuse.",
    "port_protocol_mismatch": "Packet {} on port {} (expected '{}') has a payload that doesn't match the expected '{}' signature — traffic may be tunneled, misconfigured, or mislabeled.",
    "ttl_inconsistency": "TTL varies by {} across packets claiming to be the same flow (min={}, max={}) — possible source-address spoofing or asymmetric routing.",
}


def rule_conditions(registry: dict[int, G.Signature] | None = None) -> dict[str, Column]:
    """Code to condition over packet columns and ``signature``, the name expected on the ports."""
    flags, payload, tcp = F.col("flags"), F.col("payload"), F.col("proto") == TCP
    syn = G.has_flag(flags, "S")
    name = F.col("signature")
    filled = F.length(payload) > 0
    matches = F.coalesce(G.signature_matches(name, payload, registry), F.lit(True))
    return {
        "ip_checksum_mismatch": ~F.col("ip_checksum_ok"),
        "l4_checksum_mismatch": ~F.col("l4_checksum_ok"),
        "tcp_syn_fin_violation": tcp & syn & G.has_flag(flags, "F"),
        "tcp_syn_with_payload": tcp & syn & ~G.has_flag(flags, "A") & filled,
        "tcp_syn_rst_violation": tcp & G.flags_are(flags, "RS"),
        "dns_payload_anomalous": (name == "dns") & filled
        & ((F.length(payload) > G.DNS_OVERSIZE_BYTES) | ~matches),
        "port_protocol_mismatch": (name != "dns") & filled & ~matches,
    }


def rule_bits(registry: dict[int, G.Signature] | None = None, rules: list[str] | None = None) -> Column:
    """Bit i is set where packet rule i fires; ``rules`` limits the work to some codes."""
    total = F.lit(0)
    for code, cond in rule_conditions(registry).items():
        if rules is None or code in rules:
            total = total + F.when(cond, 1 << PACKET_RULES.index(code)).otherwise(0)
    return total


def _text_map(**items: Column) -> Column:
    return F.create_map(*[x for k, v in items.items() for x in (F.lit(k), v.cast("string"))])


def _finding(code: str, index: Column, message: Column, evidence: Column) -> Column:
    return F.struct(F.lit(code).alias("code"), F.lit(SEVERITY[code]).alias("severity"),
                    index.cast("int").alias("packet_index"), message.alias("message"),
                    evidence.alias("evidence"))


def _packet_findings(p: Column) -> Column:
    """Findings of one flagged packet in rule order."""
    i = p["packet_index"]
    port = F.when(p["dport"] != 0, p["dport"]).otherwise(p["sport"])
    args = {
        "ip_checksum_mismatch": ([i, p["src"], p["dst"]], {"src": p["src"], "dst": p["dst"]}),
        "l4_checksum_mismatch": ([i], {"sport": p["sport"], "dport": p["dport"]}),
        "tcp_syn_fin_violation": ([i], {"flags": p["flags"]}),
        "tcp_syn_with_payload": ([i], {"flags": p["flags"], "payload_len": p["payload_len"]}),
        "tcp_syn_rst_violation": ([i], {"flags": p["flags"]}),
        "dns_payload_anomalous": ([i, p["sport"], p["dport"], p["payload_len"]],
                                  {"payload_len": p["payload_len"]}),
        "port_protocol_mismatch": ([i, port, p["signature"], p["signature"]],
                                   {"expected_protocol": p["signature"], "port": port}),
    }
    out = []
    for bit, code in enumerate(PACKET_RULES):
        slots, evidence = args[code]
        fired = p["rule_bits"].bitwiseAND(1 << bit) != 0
        out.append(F.when(fired, _finding(code, i, fill(MESSAGES[code], *slots), _text_map(**evidence))))
    return F.array_compact(F.array(*out))


def _ttl_finding() -> Column:
    low, high = F.col("ttl_min"), F.col("ttl_max")
    fired = (F.col("n_packets") >= TTL_MIN_PACKETS) & (high - low > TTL_MAX_SPREAD)
    found = _finding(TTL_RULE, F.lit(-1), fill(MESSAGES[TTL_RULE], high - low, low, high),
                     _text_map(ttl_min=low, ttl_max=high))
    return F.array_compact(F.array(F.when(fired, found)))


def with_findings(flows: DataFrame, rules: list[str] | None = None) -> DataFrame:
    """Add the ordered ``findings`` list: packet rules by packet, then the flow-level rule."""
    packet_part = F.flatten(F.transform("flagged", _packet_findings))
    empty = F.array().cast(f"array<{FINDING.simpleString()}>")
    flow_part = _ttl_finding() if rules is None or TTL_RULE in rules else empty
    return flows.withColumn("findings", F.concat(packet_part, flow_part)).drop("flagged")


def finding_rows(flows: DataFrame, key: list[str]) -> DataFrame:
    """One row per finding, ``position`` giving the order inside the flow."""
    return flows.select(*key, F.posexplode("findings").alias("position", "f")).select(*key, "position", "f.*")


def inspect_flows(packets: DataFrame, key: list[str] | None = None, rules: list[str] | None = None,
                  registry: dict[int, G.Signature] | None = None) -> DataFrame:
    """All findings of a packet table, or those of some ``rules``, one row each."""
    from flowloom import schema as S
    from flowloom.operators.flows import summarize_flows

    key = key or S.FLOW_KEY
    flows = summarize_flows(packets, key, registry=registry, rules=rules)
    return finding_rows(with_findings(flows, rules), key)
