"""Queries over wire packets: flows, contexts, rules, verdicts, reports."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import dimensions as D
from flowloom import schema as S
from flowloom.functions import signatures as G
from flowloom.operators import contexts as X
from flowloom.operators import flows as A
from flowloom.operators import rules as R
from flowloom.operators import verdicts as V
from flowloom.operators.lookups import lookup_join
from flowloom.plans import diagnose as P
from flowloom.plans import fixtures as FX
from flowloom.plans import frames_fixture as FF
from flowloom.plans import requests as RQ
from flowloom.session import materialize
from flowloom.sources.reports import report_json

Query = Callable[[SparkSession, str], DataFrame]
c = F.col


def _flows(spark: SparkSession, sf: str, **kw) -> DataFrame:
    return A.summarize_flows(FX.wire_packets(spark, sf), **kw)


def _inspected(spark: SparkSession, sf: str) -> DataFrame:
    return R.with_findings(_flows(spark, sf))


def _findings(spark: SparkSession, sf: str, rules: list[str] | None = None) -> DataFrame:
    rows = R.inspect_flows(FX.wire_packets(spark, sf), rules=rules)
    return rows.select(P.key_text().alias("flow"), "position", "packet_index", "code", "severity", "message", "evidence")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    packets = materialize(FX.wire_packets(spark, sf), "wire")
    return P.diagnose_captures(packets, FX.wire_scores(packets))


def _flat(reports: DataFrame) -> DataFrame:
    cause = c("root_cause")
    return reports.select(
        "flow", "packets", F.round("anomaly_score", 6).alias("anomaly_score"), "anomaly", "mismatch_detected",
        F.array_join(F.transform("mismatch_findings", lambda f: f["code"]), ",").alias("finding_codes"),
        cause["tag"].alias("tag"), cause["label"].alias("label"),
        F.round(cause["confidence"], 6).alias("confidence"),
        F.array_join(cause["reasoning"], " ").alias("reasoning"),
        F.array_join(cause["contributing_findings"], ",").alias("contributing"),
        F.array_join("suggested_actions", " | ").alias("actions"))


def flow_key(spark, sf):
    return FX.wire_packets(spark, sf).select(c("arrival").alias("event_id"), P.key_text().alias("flow"))


def plain_scores(spark, sf):
    packets = FX.wire_packets(spark, sf)
    return P.plain_scores(packets, FX.wire_scores(packets)).drop("capture")


def score_records_join(spark, sf):
    packets = FX.wire_packets(spark, sf)
    scores = FX.wire_scores(packets)
    # Some scores name a flow that was never captured.
    scores = scores.withColumn("proto", F.when(F.round(c("score") * 20000).cast("int") % 7 == 0, c("proto") + 100).otherwise(c("proto")))
    table = P.scored_flow_table(packets, scores).filter(c("anomaly_score").isNotNull())
    return table.select(P.key_text().alias("flow"), F.round("anomaly_score", 6).alias("score"),
                        F.coalesce("n_packets", F.lit(0)).cast("bigint").alias("n_records"))


def source_context_join(spark, sf):
    flows = _flows(spark, sf)
    by_src = X.aggregate_by_src(flows).select(
        *S.SRC_KEY, "n_distinct_dst_ports", c("n_packets").alias("src_packets"), "syn_only_ratio", "n_flows")
    joined = lookup_join(flows.drop("syn_only_ratio", "n_distinct_dst_ports"), by_src, S.SRC_KEY, "n_flows", ["sport", "dst", "dport"])
    return joined.select(P.key_text().alias("flow"), "n_distinct_dst_ports", "src_packets",
                         F.round("syn_only_ratio", 6).alias("syn_only_ratio"))


def target_context_join(spark, sf):
    flows = _flows(spark, sf)
    by_dst = X.aggregate_by_dst(flows).select(
        *S.DST_KEY, "n_distinct_sources", c("n_packets").alias("dst_packets"), "syn_only_ratio", "n_flows")
    joined = lookup_join(flows.drop("syn_only_ratio"), by_dst, S.DST_KEY, "n_flows", ["src", "sport"])
    return joined.select(P.key_text().alias("flow"), "n_distinct_sources", "dst_packets",
                         F.round("syn_only_ratio", 6).alias("syn_only_ratio"))


def finding_cause(spark, sf):
    causes = D.finding_causes(spark).select("code", "cause", "severity_rank")
    return (_findings(spark, sf).join(F.broadcast(causes), "code", "left")
            .select("flow", "packet_index", "code", "cause", "severity_rank"))


def cause_label(spark, sf):
    tags = _reports(spark, sf).select("flow", c("root_cause")["tag"].alias("tag"))
    return tags.join(F.broadcast(D.cause_labels(spark)), "tag").select("flow", "tag", "label")


def suggest_actions(spark, sf):
    # Flows without a finding carry a cause the action table does not know.
    tops = V.with_top_finding(_inspected(spark, sf)).select(
        P.key_text().alias("flow"), F.coalesce(c("top")["cause"], F.lit("no_such_cause")).alias("tag"))
    return V.suggest_actions_from(tops, D.action_table(spark)).select(
        "flow", "tag", F.size("actions").cast("bigint").alias("n_actions"),
        F.array_join("actions", " | ").alias("actions"))


def port_signature(spark, sf):
    return FX.wire_packets(spark, sf).select(
        c("arrival").alias("event_id"), G.port_signature(c("sport"), c("dport")).alias("signature"))


def assemble_capture_flows(spark, sf):
    flows = A.assemble_capture_flows(FX.wire_packets(spark, sf))
    return flows.select(
        P.key_text().alias("flow"), "first_arrival", "npkts", "proto_id",
        F.array_join(c("headers").cast("array<string>"), ",").alias("headers"),
        F.array_join(F.transform("packets", lambda p: p["length"].cast("string")), ",").alias("lengths"),
        F.array_join(F.transform("packets", lambda p: F.hex(p["payload"])), ",").alias("payloads"))


def aggregate_by_src(spark, sf):
    return X.aggregate_by_src(_flows(spark, sf)).select(
        "src", "n_packets", "n_distinct_dst_ports", F.round("syn_only_ratio", 6).alias("syn_only_ratio"))


def aggregate_by_dst(spark, sf):
    return X.aggregate_by_dst(_flows(spark, sf)).select(
        "dst", "dport", "n_packets", "n_distinct_sources", F.round("syn_only_ratio", 6).alias("syn_only_ratio"))


def flow_stats(spark, sf):
    return _flows(spark, sf, key=S.SRC_KEY).select(
        "src", "n_packets", "n_distinct_src_ports", "n_distinct_dst_ports", "syn_only_count", "ack_count",
        F.round("syn_only_ratio", 6).alias("syn_only_ratio"))


def ttl_spread(spark, sf):
    return _flows(spark, sf).select(P.key_text().alias("flow"), "n_packets", "ttl_min", "ttl_max")


def cause_frequency(spark, sf):
    causes = D.finding_causes(spark).select("code", "cause")
    return (_findings(spark, sf).join(F.broadcast(causes), "code")
            .groupBy("flow", "cause").agg(F.count(F.lit(1)).alias("n_findings")))


def cause_summary(spark, sf):
    return P.cause_summary(_reports(spark, sf))


def packet_index(spark, sf):
    return A.packet_index(FX.wire_packets(spark, sf)).select(
        P.key_text().alias("flow"), c("arrival").alias("event_id"), "packet_index")


def top_finding(spark, sf):
    top = c("top")
    return V.with_top_finding(_inspected(spark, sf)).filter(top.isNotNull()).select(
        P.key_text().alias("flow"), top["cause"].alias("cause"), top["severity_rank"].alias("severity_rank"),
        top["supporting"].alias("supporting"))


def cap_reports(spark, sf):
    return P.cap_reports(_reports(spark, sf)).select("flow", "first_seen", c("root_cause")["tag"].alias("tag"))


def report_envelope(spark, sf):
    return P.envelope(_reports(spark, sf)).select("capture", "n_flows", "truncated")


def top_flows(spark, sf):
    return P.top_flows(_reports(spark, sf)).withColumn("anomaly_score", F.round("anomaly_score", 6))


def flag_sets(spark, sf):
    flags = c("flags")
    return FX.wire_packets(spark, sf).select(
        c("arrival").alias("event_id"), G.flag_set(flags).alias("flag_set"),
        G.has_flag(flags, "S").alias("has_syn"), G.has_flag(flags, "A").alias("has_ack"),
        G.flags_are(flags, "RS").alias("is_syn_rst"), G.bare_syn(c("proto"), flags).alias("bare_syn"))


def signature_checks(spark, sf):
    p = c("payload")
    return FX.wire_packets(spark, sf).select(
        c("arrival").alias("event_id"), G.looks_like_http(p).alias("http"), G.looks_like_tls(p).alias("tls"),
        G.looks_like_ssh(p).alias("ssh"), G.looks_like_dns(p).alias("dns"))


def finding_messages(spark, sf):
    return _findings(spark, sf).select("flow", "packet_index", "code", "message")


def finding_evidence(spark, sf):
    pairs = F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return _findings(spark, sf).select("flow", "packet_index", "code", F.array_join(pairs, ";").alias("evidence"))


def _rule(code: str) -> Query:
    def query(spark, sf):
        return _findings(spark, sf, [code]).select("flow", "packet_index", "code", "severity", "message")
    return query


def inspect_flows(spark, sf):
    return _findings(spark, sf).select("flow", "position", "packet_index", "code", "severity")


def _verdicts(tag: str, *, sentence: str) -> Query:
    """Reports of one verdict; ``sentence`` tells the cross-flow rules from the others."""
    def query(spark, sf):
        flat = _flat(_reports(spark, sf))
        return (flat.filter((c("tag") == tag) & c("reasoning").startswith(sentence))
                .select("flow", "tag", "confidence", "reasoning"))
    return query


def rca_structural(spark, sf):
    return (_flat(_reports(spark, sf)).filter(c("tag").isin(sorted(set(D.CODE_TO_CAUSE.values()))))
            .select("flow", "tag", "confidence", "reasoning"))


def _single_flow(tag: str) -> Query:
    """Verdicts with the source as the flow, where ports vary inside one flow."""
    def query(spark, sf):
        flows = R.with_findings(_flows(spark, sf, key=S.SRC_KEY))
        judged = V.with_root_cause(P.without_contexts(flows).withColumn("anomaly_score", F.lit(0.9)))
        cause = c("root_cause")
        return judged.filter(cause["tag"] == tag).select(
            "src", F.round(cause["confidence"], 6).alias("confidence"),
            F.array_join(cause["reasoning"], " ").alias("reasoning"),
            F.array_join(cause["contributing_findings"], ",").alias("contributing"))
    return query


def rca_reasoning(spark, sf):
    return _flat(_reports(spark, sf)).select("flow", "tag", "reasoning")


def rca_contributing(spark, sf):
    return _flat(_reports(spark, sf)).select("flow", "tag", "contributing")


def diagnose_flows(spark, sf):
    packets = materialize(FX.wire_packets(spark, sf), "wire")
    return _flat(P.diagnose_flows(packets, FX.wire_scores(packets)))


def diagnose_captures(spark, sf):
    return _flat(_reports(spark, sf))


def text_report(spark, sf):
    return P.text_report(_reports(spark, sf)).select("flow", "text")


def diagnose_capture_files(spark, sf):
    """Capture files to reports: the same reports as from the packet table they were written from."""
    def scorer(packets: DataFrame) -> DataFrame:
        return FX.wire_scores(packets.withColumn("arrival", c("arrival") - FF.FIRST_TS))

    return _flat(P.diagnose_files(spark, FF.capture_folder(spark, sf), scorer, merged="all"))


def response_envelopes(spark, sf):
    """Requests with their own limits to one JSON answer each; every third carries no capture."""
    frames = FF.wire_frames(spark, sf).withColumn("request", F.floor(c("frame_no") / FF.FRAMES_PER_FILE))
    requests = FF.request_captures(frames).select(
        c("request").cast("string").alias("request_id"),
        F.when(c("request") % 3 == 2, F.encode(F.lit("no capture"), "UTF-8")).otherwise(c("content")).alias("raw"),
        (c("request") % 2 == 0).alias("diagnose"), F.lit(7).alias("max_flows"))
    envelopes, results = RQ.answer_requests(requests, lambda p: FX.wire_scores(p), raw="raw", model={"name": "wire"})
    answers = RQ.responses(envelopes, results)
    field = lambda name: F.get_json_object("response", f"$.{name}")
    return answers.select(
        c("capture").alias("request"), field("model.name").alias("model"), field("n_flows").cast("bigint").alias("n_flows"),
        field("truncated").alias("truncated"), field("error").isNotNull().alias("failed"),
        F.size(F.from_json(F.coalesce(field("results"), F.lit("[]")), "array<string>")).alias("n_results"))


def report_json_query(spark, sf):
    return report_json(_reports(spark, sf))


QUERIES: dict[str, Query] = {
    "flow_key": flow_key, "plain_scores": plain_scores, "score_records_join": score_records_join,
    "source_context_join": source_context_join, "target_context_join": target_context_join,
    "finding_cause": finding_cause, "cause_label": cause_label, "suggest_actions": suggest_actions,
    "port_signature": port_signature, "assemble_capture_flows": assemble_capture_flows,
    "aggregate_by_src": aggregate_by_src, "aggregate_by_dst": aggregate_by_dst, "flow_stats": flow_stats,
    "ttl_spread": ttl_spread, "cause_frequency": cause_frequency, "cause_summary": cause_summary,
    "packet_index": packet_index, "top_finding": top_finding, "cap_reports": cap_reports,
    "report_envelope": report_envelope, "top_flows": top_flows, "flag_sets": flag_sets,
    "signature_checks": signature_checks, "finding_messages": finding_messages,
    "finding_evidence": finding_evidence,
    "rule_ip_checksum": _rule("ip_checksum_mismatch"), "rule_l4_checksum": _rule("l4_checksum_mismatch"),
    "rule_syn_fin": _rule("tcp_syn_fin_violation"), "rule_syn_payload": _rule("tcp_syn_with_payload"),
    "rule_syn_rst": _rule("tcp_syn_rst_violation"), "rule_dns": _rule("dns_payload_anomalous"),
    "rule_port_protocol": _rule("port_protocol_mismatch"), "rule_ttl": _rule("ttl_inconsistency"),
    "inspect_flows": inspect_flows,
    "rca_port_scan": _verdicts("port_scan_reconnaissance", sentence="Source "),
    "rca_syn_flood": _verdicts("syn_flood_dos", sentence="Target "),
    "rca_flow_scan": _single_flow("port_scan_reconnaissance"), "rca_flow_flood": _single_flow("syn_flood_dos"),
    "rca_structural": rca_structural,
    "rca_model": _verdicts("model_flagged_anomaly", sentence="No structural rule"),
    "rca_benign": _verdicts("benign", sentence="No structural findings"),
    "rca_reasoning": rca_reasoning, "rca_contributing": rca_contributing,
    "diagnose_flows": diagnose_flows, "diagnose_captures": diagnose_captures,
    "diagnose_capture_files": diagnose_capture_files, "response_envelopes": response_envelopes,
    "text_report": text_report, "report_json": report_json_query,
}
