"""Whole jobs over a packet table: plain scores, full reports, envelopes, text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions.text import fixed, flow_key
from flowloom.operators import contexts as X
from flowloom.operators import flows as A
from flowloom.operators import rules as R
from flowloom.operators import verdicts as V
from flowloom.operators.lookups import lookup_join
from flowloom.operators.ranks import first_few
from flowloom.session import materialize
from flowloom.sources.captures import read_captures


def key_text() -> Column:
    return flow_key(*[F.col(n) for n in ("src", "sport", "dst", "dport", "proto")])


def plain_scores(packets: DataFrame, scores: DataFrame, threshold: float = 0.5) -> DataFrame:
    """flow, score, anomaly, packets: the shape without diagnosis. ``scores``: FLOW_KEY + score."""
    return (scores.join(A.packet_counts(packets), S.FLOW_KEY)
            .select("capture", key_text().alias("flow"), F.col("score").cast("double").alias("score"),
                    V.anomaly_flag(F.col("score"), threshold).alias("anomaly"), "packets"))


def attach_contexts(flows: DataFrame, limits: V.Limits = V.Limits()) -> DataFrame:
    """Join both contexts to the scored flows.

    A source below the scan limit, or a target below any flood limit, cannot change a
    report, so those context rows stay out of the shuffle joins. ``flows`` is read
    several times: pass a stored table. The contexts are stored too, since the join
    reads its small side for the total, the heavy and the light keys.
    """
    seen = flows.filter(F.col("n_packets") > 0)
    by_src = materialize(X.aggregate_by_src(seen).select(
        *S.SRC_KEY, F.col("n_distinct_dst_ports").alias("src_ports"), F.col("n_flows").alias("_w")), "by-src")
    by_dst = materialize(X.aggregate_by_dst(seen).select(
        *S.DST_KEY, F.col("n_distinct_sources").alias("dst_sources"), F.col("n_packets").alias("dst_packets"),
        F.col("syn_only_ratio").alias("dst_ratio"), F.col("n_flows").alias("_w")), "by-dst")
    spread = ["src", "sport", "dst", "dport"]
    scored = flows.filter(F.col("anomaly_score").isNotNull())
    out = lookup_join(scored, by_src, S.SRC_KEY, "_w", spread,
                      relevant=F.col("src_ports") >= limits.port_scan_min_ports)
    return lookup_join(out, by_dst, S.DST_KEY, "_w", spread,
                       relevant=(F.col("dst_sources") >= limits.syn_flood_min_sources)
                       & (F.col("dst_packets") >= limits.syn_flood_min_packets)
                       & (F.col("dst_ratio") >= limits.syn_flood_min_ratio))


def without_contexts(flows: DataFrame) -> DataFrame:
    """Flows judged in isolation."""
    return (flows.withColumn("src_ports", F.lit(None).cast("bigint"))
            .withColumn("dst_sources", F.lit(None).cast("bigint"))
            .withColumn("dst_packets", F.lit(None).cast("bigint"))
            .withColumn("dst_ratio", F.lit(None).cast("double")))


def report_rows(flows: DataFrame, limits: V.Limits = V.Limits(),
                actions: dict[str, list[str]] | None = None, keep: list[str] | None = None) -> DataFrame:
    """The eight report fields, plus capture, first arrival for ordering, and ``keep``."""
    empty = F.array().cast(f"array<{S.FINDING.simpleString()}>")
    found = R.with_findings(flows).withColumn("findings", F.coalesce("findings", empty))
    judged = V.with_root_cause(found, limits)
    findings = F.col("findings")
    return judged.select(
        *(keep or []), "capture", F.col("first")["arrival"].alias("first_seen"),
        key_text().alias("flow"), "packets", "anomaly_score",
        V.anomaly_flag(F.col("anomaly_score"), limits.anomaly_threshold).alias("anomaly"),
        findings.alias("mismatch_findings"), (F.size(findings) > 0).alias("mismatch_detected"),
        "root_cause", V.suggest_actions(F.col("root_cause")["tag"], actions).alias("suggested_actions"))


def scored_flow_table(packets: DataFrame, scores: DataFrame,
                      max_packets: int = S.MAX_PACKETS_PER_FLOW, registry: dict | None = None) -> DataFrame:
    """Flow summaries with flagged packets, uncapped counts and scores.

    A score without packets keeps its row, with no records or findings. A flow without
    a score keeps its row too: it counts in the contexts but gets no report. Rule bits stay
    numbers here; ``report_rows`` writes the texts, behind all joins.
    """
    flows = A.summarize_flows(packets, max_packets=max_packets, registry=registry)
    counted = flows.join(A.packet_counts(packets), S.FLOW_KEY)
    scored = scores.select(*S.FLOW_KEY, F.col("score").cast("double").alias("anomaly_score"))
    return (scored.join(counted, S.FLOW_KEY, "full")
            .withColumn("packets", F.coalesce("packets", F.lit(0).cast("bigint"))))


def diagnose_flows(packets: DataFrame, scores: DataFrame, limits: V.Limits = V.Limits()) -> DataFrame:
    """Each flow judged on its own packets only."""
    flows = scored_flow_table(packets, scores).filter(F.col("anomaly_score").isNotNull())
    return report_rows(without_contexts(flows), limits)


def diagnose_captures(packets: DataFrame, scores: DataFrame, limits: V.Limits = V.Limits(),
                      registry: dict | None = None, actions: dict[str, list[str]] | None = None) -> DataFrame:
    """Reports for whole captures, with scan and flood contexts across their flows.

    The per-flow table is written once (it is a small fraction of the packets); both
    contexts and the reports read it from there.
    """
    flows = materialize(scored_flow_table(packets, scores, registry=registry), "flows")
    return report_rows(attach_contexts(flows, limits), limits, actions)


def diagnose_files(spark: SparkSession, path: str, scorer: Callable[[DataFrame], DataFrame],
                   limits: V.Limits = V.Limits(), merged: str | None = None) -> DataFrame:
    """Reports of all capture files under ``path``; a file that can't be read fails the job.

    Files are decoded once: ``scorer`` turns packets into FLOW_KEY and score, and scores, summaries and counts all
    read the stored packets. ``merged`` names one capture that all files are parts of, in order of time, as a
    recorder with a ring of files writes them; else each file is a capture.
    """
    packets = read_captures(spark, path)
    if merged is not None:
        packets = packets.withColumn("capture", F.lit(merged)).withColumn("arrival", F.col("ts_us"))
    packets = materialize(packets, "packets")
    return diagnose_captures(packets, scorer(packets), limits)


def cap_reports(reports: DataFrame, max_flows: int = 200) -> DataFrame:
    """First ``max_flows`` reports of each capture in first-seen order."""
    return first_few(reports, ["capture"], ["first_seen", "flow"], max_flows)


def envelope(reports: DataFrame, max_flows: int = 200, model: Column | None = None) -> DataFrame:
    """Per capture: model info, number of flows, truncated flag."""
    model = F.lit(None).cast("string") if model is None else model
    return (reports.groupBy("capture").agg(F.count(F.lit(1)).alias("n_flows"))
            .withColumn("truncated", F.col("n_flows") > max_flows)
            .withColumn("model", model))


def top_flows(reports: DataFrame, n: int = 10) -> DataFrame:
    """Highest scores; first seen wins ties."""
    return (reports.orderBy(F.desc("anomaly_score"), "first_seen", "capture", "flow").limit(n)
            .select("flow", "anomaly_score", F.col("root_cause")["label"].alias("cause")))


def cause_summary(reports: DataFrame) -> DataFrame:
    return reports.groupBy(F.col("root_cause")["tag"].alias("tag")).agg(F.count(F.lit(1)).alias("n_flows"))


def text_report(reports: DataFrame) -> DataFrame:
    """One multi-line text per flow."""
    c = F.col
    cause = c("root_cause")
    lines = F.concat(
        F.array(
            F.concat(F.when(c("anomaly"), "[ANOMALY]").otherwise("[NORMAL] "), F.lit(" score="),
                     fixed(c("anomaly_score"), 4), F.lit(" | "), c("flow"), F.lit(" | packets="),
                     c("packets").cast("string")),
            F.concat(F.lit("  root cause : "), cause["label"], F.lit(" (tag="), cause["tag"],
                     F.lit(", confidence="), fixed(cause["confidence"], 2), F.lit(")"))),
        F.transform(cause["reasoning"], lambda r: F.concat(F.lit("    reason   : "), r)),
        F.when(c("mismatch_detected"), F.concat(
            F.array(F.concat(F.lit("  mismatches : "), F.size("mismatch_findings").cast("string"),
                             F.lit(" finding(s)"))),
            F.transform("mismatch_findings", lambda f: F.concat(
                F.lit("    ["), f["severity"], F.lit("] "), f["code"], F.lit(": "), f["message"]))))
        .otherwise(F.array(F.lit("  mismatches : none"))),
        F.array(F.lit("  suggested actions:")),
        F.transform("suggested_actions", lambda a: F.concat(F.lit("    - "), a)))
    return reports.select("capture", "first_seen", "flow", F.array_join(lines, "\n").alias("text"))
