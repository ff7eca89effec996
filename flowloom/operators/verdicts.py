"""Root cause, reasoning, actions and report rows, from one row per flow."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.dimensions import (
    ACTIONS, CAUSE_LABELS, CODE_TO_CAUSE, DEFAULT_ACTION_TAG, SEVERITY_RANK, literal_map, lookup)
from flowloom.functions.text import fill, fixed, percent


@dataclass(frozen=True)
class Limits:
    """Rule thresholds; the defaults are fixed values. The anomaly threshold may be a column."""

    anomaly_threshold: float | Column = 0.5
    port_scan_min_ports: int = 8
    syn_flood_min_packets: int = 10
    syn_flood_min_sources: int = 8
    syn_flood_min_ratio: float = 0.8


# One sentence per verdict.
REASONS = {
    "scan": "Source {} touched {} distinct destination ports across the capture (>= {}) => reconnaissance / port-scan pattern.",
    "flood": "Target received {} packets from {} distinct source (ip, port) pairs, {} bare-SYN with no completed handshake => SYN-flood / connection-exhaustion pattern.",
    "flow_scan": "{} distinct destination ports probed from a single source within one flow window (>= {}) => reconnaissance / port-scan pattern.",
    "flow_flood": "{} packets, {} distinct source ports, {} bare-SYN with no completed handshake => SYN-flood / connection-exhaustion pattern.",
    "structural": "{} structural finding(s) map to '{}': {}",
    "model": "No structural rule matched, but the model's P(anomaly) = {} >= threshold {}; flagging for manual review — this is the model's learned judgement, not a rule.",
    "benign": "No structural findings and P(anomaly) = {} is below threshold {}.",
}


def _cause(code: Column) -> Column:
    return lookup(CODE_TO_CAUSE, code)


def with_top_finding(flows: DataFrame) -> DataFrame:
    """Add ``top`` (cause, severity rank, supporting count) of the strongest known finding.

    Highest severity first, then the cause named most often, then the earliest.
    """
    ranked = F.transform("findings", lambda f, i: F.struct(
        F.coalesce(lookup(SEVERITY_RANK, f["severity"]), F.lit(0)).alias("severity_rank"),
        F.size(F.filter("findings", lambda g: _cause(g["code"]) == _cause(f["code"]))).alias("supporting"),
        (-i).alias("earliest"), _cause(f["code"]).alias("cause")))
    return flows.withColumn("top", F.array_max(F.filter(ranked, lambda r: r["cause"].isNotNull())))


def with_root_cause(flows: DataFrame, limits: Limits = Limits(), labels: dict[str, str] | None = None) -> DataFrame:
    """Add ``root_cause``, the first verdict of the ladder that applies.

    Needs the flow statistics, ``findings``, ``anomaly_score`` and the context columns
    ``src_ports`` / ``dst_sources``, ``dst_packets``, ``dst_ratio`` (null: no context).
    """
    c = F.col
    score = c("anomaly_score")
    stats = F.coalesce(c("n_packets"), F.lit(0))
    flows = with_top_finding(flows)
    supporting = F.filter("findings", lambda f: _cause(f["code"]) == c("top")["cause"])
    codes = F.transform("findings", lambda f: f["code"])
    label_map = literal_map(labels or CAUSE_LABELS)
    threshold = F.lit(limits.anomaly_threshold).cast("double")

    def scan(ports: Column) -> Column:
        return F.least(F.lit(0.95), F.lit(0.5) + F.lit(0.05) * ports)

    def flood(ratio: Column) -> Column:
        return F.least(F.lit(0.95), F.lit(0.6) + F.lit(0.3) * ratio)

    def verdict(tag: Column, confidence: Column, reason: Column, contributing: Column) -> Column:
        return F.struct(tag.alias("tag"), F.try_element_at(label_map, tag).alias("label"),
                        confidence.cast("double").alias("confidence"),
                        F.array(reason).alias("reasoning"),
                        contributing.alias("contributing_findings"))

    none = F.array().cast("array<string>")
    quoted = F.array_join(F.transform(F.slice(supporting, 1, 3), lambda f: f["message"]), "; ")
    structural = fill(REASONS["structural"], F.size(supporting),
                      F.try_element_at(label_map, c("top")["cause"]), quoted)
    cause = (
        F.when(c("src_ports") >= limits.port_scan_min_ports,
               verdict(F.lit("port_scan_reconnaissance"), scan(c("src_ports")),
                       fill(REASONS["scan"], F.coalesce(c("first")["src"], F.lit("this host")), c("src_ports"),
                            F.lit(limits.port_scan_min_ports)), codes))
        .when((c("dst_sources") >= limits.syn_flood_min_sources)
              & (c("dst_packets") >= limits.syn_flood_min_packets)
              & (c("dst_ratio") >= limits.syn_flood_min_ratio),
              verdict(F.lit("syn_flood_dos"), flood(c("dst_ratio")),
                      fill(REASONS["flood"], c("dst_packets"), c("dst_sources"), percent(c("dst_ratio"))), codes))
        .when((c("n_distinct_dst_ports") >= limits.port_scan_min_ports)
              & (stats >= limits.port_scan_min_ports),
              verdict(F.lit("port_scan_reconnaissance"), scan(c("n_distinct_dst_ports")),
                      fill(REASONS["flow_scan"], c("n_distinct_dst_ports"), F.lit(limits.port_scan_min_ports)),
                      codes))
        .when((stats >= limits.syn_flood_min_packets)
              & (c("n_distinct_src_ports") >= limits.syn_flood_min_packets * 0.8)
              & (c("syn_only_ratio") >= limits.syn_flood_min_ratio),
              verdict(F.lit("syn_flood_dos"), flood(c("syn_only_ratio")),
                      fill(REASONS["flow_flood"], stats, c("n_distinct_src_ports"), percent(c("syn_only_ratio"))),
                      codes))
        .when(c("top").isNotNull(),
              verdict(c("top")["cause"],
                      F.least(F.lit(0.97), F.lit(0.5) + F.lit(0.12) * F.size(supporting)
                              + F.lit(0.1) * c("top")["severity_rank"]),
                      structural, F.transform(supporting, lambda f: f["code"])))
        .when(score >= threshold,
              verdict(F.lit("model_flagged_anomaly"), score,
                      fill(REASONS["model"], fixed(score, 3), fixed(threshold, 2)), none))
        .otherwise(verdict(F.lit("benign"), F.lit(1.0) - score,
                           fill(REASONS["benign"], fixed(score, 3), fixed(threshold, 2)), none)))
    return flows.withColumn("root_cause", cause).drop("top")


def suggest_actions(tag: Column, actions: dict[str, list[str]] | None = None) -> Column:
    """Ordered actions of a cause; an unknown cause gets the default row."""
    actions = actions or ACTIONS
    table = F.create_map(*[x for tag_, texts in actions.items()
                           for x in (F.lit(tag_), F.array(*[F.lit(t) for t in texts]))])
    return F.coalesce(F.try_element_at(table, tag), F.try_element_at(table, F.lit(DEFAULT_ACTION_TAG)))


def suggest_actions_from(causes: DataFrame, table: DataFrame) -> DataFrame:
    """The same with an editable (tag, actions) table, joined by tag."""
    fallback = table.filter(F.col("tag") == DEFAULT_ACTION_TAG).select("actions").scalar()
    # The table has one row per cause, ten in all.
    return (causes.join(F.broadcast(table), "tag", "left")
            .withColumn("actions", F.coalesce("actions", fallback)))


def anomaly_flag(score: Column, threshold: float | Column = 0.5) -> Column:
    """Strictly above the threshold; the verdict ladder uses ``>=`` instead."""
    return score > F.lit(threshold).cast("double")
