"""Queries over stored forms that spare later work: sketches, bucketed tables, as-of edges, reports as JSON."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import sketches as SK
from flowloom.operators.asof import asof_join
from flowloom.plans import catalog_wire as W
from flowloom.plans import diagnose as P
from flowloom.plans import fixtures as FX
from flowloom.session import materialize
from flowloom.sources.bucketed import flow_summaries, join_scores, store_bucketed
from flowloom.sources.reports import report_json

c = F.col
WINDOW = 900
BUCKETS = 8


def _sketched(key: list[str], pair: list[str]):
    """Sketches of short windows, united to longer ones and these to whole keys, against the exact numbers."""
    def query(spark, sf):
        packets = FX.wire_packets(spark, sf)
        stored = materialize(SK.context_sketches(packets, key, pair, F.floor(c("arrival") / WINDOW)), "sketches")
        longer = materialize(SK.roll_up(stored, key, F.floor(c("start") / 4)), "sketches")
        whole = SK.estimated(SK.roll_up(longer, key), "estimate")
        exact = packets.groupBy(*key).agg(F.count_distinct(*pair).alias("n_pairs"))
        bound = F.ceil(4 * SK.relative_error() * c("n_pairs"))
        return whole.join(exact, key).select(
            *key, "n_packets", F.round("syn_only_ratio", 6).alias("syn_only_ratio"), "n_pairs",
            (F.abs(c("estimate") - c("n_pairs")) <= bound).alias("within_bound"))
    return query


def asof_edges(spark, sf):
    """The size class of each document: the smallest edge of its source that is not below its length. Edges are the
    longest documents of all lengths, in steps of 500, that have two documents at least."""
    docs = FX.table(spark, sf, "documents").select("doc_id", "source", "n_chars")
    edges = (docs.groupBy("source", F.floor(c("n_chars") / 500)).agg(F.max("n_chars").alias("edge"), F.count(F.lit(1)).alias("n_class"))
             .filter("n_class >= 2").select("source", "edge", "n_class"))
    return asof_join(docs, edges, ["source"], "n_chars", "edge", ["n_class"], forward=True)


def bucketed_score_join(spark, sf):
    packets = materialize(FX.wire_packets(spark, sf), "wire")
    # Some scores name a flow that was never captured.
    scores = FX.wire_scores(packets).withColumn(
        "proto", F.when(F.round(c("score") * 20000).cast("int") % 7 == 0, c("proto") + 100).otherwise(c("proto")))
    joined = join_scores(flow_summaries(packets, BUCKETS), store_bucketed(scores, "scores", S.FLOW_KEY, BUCKETS))
    return joined.filter(c("anomaly_score").isNotNull()).select(
        P.key_text().alias("flow"), F.round("anomaly_score", 6).alias("score"),
        F.coalesce("n_packets", F.lit(0)).cast("bigint").alias("n_records"))


def report_json_fields(spark, sf):
    """What a reader of the JSON reports finds in them."""
    def field(path: str):
        return F.get_json_object("json", path)

    codes = F.transform(F.from_json(field("$.mismatch_findings"), "array<struct<code:string>>"), lambda f: f["code"])
    return report_json(W._reports(spark, sf)).select(
        field("$.flow").alias("flow"), field("$.packets").cast("bigint").alias("packets"),
        F.round(field("$.anomaly_score").cast("double"), 6).alias("anomaly_score"), (field("$.anomaly") == "true").alias("anomaly"),
        field("$.root_cause.tag").alias("tag"), field("$.root_cause.label").alias("label"),
        F.array_join(codes, ",").alias("finding_codes"),
        F.array_join(F.from_json(field("$.suggested_actions"), "array<string>"), " | ").alias("actions"))


QUERIES = {
    "sketch_source_contexts": _sketched(["src"], ["dst", "dport"]),
    "sketch_target_contexts": _sketched(["dst", "dport"], ["src", "sport"]),
    "asof_edges": asof_edges, "bucketed_score_join": bucketed_score_join, "report_json_fields": report_json_fields,
}
