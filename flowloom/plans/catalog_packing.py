"""Queries over flow sizes, labels and scores: splits, packing, metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import assemble as A
from flowloom.operators import metrics as M
from flowloom.operators import prepare as B
from flowloom.operators import verdicts as V
from flowloom.plans import fixtures as FX
from flowloom.session import materialize

Query = Callable[[SparkSession, str], DataFrame]
c = F.col
KEY = ["flow_id"]
EDGES = [2, 4, 8, 16]


def _stored(spark: SparkSession, sf: str) -> DataFrame:
    """The flow sizes as a stored table, for plans that read them several times."""
    return materialize(FX.flow_counts(spark, sf), "flow-counts")


# --- splits, batches, weights ---------------------------------------------------------

def train_val_split(spark, sf):
    return B.train_val_split(_stored(spark, sf), KEY).select("flow_id", "is_train")


def split_check(spark, sf):
    flows = _stored(spark, sf)
    return B.split_check(B.train_val_split(flows, KEY), flows, KEY)


def assign_batches(spark, sf):
    flows = _stored(spark, sf)
    return B.assign_batches(flows, KEY, 256, seed=3, drop_last=False).select(
        "flow_id", "batch_id", "slot_in_batch", B.task_label("class").cast("bigint").alias("label"))


def ordered_batches(spark, sf):
    flows = _stored(spark, sf)
    return B.assign_batches(flows, KEY, 256, shuffle=False, drop_last=False).select(
        "flow_id", "batch_id", "slot_in_batch")


def full_batches(spark, sf):
    flows = _stored(spark, sf)
    return B.assign_batches(flows, KEY, 256, seed=3).groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_flows"))


def class_weights(spark, sf):
    return B.class_weights(_stored(spark, sf), "label_cls", 12).withColumn("weight", F.round("weight", 6))


def example_weights(spark, sf):
    flows = _stored(spark, sf)
    return B.example_weights(flows, "label_bin", B.class_weights(flows, "label_bin", 2)).select(
        "flow_id", "label_bin", F.round("weight", 6).alias("weight"))


# --- packing --------------------------------------------------------------------------

def packet_histogram(spark, sf):
    return B.packet_histogram(FX.flow_counts(spark, sf))


def optimal_buckets(spark, sf):
    edges = B.optimal_buckets(FX.flow_counts(spark, sf), 4)
    return B.packet_histogram(FX.flow_counts(spark, sf)).select(
        F.explode(F.array(*[F.lit(e) for e in edges])).alias("edge")).distinct()


def bucket_assign(spark, sf):
    return FX.flow_counts(spark, sf).select("flow_id", "n", B.bucket_of(c("n"), EDGES).alias("edge"))


def bucket_batches(spark, sf):
    return B.pack_bucketed(FX.flow_counts(spark, sf), KEY, EDGES, 64, seed=1).select("flow_id", "edge", "batch_no")


def pack_bucketed(spark, sf):
    flows = _stored(spark, sf)
    packed = B.pack_bucketed(flows, KEY, B.optimal_buckets(flows, 4), 64)
    return packed.groupBy("edge", "batch_no").agg(F.count(F.lit(1)).alias("n_flows"), F.sum("n").alias("n_packets"))


def pack_ffd(spark, sf):
    flows = _stored(spark, sf)
    packed = B.pack_ffd(flows, KEY, B.optimal_buckets(flows, 4), 64, 256)
    return packed.select("flow_id", "n", "bin", "edge")


def pack_coverage(spark, sf):
    flows = _stored(spark, sf)
    return B.pack_coverage(flows, B.pack(flows, KEY, "ffd", token_budget=256), KEY)


def trim_flows(spark, sf):
    flows = A.assemble_flows(FX.one_source(FX.payload_packets(spark, sf)))
    packed = B.pack(flows, KEY, edges=[4, 16], n="npkts")
    return B.trim_flows(packed).select("flow_id", "edge", "npkts", F.size("packets").alias("n_kept"),
                                       F.aggregate("packets", F.lit(0), lambda a, p: a + p["length"]).alias("n_bytes"))


def padding_report(spark, sf):
    return B.padding_report(FX.flow_counts(spark, sf))


def padding_report_ffd(spark, sf):
    return B.padding_report(FX.flow_counts(spark, sf), "ffd", token_budget=256)


# --- metrics --------------------------------------------------------------------------

def _predictions(spark: SparkSession, sf: str) -> DataFrame:
    return FX.class_logits(spark, sf).withColumn("pred", M.argmax(c("logits")))


def accuracy(spark, sf):
    return M.accuracy(_predictions(spark, sf)).withColumn("accuracy", F.round("accuracy", 6))


def macro_f1(spark, sf):
    return M.macro_f1(_predictions(spark, sf), 12).withColumn("macro_f1", F.round("macro_f1", 6))


def class_recall(spark, sf):
    return M.class_scores(_predictions(spark, sf), 10).select(
        "class_id", "tp", "fp", "fn", F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def roc_auc(spark, sf):
    return M.roc_auc(FX.scored_flows(spark, sf)).withColumn("auc", F.round("auc", 9))


def average_ranks(spark, sf):
    return M.average_ranks(FX.scored_flows(spark, sf), KEY).select("flow_id", "avg_rank")


def score_spread(spark, sf):
    return M.score_spread(FX.scored_flows(spark, sf)).withColumns(
        {x: F.round(x, 6) for x in ("score_p05", "score_p95")})


def score_summary(spark, sf):
    return M.score_summary(FX.capture_scores(spark, sf)).withColumns(
        {x: F.round(x, 6) for x in ("min_score", "median_score", "max_score")})


def anomaly_flag(spark, sf):
    return FX.scored_flows(spark, sf).select("flow_id", "score", V.anomaly_flag(c("score")).alias("anomaly"))


def softmax(spark, sf):
    return FX.class_logits(spark, sf).select(
        "vec_id", F.posexplode(M.softmax(c("logits"))).alias("class_id", "p")).withColumn("p", F.round("p", 6))


def weighted_loss(spark, sf):
    examples = FX.class_logits(spark, sf)
    weighted = B.example_weights(examples, "label", B.class_weights(examples, "label", 10))
    plain = M.weighted_loss(examples).select(F.round("loss", 6)).scalar()
    return M.weighted_loss(weighted, "weight").select(F.round("loss", 6).alias("weighted"), plain.alias("plain"))


def evaluate(spark, sf):
    examples = FX.scored_flows(spark, sf).select(F.array(1 - c("score"), c("score")).alias("logits"), "label")
    return M.evaluate(examples, 2).withColumns(
        {x: F.round(x, 6) for x in ("accuracy", "macro_f1", "auc", "score_p05", "score_p95")})


def evaluate_classes(spark, sf):
    return M.evaluate(FX.class_logits(spark, sf), 10, "class").withColumns(
        {x: F.round(x, 6) for x in ("accuracy", "macro_f1")})


def majority_baseline(spark, sf):
    return M.majority_baseline(FX.flow_counts(spark, sf).select(c("label_cls").alias("label"))).withColumn(
        "accuracy", F.round("accuracy", 6))


def best_epoch(spark, sf):
    """Hours of the event stream as epochs of one run per event type."""
    epochs = (FX.table(spark, sf, "events").groupBy("event_type", F.floor(c("event_id") / 100).cast("bigint").alias("epoch"))
              .agg((F.sum((c("value") * 100).cast("bigint")) / 1e7).alias("raw"), (F.count(F.lit(1)) / 100).alias("macro_f1")))
    auc = (F.when(c("epoch") % 5 == 0, F.lit(None)).when(c("epoch") % 7 == 0, F.lit(float("nan")))
           .when(c("epoch") % 11 == 0, 0.0).otherwise(c("raw")))
    return M.best_epoch(epochs.withColumn("auc", auc), ["event_type"]).select(
        "event_type", "epoch", F.round("figure", 9).alias("figure"), "is_best")


QUERIES: dict[str, Query] = {f.__name__: f for f in (
    train_val_split, split_check, assign_batches, ordered_batches, full_batches, class_weights, example_weights,
    packet_histogram, optimal_buckets, bucket_assign, bucket_batches, pack_bucketed, pack_ffd, pack_coverage,
    trim_flows, padding_report, padding_report_ffd, accuracy, macro_f1, class_recall, roc_auc, average_ranks,
    score_spread, score_summary, anomaly_flag, softmax, weighted_loss, evaluate, evaluate_classes, majority_baseline, best_epoch)}
