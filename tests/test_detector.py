import random

import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import assemble as A
from flowloom.operators import detector as D
from flowloom.operators import metrics as M
from flowloom.operators import prepare as B
from flowloom.session import materialize, scratch_path
from flowloom.sources import labelled as L


@pytest.fixture(scope="module")
def flows(spark):
    """Attacks carry DE AD BE EF somewhere in otherwise random bytes."""
    rng = random.Random(3)
    rows = []
    for f in range(160):
        attack = f % 4 == 0
        for p in range(3):
            body = bytes(rng.randrange(256) for _ in range(40)) + (b"\xde\xad\xbe\xef" * 4 if attack else b"")
            rows.append(("s", f, p, 40000, 80, "tcp", len(body), "exploits" if attack else "normal", bytearray(body)))
    ddl = ("source_file STRING, flow_id BIGINT, packet_id BIGINT, source_port INT, destination_port INT, "
           "protocol STRING, payload_length INT, attack_label STRING, payload BINARY")
    return materialize(A.assemble_flows(spark.createDataFrame(rows, ddl)), "t-detector")


def test_features_count_every_byte(flows):
    total = D.token_counts(flows, ["flow_id"]).groupBy("flow_id").agg(F.sum("n").alias("n"))
    want = flows.select("flow_id", F.aggregate("packets", F.lit(0), lambda a, p: a + p["length"]).cast("bigint").alias("n"))
    assert total.exceptAll(want).isEmpty() and want.exceptAll(total).isEmpty()


def test_planted_bytes_are_found_and_the_model_reloads(spark, flows):
    split = B.train_val_split(flows, S.SHARD_KEY, 0.25)
    train, val = split.filter("is_train"), split.filter("NOT is_train")
    model = D.train_detector(train, weights=B.class_weights(train, "label_bin", 2))
    assert M.evaluate(D.predict_logits(model, val), 2).first()["auc"] > 0.9
    path = scratch_path(spark, "t-model")
    model.write().save(path)
    a = D.score_flows(model, val, S.SHARD_KEY)
    b = D.score_flows(PipelineModel.load(path), val, S.SHARD_KEY)
    assert a.exceptAll(b).isEmpty() and a.filter("score < 0 OR score > 1").isEmpty()


def test_own_scorer(flows):
    got = D.score_with(flows.select("flow_id", "npkts"), ["flow_id"], lambda batch: batch["npkts"] / 16)
    assert {r["score"] for r in got.collect()} == {3 / 16}


def test_labelled_csv(spark):
    path = scratch_path(spark, "t-csv")
    spark.createDataFrame([("udp", "3", "2", 0), ("tcp", "30", "0", 1), ("tcp", "", "0", 0)],
                          "proto STRING, SPKTS STRING, dpkts STRING, label INT").coalesce(1).write.option("header", True).csv(path)
    test = scratch_path(spark, "t-csv")
    spark.createDataFrame([("xyz", "1", "1", 1), ("udp", "1", "1", 1)],
                          "proto STRING, SPKTS STRING, dpkts STRING, label INT").write.option("header", True).csv(test)
    train, held, dictionary = L.read_labelled_flows(spark, path, test)
    assert [(r["proto"], r["proto_id"]) for r in dictionary.orderBy("proto_id").collect()] == [("tcp", 0), ("udp", 1)]
    assert L.proto_vocab(dictionary).first()[0] == 3
    rows = L.with_proxy_packets(train).collect()
    assert sorted((r["proto_id"], r["npkts"], r["label"], len(r["packets"])) for r in rows) == [
        (0, 1, 0, 1), (0, 16, 1, 16), (1, 5, 0, 5)]
    assert all(r["headers"] == [r["proto_id"], 1, 1, r["npkts"], 0] for r in rows)
    # Ids come from the training table; an unseen protocol gets the next one.
    assert sorted(r["proto_id"] for r in held.collect()) == [1, 2]


def test_training_tasks_of_the_probe_follow_the_rows(spark, monkeypatch):
    """With a task per core a task's cached rows grew with the table."""
    rows = spark.range(5000).select((F.col("id") % 2).cast("int").alias("label"), (F.col("id") % 2 + F.col("id") % 3).alias("a"),
                                    (F.col("id") % 7).alias("b")).repartition(8)
    largest = []

    class Seen(D.Pipeline):
        def fit(self, dataset, params=None):
            largest.append(dataset.groupBy(F.spark_partition_id()).count().agg(F.max("count")).first()[0])
            return super().fit(dataset, params)

    monkeypatch.setattr(D, "Pipeline", Seen)
    as_is = D.ceiling_probe(rows, rows, ["a", "b"], ["b"], max_iter=2).collect()
    monkeypatch.setattr(D, "TRAIN_ROWS", 100)
    spread = D.ceiling_probe(rows, rows, ["a", "b"], ["b"], max_iter=2).collect()
    assert min(largest[:2]) >= 600 and max(largest[2:]) <= 100 + 8
    assert sorted(spread) == sorted(as_is) and spread[0]["n"] == 5000
