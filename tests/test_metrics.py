import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowloom.operators import metrics as M


def brute_auc(scores, labels):
    pos = [s for s, y in zip(scores, labels) if y]
    neg = [s for s, y in zip(scores, labels) if not y]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


@pytest.fixture(scope="module")
def scored():
    rng = random.Random(1)
    # A third of all rows share one score.
    return [(i, 0.5 if i % 3 == 0 else rng.randrange(40) / 40, int(rng.random() < 0.3)) for i in range(600)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "id INT, score DOUBLE, label INT")


def test_auc_with_ties(spark, scored):
    want = brute_auc([s for _, s, _ in scored], [y for *_, y in scored])
    assert M.roc_auc(frame(spark, scored)).first()["auc"] == pytest.approx(want, abs=1e-12)
    assert math.isnan(M.roc_auc(frame(spark, [(1, 0.2, 1), (2, 0.3, 1)])).first()["auc"])
    assert M.roc_auc(frame(spark, [(1, 0.2, 0), (2, 0.3, 1)])).first()["auc"] == 1.0


def test_average_ranks(spark, scored):
    got = {r["id"]: r["avg_rank"] for r in M.average_ranks(frame(spark, scored), ["id"]).collect()}
    values = np.array([s for _, s, _ in scored])
    for i, s, _ in scored:
        assert got[i] == (values < s).sum() + ((values == s).sum() + 1) / 2


def test_percentiles_match_numpy(spark, scored):
    values = [s for _, s, _ in scored]
    row = M.score_spread(frame(spark, scored)).first()
    assert row["score_p05"] == pytest.approx(np.percentile(values, 5)) and row["score_p95"] == pytest.approx(np.percentile(values, 95))
    rows = frame(spark, scored).withColumn("capture", (F.col("id") % 7).cast("string"))
    for r in M.score_summary(rows).collect():
        mine = [s for i, s, _ in scored if str(i % 7) == r["capture"]]
        assert (r["min_score"], r["max_score"], r["n_flows"]) == (min(mine), max(mine), len(mine))
        assert r["median_score"] == pytest.approx(np.median(mine)) and r["n_flagged"] == sum(s > 0.5 for s in mine)


def test_macro_f1_counts_absent_classes(spark):
    rows = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 0)], "label INT, pred INT")
    # f1: 0 -> 2/4, 1 -> 2/3, 2 -> 0, 3 absent
    assert M.macro_f1(rows, 4).first()[0] == pytest.approx((0.5 + 2 / 3) / 4)
    recall = {r["class_id"]: r["recall"] for r in M.class_scores(rows, 4).collect()}
    assert recall == {0: 0.5, 1: 1.0, 2: 0.0, 3: None}


def test_softmax_loss_and_argmax(spark):
    rows = spark.createDataFrame([([1.0, 1.0, -1000.0], 0, 2.0), ([1000.0, 0.0, 0.0], 1, 1.0)], "logits ARRAY<DOUBLE>, label INT, w DOUBLE")
    got = rows.select(M.softmax(F.col("logits")).alias("p"), M.argmax(F.col("logits")).alias("a")).collect()
    assert got[0]["p"] == pytest.approx([0.5, 0.5, 0.0]) and [r["a"] for r in got] == [0, 0]
    assert M.weighted_loss(rows).first()[0] == pytest.approx((math.log(2) + 1000) / 2)
    assert M.weighted_loss(rows, "w").first()[0] == pytest.approx((2 * math.log(2) + 1000) / 3)
    none = rows.withColumn("w", F.lit(0.0))
    assert M.weighted_loss(none, "w").first()[0] == 0.0


def test_evaluate_row(spark, scored):
    rows = frame(spark, scored).select(F.array(1 - F.col("score"), F.col("score")).alias("logits"), "label")
    r = M.evaluate(rows, 2).first()
    assert r["auc"] == pytest.approx(brute_auc([s for _, s, _ in scored], [y for *_, y in scored]))
    assert r["n"] == 600 and set(M.evaluate(rows, 2, "class").columns) == {"accuracy", "n", "macro_f1"}


def test_best_epoch(spark):
    rows = [(1, 0.5, 0.1), (2, 0.5, 0.1), (3, 0.0, 0.6), (4, float("nan"), 0.55), (5, None, 0.7), (6, 0.65, 0.9)]
    got = M.best_epoch(spark.createDataFrame(rows, "epoch INT, auc DOUBLE, macro_f1 DOUBLE")).orderBy("epoch").collect()
    assert [(r["figure"], r["is_best"]) for r in got] == [
        (0.5, True), (0.5, False), (0.6, True), (0.55, False), (0.7, True), (0.65, False)]


def test_majority(spark):
    row = M.majority_baseline(spark.createDataFrame([(1,), (1,), (0,), (0,), (2,)], "label INT")).first()
    assert (row["label"], row["accuracy"], row["n"]) == (0, 0.4, 5)
