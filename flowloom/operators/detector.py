"""A Spark ML detector over flow bytes and headers: features, training, scoring."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, Normalizer, OneHotEncoder, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.functions.tokens import byte_values
from flowloom.operators import metrics as M
from flowloom.operators import prepare as B
from flowloom.operators.flows import assemble_capture_flows


def with_byte_tokens(flows: DataFrame) -> DataFrame:
    """Add ``byte_tokens``, the token texts of all kept payload bytes, and ``byte_fill``,
    the used share of the 16 x 128 payload."""
    tokens = F.flatten(F.transform("packets", lambda p: F.transform(
        byte_values(p["payload"]), lambda b: (b + S.BYTE_OFFSET).cast("string"))))
    return (flows.withColumn("byte_tokens", tokens)
            .withColumn("byte_fill", F.size("byte_tokens") / (S.MAX_PACKETS_PER_FLOW * S.PAYLOAD_MAX_LEN)))


def token_counter(session_flows: DataFrame, output: str = "byte_counts") -> CountVectorizerModel:
    """Counts over the fixed token vocabulary; nothing to fit."""
    return CountVectorizerModel.from_vocabulary(
        [str(t) for t in range(S.BYTE_VOCAB)], inputCol="byte_tokens", outputCol=output)


def flow_features(flows: DataFrame) -> DataFrame:
    """``byte_counts``: a 259-wide histogram of the tokens of each flow."""
    tokened = with_byte_tokens(flows)
    return token_counter(tokened).transform(tokened).drop("byte_tokens")


def token_counts(flows: DataFrame, keys: list[str]) -> DataFrame:
    """The histogram as (keys, token, n) rows, zero counts left out."""
    return (flow_features(flows)
            .select(*keys, F.posexplode(vector_to_array("byte_counts")).alias("token", "n"))
            .filter("n > 0").withColumn("n", F.col("n").cast("bigint")))


def detector_pipeline(flows: DataFrame, classifier: LogisticRegression | GBTClassifier) -> Pipeline:
    """Byte frequencies, one-hot protocol and port buckets, packet count, then the classifier."""
    codes = ["proto_id", "sport_bucket", "dport_bucket"]
    hot = [f"{c}_hot" for c in codes]
    return Pipeline(stages=[
        token_counter(flows),
        Normalizer(p=1.0, inputCol="byte_counts", outputCol="byte_freq"),
        OneHotEncoder(inputCols=codes, outputCols=hot, dropLast=False, handleInvalid="keep"),
        VectorAssembler(inputCols=["byte_freq", *hot, "npkts", "byte_fill"], outputCol="features"),
        classifier])


def train_detector(flows: DataFrame, task: str = "anomaly", weights: DataFrame | None = None,
                   classifier: LogisticRegression | GBTClassifier | None = None) -> PipelineModel:
    """Fit a binary (``anomaly``) or ten-way (``class``) detector on a flow table.

    ``weights`` is a (label, weight) table; without it every class counts as it occurs.
    Save and load the result as any ``PipelineModel``.
    """
    data = with_byte_tokens(flows).withColumn("label", B.task_label(task).cast("int"))
    classifier = classifier or LogisticRegression(maxIter=25, regParam=1e-3,
                                                  family="binomial" if task == "anomaly" else "multinomial")
    if weights is not None:
        data = B.example_weights(data, "label", weights)
        classifier = classifier.copy().setWeightCol("weight")
    data = data.withColumn("label", F.col("label").cast("double"))
    return detector_pipeline(data, classifier).fit(data)


def score_flows(model: PipelineModel, flows: DataFrame, keys: list[str]) -> DataFrame:
    """P(anomaly) per flow; the model travels to the executors once per task, not per call."""
    scored = model.transform(with_byte_tokens(flows))
    return scored.select(*keys, vector_to_array("probability")[1].alias("score"))


def score_captures(model: PipelineModel, packets: DataFrame) -> DataFrame:
    """Scores for every flow of a packet table, keyed as the reports need them."""
    return score_flows(model, assemble_capture_flows(packets), S.FLOW_KEY)


def predict_logits(model: PipelineModel, flows: DataFrame, task: str = "anomaly") -> DataFrame:
    """(logits, label) rows for ``metrics.evaluate``."""
    scored = model.transform(with_byte_tokens(flows))
    return scored.select(vector_to_array("rawPrediction").alias("logits"), B.task_label(task).alias("label"))


def score_with(flows: DataFrame, keys: list[str], scorer: Callable[[pd.DataFrame], pd.Series]) -> DataFrame:
    """Scores from a caller's function over Arrow batches of flow rows."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in flows.select(*keys).schema)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch[keys].assign(score=scorer(batch).astype("float64"))

    return flows.mapInPandas(run, f"{fields}, score DOUBLE")


# Rows of a training task: trees keep the task's rows in memory as objects and read them again in every pass.
TRAIN_ROWS = 250_000


def spread_rows(rows: DataFrame) -> DataFrame:
    """The rows in tasks of ``TRAIN_ROWS`` at most, a number of them that fills the cores, where one task per core would
    get more; else as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    turns = -(-rows.count() // (TRAIN_ROWS * cores))
    return rows.repartition(turns * cores) if turns > 1 else rows


def ceiling_probe(train: DataFrame, test: DataFrame, features: list[str], few: list[str],
                  max_iter: int = 10) -> DataFrame:
    """How much the features can tell: trees on all of them, on few, and the majority class."""
    train = spread_rows(train)
    out = []
    for name, columns in (("all_features", features), ("few_features", few)):
        model = Pipeline(stages=[
            VectorAssembler(inputCols=columns, outputCol="features"),
            GBTClassifier(maxIter=max_iter, maxDepth=4, seed=0)]).fit(train)
        predicted = model.transform(test).select(F.col("prediction").cast("int").alias("pred"), "label")
        out.append(M.accuracy(predicted).select(
            F.lit(name).alias("probe"), "accuracy", M.macro_f1(predicted, 2).scalar().alias("macro_f1"), "n"))
    base = M.majority_baseline(test)
    out.append(base.select(F.lit("majority").alias("probe"), "accuracy",
                           F.lit(None).cast("double").alias("macro_f1"), "n"))
    return out[0].unionByName(out[1]).unionByName(out[2])
