"""Ranking and classification metrics as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.operators.lookups import lookup_join
from flowloom.operators.ranks import running_sums
from flowloom.session import materialize


# --- row expressions ------------------------------------------------------------------

def argmax(logits: Column) -> Column:
    """0-based position of the largest logit; the first one wins ties."""
    return (F.array_position(logits, F.array_max(logits)) - 1).cast("int")


def softmax(logits: Column) -> Column:
    top = F.array_max(logits).cast("double")
    e = F.transform(logits, lambda x: F.exp(x.cast("double") - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def cross_entropy(logits: Column, label: Column) -> Column:
    """``log(sum(exp)) - logit of the label``, with the maximum taken out."""
    top = F.array_max(logits).cast("double")
    total = F.aggregate(F.transform(logits, lambda x: F.exp(x.cast("double") - top)), F.lit(0.0), lambda a, x: a + x)
    return F.log(total) + top - F.element_at(logits, label.cast("int") + 1).cast("double")


# --- classification -------------------------------------------------------------------

def accuracy(predictions: DataFrame) -> DataFrame:
    return predictions.agg(F.avg((F.col("pred") == F.col("label")).cast("double")).alias("accuracy"),
                           F.count(F.lit(1)).alias("n"))


def confusion(predictions: DataFrame) -> DataFrame:
    return predictions.groupBy("label", "pred").agg(F.count(F.lit(1)).alias("n"))


def class_scores(predictions: DataFrame, num_classes: int) -> DataFrame:
    """Per class true/false positives, false negatives, recall and F1; absent classes score 0."""
    cells = confusion(predictions)
    # Each cell counts for its label and for its prediction; num_classes rows come out.
    votes = cells.select(F.explode(F.array(
        F.struct(F.col("label").cast("int").alias("class_id"), F.when(F.col("label") == F.col("pred"), F.col("n")).otherwise(0).alias("tp"),
                 F.lit(0).cast("bigint").alias("fp"), F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fn")),
        F.struct(F.col("pred").cast("int").alias("class_id"), F.lit(0).cast("bigint").alias("tp"),
                 F.when(F.col("label") != F.col("pred"), F.col("n")).otherwise(0).alias("fp"), F.lit(0).cast("bigint").alias("fn"))
    )).alias("v")).select("v.*").groupBy("class_id").agg(*[F.sum(x).alias(x) for x in ("tp", "fp", "fn")])
    classes = predictions.sparkSession.range(num_classes).select(F.col("id").cast("int").alias("class_id"))
    full = classes.join(votes, "class_id", "left").fillna(0, ["tp", "fp", "fn"])
    denom = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    seen = F.col("tp") + F.col("fn")
    return (full.withColumn("f1", F.when(denom > 0, 2 * F.col("tp") / denom).otherwise(0.0))
            .withColumn("recall", F.when(seen > 0, F.col("tp") / seen)))


def macro_f1(predictions: DataFrame, num_classes: int) -> DataFrame:
    return class_scores(predictions, num_classes).agg(F.avg("f1").alias("macro_f1"))


def majority_baseline(labels: DataFrame) -> DataFrame:
    """Accuracy of always answering the most frequent label (the smallest on ties)."""
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    top = F.max_by("label", F.struct(F.col("n"), -F.col("label")))
    return counts.agg(top.alias("label"), (F.max("n") / F.sum("n")).alias("accuracy"), F.sum("n").alias("n"))


def weighted_loss(examples: DataFrame, weight: str | None = None) -> DataFrame:
    """Mean cross-entropy, or ``sum(ce * w) / max(sum(w), 1e-8)``."""
    ce = cross_entropy(F.col("logits"), F.col("label"))
    if weight is None:
        return examples.agg(F.avg(ce).alias("loss"))
    return examples.agg((F.sum(ce * F.col(weight)) / F.greatest(F.sum(weight), F.lit(1e-8))).alias("loss"))


# --- ranking --------------------------------------------------------------------------

def score_counts(scored: DataFrame) -> DataFrame:
    """Positives and negatives per distinct score: ties, even huge ones, become one row."""
    return scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"),
                                       F.count_if(F.col("label") == 0).alias("neg"))


def _auc() -> Column:
    wins = F.sum(F.col("pos") * (F.col("neg_before") + F.col("neg") / 2))
    p, n = F.sum("pos").cast("double"), F.sum("neg").cast("double")  # their product passes 64 bits
    return F.when((p > 0) & (n > 0), wins / (p * n)).otherwise(F.lit(float("nan"))).alias("auc")


def roc_auc(scored: DataFrame) -> DataFrame:
    """Mann-Whitney AUC with ties sharing their mean rank; NaN when a class is missing."""
    return running_sums(score_counts(scored), [], ["score"], ["neg"]).agg(_auc())


def average_ranks(scored: DataFrame, keys: list[str]) -> DataFrame:
    """1-based rank of every row by score; equal scores share the mean rank."""
    counts = scored.groupBy("score").agg(F.count(F.lit(1)).alias("m"))
    ranked = running_sums(counts, [], ["score"], ["m"])
    ranks = ranked.select("score", (F.col("m_before") + (F.col("m") + 1) / 2).alias("avg_rank"), "m")
    return lookup_join(scored, ranks, ["score"], "m", keys)


def _percentile_parts(fractions: dict[str, float], value: str) -> list[Column]:
    """Aggregates that pick both neighbours of each percentile out of ranked distinct values."""
    first, past = F.col("m_before"), F.col("m_before") + F.col("m")
    parts = []
    for name, f in fractions.items():
        at = F.lit(f) * (F.col("m_total") - 1)
        low, high = F.floor(at), F.ceil(at)
        parts += [F.max(F.when((first <= low) & (low < past), F.col(value))).alias(f"_lo_{name}"),
                  F.max(F.when((first <= high) & (high < past), F.col(value))).alias(f"_hi_{name}"),
                  F.max(at - low).alias(f"_f_{name}")]
    return parts


def _percentiles(fractions: dict[str, float]) -> list[Column]:
    return [(F.col(f"_lo_{x}") + (F.col(f"_hi_{x}") - F.col(f"_lo_{x}")) * F.col(f"_f_{x}")).alias(x) for x in fractions]


def exact_percentiles(scored: DataFrame, fractions: dict[str, float], group: list[str] | None = None,
                      value: str = "score") -> DataFrame:
    """Percentiles with linear interpolation per group, from ranks of distinct values."""
    group = group or []
    counts = scored.filter(F.col(value).isNotNull()).groupBy(*group, value).agg(F.count(F.lit(1)).alias("m"))
    ranked = running_sums(counts, group, [value], ["m"])
    out = ranked.groupBy(*group).agg(F.max("m_total").alias("n"), *_percentile_parts(fractions, value))
    return out.select(*group, "n", *_percentiles(fractions))


# The percentiles of the score spread.
SPREAD = {"score_p05": 0.05, "score_p95": 0.95}


def score_spread(scored: DataFrame) -> DataFrame:
    """5th and 95th percentile: narrow for a collapsed detector."""
    return exact_percentiles(scored, SPREAD)


def ranking(scored: DataFrame) -> DataFrame:
    """AUC and score spread from one ranked table."""
    counts = score_counts(scored).withColumn("m", F.col("pos") + F.col("neg"))
    ranked = running_sums(counts, [], ["score"], ["neg", "m"])
    return ranked.agg(_auc(), *_percentile_parts(SPREAD, "score")).select("auc", *_percentiles(SPREAD))


def score_summary(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Per capture: lowest, median and highest score, flagged out of total."""
    median = exact_percentiles(scored, {"median_score": 0.5}, ["capture"]).drop("n")
    plain = scored.groupBy("capture").agg(
        F.min("score").alias("min_score"), F.max("score").alias("max_score"),
        F.count_if(F.col("score") > threshold).alias("n_flagged"), F.count(F.lit(1)).alias("n_flows"))
    return plain.join(median, "capture")


def evaluate(examples: DataFrame, num_classes: int, task: str = "anomaly") -> DataFrame:
    """One row: accuracy, macro-F1, n, and for the binary task AUC and score spread.

    Predictions and scores are stored once, so a model behind ``logits`` runs once.
    """
    score = softmax(F.col("logits"))[1] if task == "anomaly" else F.lit(None).cast("double")
    rows = materialize(examples.select(argmax(F.col("logits")).alias("pred"), "label", score.alias("score")), "predictions")
    out = accuracy(rows).withColumn("macro_f1", macro_f1(rows, num_classes).scalar())
    if task != "anomaly":
        return out
    row = ranking(rows).select(F.struct("auc", *SPREAD)).scalar()
    return out.withColumns({x: row[x] for x in ("auc", *SPREAD)})


def best_epoch(epochs: DataFrame, run: list[str] | None = None) -> DataFrame:
    """Mark epochs that beat every earlier one. The figure is AUC, or macro-F1 where AUC
    is missing, zero or NaN. ``epochs`` has one row per epoch of a training run."""
    auc = F.col("auc")
    figure = F.when(auc.isNull() | F.isnan(auc) | (auc == 0), F.coalesce("macro_f1", F.lit(0.0))).otherwise(auc)
    w = Window.partitionBy(*(run or [F.lit(0)])).orderBy("epoch")
    earlier = F.max("figure").over(w.rowsBetween(Window.unboundedPreceding, -1))
    return (epochs.withColumn("figure", figure)
            .withColumn("is_best", F.col("figure") > F.coalesce(earlier, F.lit(-1.0))))
