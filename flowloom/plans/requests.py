"""A table of analysis requests to envelopes and result rows.

One row per request: a capture (bytes, base64 text or a field map) and its options.
Captures inside a column are request-sized; large ones belong in files.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.frames import header_fields
from flowloom.operators import verdicts as V
from flowloom.operators.lookups import lookup_join
from flowloom.plans import diagnose as P
from flowloom.session import materialize
from flowloom.sources.captures import decode_captures, frames_of_content
from flowloom.sources.reports import report_json

# Option defaults.
DEFAULTS = {"threshold": 0.5, "diagnose": True, "max_flows": 200}


# A capture's reports are dealt over so many parts before its first ones are chosen.
PARTS = 64


def first_in_order(reports: DataFrame) -> DataFrame:
    """Reports with their ``position`` in first-seen order, up to ``max_flows`` of each capture. The first ones of
    every part are chosen before the parts meet, so a large capture never stands in one task."""
    order = ["first_seen", "flow"]
    part = Window.partitionBy("capture", F.pmod(F.xxhash64("flow"), F.lit(PARTS))).orderBy(*order)
    near = reports.withColumn("position", F.row_number().over(part)).filter(F.col("position") <= F.col("max_flows"))
    whole = Window.partitionBy("capture").orderBy(*order)
    return near.withColumn("position", F.row_number().over(whole)).filter(F.col("position") <= F.col("max_flows"))


def answer_requests(requests: DataFrame, scorer: Callable[[DataFrame], DataFrame], request_id: str = "request_id",
                    raw: str | None = None, text: str | None = None, fields: str | None = None,
                    model: dict | None = None) -> tuple[DataFrame, DataFrame]:
    """(envelopes, results). ``scorer`` turns packets into FLOW_KEY + score; ``model`` describes it.

    ``threshold``, ``diagnose`` and ``max_flows`` are read from the request where it has
    such columns and values. An envelope holds the model, the number of flows, the truncated flag
    or an error, also for bytes that are no capture; a result row is one JSON text, in full or plain shape,
    numbered in first-seen order.
    """
    decoded = materialize(decode_captures(requests, raw, text, fields), "decoded")
    frames = materialize(frames_of_content(decoded, request_id), "frames")
    unread = frames.filter(F.col("error").isNotNull()).select("capture", F.col("error").alias("unread"))
    options = materialize(decoded.select(
        F.col(request_id).cast("string").alias("capture"), "error",
        *[F.coalesce(F.col(n), F.lit(v)).alias(n) if n in requests.columns else F.lit(v).alias(n)
          for n, v in DEFAULTS.items()]).join(unread, "capture", "left")
        .withColumn("error", F.coalesce("error", F.concat(F.lit("Could not read the capture: "), "unread")))
        .drop("unread"), "requests")
    packets = materialize(header_fields(frames.drop("error")).withColumnRenamed("frame_no", "arrival"), "packets")
    flows = materialize(P.scored_flow_table(packets, scorer(packets)), "flows")
    counts = flows.filter(F.col("anomaly_score").isNotNull()).groupBy("capture").agg(F.count(F.lit(1)).alias("n_flows"))
    envelopes = (options.join(counts, "capture", "left")
                 .withColumn("n_flows", F.when(F.col("error").isNull(), F.coalesce("n_flows", F.lit(0))))
                 .select("capture", F.lit(json.dumps(model, sort_keys=True) if model else None).alias("model"), "n_flows",
                         (F.col("n_flows") > F.col("max_flows")).alias("truncated"), "error"))
    chosen = lookup_join(P.attach_contexts(flows), options.join(counts, "capture").drop("error"), ["capture"],
                         "n_flows", ["src", "sport", "dst", "dport"])
    reports = P.report_rows(chosen, V.Limits(anomaly_threshold=F.col("threshold")), keep=["diagnose", "max_flows"])
    kept = first_in_order(reports)
    plain = F.to_json(F.struct("flow", F.col("anomaly_score").alias("score"), "anomaly", "packets"))
    results = report_json(kept, ["position", F.when(~F.col("diagnose"), plain).alias("plain")])
    return envelopes, results.select("capture", "position", F.coalesce("plain", "json").alias("json"))


def responses(envelopes: DataFrame, results: DataFrame) -> DataFrame:
    """capture and one JSON text: the envelope with its results, at most ``max_flows`` of them, or the error."""
    listed = results.groupBy("capture").agg(F.array_sort(F.collect_list(F.struct("position", "json"))).alias("r"))
    rows = envelopes.join(listed, "capture", "left")
    texts = F.coalesce(F.array_join(F.transform("r", lambda x: x["json"]), ","), F.lit(""))
    answer = F.concat(F.lit('{"model":'), F.coalesce("model", F.lit("null")), F.lit(',"n_flows":'), F.col("n_flows").cast("string"),
                      F.lit(',"truncated":'), F.col("truncated").cast("string"), F.lit(',"results":['), texts, F.lit("]}"))
    return rows.select("capture", F.when(F.col("error").isNotNull(), F.to_json(F.struct("error"))).otherwise(answer)
                       .alias("response"))
