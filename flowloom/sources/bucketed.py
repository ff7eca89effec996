"""Flow tables bucketed and sorted by their key, for joins that move no rows.

Flows are summarised once and joined often, with the scores of every new model. Stored in buckets of the flow key, both
sides of such a join already lie where they meet: the plan has neither an exchange nor a broadcast. Files lie in the
shared folder; the session's catalogue only names them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import flows as A
from flowloom.session import scratch_path

BUCKETS = 512


def store_bucketed(rows: DataFrame, label: str, keys: list[str], buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write ``rows`` in one file per bucket of ``keys`` and return the table. Rows are dealt once, by the hash that
    buckets use; tables that are to be joined need the same keys and number of buckets."""
    spark = rows.sparkSession
    name = f"{label}_{uuid.uuid4().hex}"
    (rows.repartition(buckets, *keys).write.bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path or scratch_path(spark, label)).saveAsTable(name))
    return spark.table(name)


def flow_summaries(packets: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """The bucketed flow table of a packet table: statistics, flagged packets and uncapped counts."""
    flows = A.summarize_flows(packets).join(A.packet_counts(packets), S.FLOW_KEY)
    return store_bucketed(flows, "flows", S.FLOW_KEY, buckets)


def join_scores(flows: DataFrame, scores: DataFrame) -> DataFrame:
    """``plans.diagnose.scored_flow_table`` from two bucketed tables: flows without a score and scores without packets
    keep their rows."""
    scored = scores.select(*S.FLOW_KEY, F.col("score").cast("double").alias("anomaly_score"))
    return (scored.join(flows, S.FLOW_KEY, "full")
            .withColumn("packets", F.coalesce("packets", F.lit(0).cast("bigint"))))
