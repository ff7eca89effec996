"""Views over the driver tables that give them the shape of network data.

The texts run in Spark SQL and, after filling the slots, in DuckDB as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAYLOAD_PACKETS = """
SELECT source AS source_file, CAST(floor(sqrt(d.doc_id)) AS BIGINT) AS flow_id, d.doc_id AS packet_id,
  CAST((d.doc_id * 7919) % 65536 AS INT) AS source_port,
  CASE lang WHEN 'en' THEN 443 WHEN 'fr' THEN 53 WHEN 'de' THEN 4444 ELSE 60000 END AS destination_port,
  CASE lang WHEN 'en' THEN 'tcp' WHEN 'fr' THEN 'UDP ' WHEN 'de' THEN '1' ELSE 'zz' END AS protocol,
  octet_length({enc}) AS payload_length,
  substr(hex({enc}), 1, 256) AS payload_hex,
  CASE WHEN l.toxic = 1 THEN 'exploits' WHEN l.quality = 0 THEN 'Reconnaissance'
       WHEN l.quality = 1 THEN 'normal' ELSE '-' END AS attack_label
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

WIRE_PACKETS = """
WITH e AS (SELECT event_id, user_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INT) AS k,
                  user_id % 10 AS role FROM {events}),
w AS (SELECT event_id, k, role, event_type,
  concat('10.0.', CAST(CAST(floor(user_id / 256) AS INT) AS STRING), '.', CAST(user_id % 256 AS STRING)) AS src,
  CASE WHEN role = 0 THEN '10.1.0.1' WHEN role IN (1,2) THEN '10.1.0.9'
       ELSE concat('10.1.1.', CAST(user_id % 3 AS STRING)) END AS dst,
  CAST(CASE WHEN role = 0 THEN 40000 WHEN role IN (1,2) THEN 40000 + event_id % 60
       WHEN k % 7 = 6 THEN 443 ELSE 50000 + user_id % 7 END AS INT) AS sport,
  CAST(CASE WHEN role = 0 THEN 1000 + k WHEN role IN (1,2) THEN 22
       ELSE CASE k % 7 WHEN 0 THEN 80 WHEN 1 THEN 443 WHEN 2 THEN 22 WHEN 3 THEN 53
            WHEN 4 THEN 4444 WHEN 5 THEN 0 ELSE 51000 END END AS INT) AS dport
  FROM e),
p AS (SELECT *, CASE WHEN dport = 53 THEN 17 WHEN dport = 0 THEN 1 ELSE 6 END AS proto FROM w)
SELECT event_id, src, dst, sport, dport, proto,
  CASE WHEN proto <> 6 THEN ''
       WHEN role = 0 THEN 'S'
       WHEN role IN (1,2) THEN CASE WHEN event_id % 10 = 0 THEN 'A' ELSE 'S' END
       WHEN event_type = 'view' THEN 'A' WHEN event_type = 'click' THEN 'PA'
       WHEN event_type = 'purchase' THEN 'FA' WHEN event_type = 'signup' THEN 'S'
       WHEN event_id % 31 = 0 THEN 'FS' WHEN event_id % 31 = 1 THEN 'RS' ELSE 'R' END AS flags,
  CAST(CASE WHEN k % 4 = 0 THEN 64 - event_id % 13 ELSE 64 END AS INT) AS ttl,
  CASE WHEN role <= 2 OR event_type IN ('view','error') THEN ''
       WHEN proto = 17 THEN CASE event_id % 3 WHEN 0 THEN repeat('41', 301)
            WHEN 1 THEN '1234010000010000000000000161' ELSE '1234' END
       WHEN event_id % 5 = 0 THEN '00FF10'
       WHEN dport = 80 THEN '474554202F20485454502F312E310D0A'
       WHEN dport = 443 OR sport = 443 THEN '1603010200'
       WHEN dport = 22 THEN '5353482D322E30'
       ELSE '0000DEADBEEF' END AS payload_hex,
  event_id % 97 <> 0 AS ip_checksum_ok,
  event_id % 89 <> 0 AS l4_checksum_ok
FROM p
"""

FLOW_COUNTS = """
SELECT f.flow_id, f.n, CASE WHEN o.o_custkey % 28 = 0 THEN 1 ELSE 0 END AS label_bin,
  CASE WHEN o.o_custkey % 28 = 0 THEN 1 + o.o_orderkey % 9 ELSE 0 END AS label_cls
FROM (SELECT l_orderkey AS flow_id, least(count(*), 16) AS n FROM {lineitem} GROUP BY l_orderkey) f
JOIN {orders} o ON o.o_orderkey = f.flow_id
"""

SCORED_FLOWS = """
SELECT o_orderkey AS flow_id, CAST((o_orderkey * 7919) % 1000 AS DOUBLE) / 1000 AS score,
  CASE WHEN o_custkey % 28 = 0 THEN 1 ELSE 0 END AS label FROM {orders}
"""

CLASS_LOGITS = """
SELECT vec_id, label, {list}(""" + ", ".join(
    " + ".join(f"{{item}}(embedding, {i})" for i in range(k, 65, 10)) for k in range(1, 11)) + """) AS logits FROM {embeddings}
"""

CAPTURE_SCORES = """
SELECT event_type AS capture, event_id, value / 500 AS score FROM {events}
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table. One read as fewer splits than there are cores (a single small file)
    is dealt out first; a table of many splits is left as it is."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def view(spark: SparkSession, sf_dir: str, text: str, *tables: str) -> DataFrame:
    text = text.replace("{enc}", "encode(text, 'UTF-8')").replace("{list}", "array").replace("{item}", "element_at")
    return spark.sql(text, **{t: table(spark, sf_dir, t) for t in tables})


def payload_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packets with ``payload`` BINARY; ``source_file`` is the document source."""
    return view(spark, sf_dir, PAYLOAD_PACKETS, "documents", "labels").withColumn(
        "payload", F.unhex("payload_hex"))


def one_source(packets: DataFrame) -> DataFrame:
    """The same packets as if they came from a single file: longer flows."""
    return packets.withColumn("source_file", F.lit("all"))


def wire_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (view(spark, sf_dir, WIRE_PACKETS, "events")
            .select(F.lit("all").alias("capture"), F.col("event_id").alias("arrival"), "src", "dst", "sport",
                    "dport", "proto", "flags", "ttl", F.unhex("payload_hex").alias("payload"),
                    "ip_checksum_ok", "l4_checksum_ok"))


def wire_scores(packets: DataFrame) -> DataFrame:
    """A score per wire flow from its first arrival number, in steps that meet ties at 2, 3 and 4 decimals."""
    from flowloom.schema import FLOW_KEY

    return (packets.groupBy(*FLOW_KEY).agg(F.min("arrival").alias("_a"))
            .withColumn("score", ((F.col("_a") * 7919) % 20000).cast("double") / 20000).drop("_a"))


def flow_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, FLOW_COUNTS, "lineitem", "orders")


def scored_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, SCORED_FLOWS, "orders")


def class_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CLASS_LOGITS, "embeddings")


def capture_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CAPTURE_SCORES, "events")
