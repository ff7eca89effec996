"""Registered queries of this package, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowloom.llm import oracles
from flowloom.llm.common import read


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.near_dedup import near_classes

    return near_classes(read(spark, sf_dir, "documents"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.lm_scoring import score_documents

    return score_documents(read(spark, sf_dir, "documents"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"), with_ids=False)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.toxicity import score_texts

    return score_texts(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op5_chat_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.chat import maximal_conversations

    return maximal_conversations(read(spark, sf_dir, "conversations"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.exact_dedup import find_copies

    return find_copies(read(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.mixing import sampling_plan

    return sampling_plan(read(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.token_counts import count_tokens

    counts = count_tokens(read(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


def op9_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.private_data import find_private, span_texts

    found = find_private(read(spark, sf_dir, "documents"))

    def count(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, ("email", "ip", "card", "phone")),
                        F.sha2(span_texts(F.col("base")), 256).alias("base_sha256"),
                        span_texts(F.concat(F.col("base"), F.transform("added", lambda s: s.dropFields("probability"))))
                        .alias("spans"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.neighbours import nearest

    return nearest(read(spark, sf_dir, "embeddings"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.decontamination import contamination

    found = contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op12_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.fill_middle import fill_in_middle, restore

    formed = restore(fill_in_middle(read(spark, sf_dir, "documents")))
    return formed.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                         F.sha2("restored", 256).alias("restored_sha256"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from flowloom.llm.vector_codes import compress

    return compress(read(spark, sf_dir, "embeddings"))


QUERIES = {q.__name__: q for q in (
    op1_near_dedup, op2_lm_scoring, op3_packing, op4_toxicity, op5_chat_snapshots, op6_exact_dedup, op7_mixing, op8_token_counts,
    op9_private_data, op10_neighbours, op11_decontamination, op12_fill_middle, op13_vector_codes)}

# Texts equal when A-Z are lower-cased; the largest identifier stays.
ORACLES = {
    "op5_chat_snapshots": """
WITH t AS (SELECT DISTINCT conv_id, coalesce(turn, -9223372036854775808) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text
    FROM conversations WHERE conv_id IS NOT NULL),
p AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY conv_id) AS n_turns,
    sha256(string_agg(concat(length(role), ':', role, length(text), ':', text), '') OVER (w ROWS UNBOUNDED PRECEDING)) AS h
    FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, sha256(text))),
logs AS (SELECT h, min(conv_id) AS conv_id, count(*) AS n_logs FROM p WHERE position = n_turns GROUP BY h),
maximal AS (SELECT conv_id FROM logs WHERE h NOT IN (SELECT h FROM p WHERE position < n_turns)),
covered AS (SELECT p.conv_id, CAST(sum(n_logs) AS BIGINT) AS n_snapshots FROM p JOIN maximal USING (conv_id) JOIN logs USING (h)
    GROUP BY p.conv_id)
SELECT p.conv_id, position, n_turns, n_snapshots, concat('<|im_start|>', role, chr(10), text, '<|im_end|>') AS rendered
FROM p JOIN covered USING (conv_id)
""",
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
  doc_id = max(doc_id) OVER same AS kept, sha256(t) AS text_sha256
FROM (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
      FROM documents)
WINDOW same AS (PARTITION BY t)
""",
    **oracles.ORACLES,
}
