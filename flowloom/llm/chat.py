"""Collapse of logged conversation snapshots, then rendering.

Logs often hold a conversation several times, each time with the turns so far. Every turn gets the rolling hash of the
prefix that it ends: two sums over the hashes of (position, role, text) so far. A conversation whose whole hash is
the prefix hash of a longer one is a snapshot of it and goes by an anti join; of equal conversations the smallest
identifier stays. The turns of what is left are rendered in chat markup.

Sums are associative, so positions and prefix hashes come from exact running sums over a range partitioning: a
conversation with a third of all turns is cut over many tasks, and decimal sums do not overflow. A very common first turn or conversation is one hash,
which is aggregated before it is shuffled. The result has one row per turn, so no conversation is gathered either.

Turns are ordered by number, then role and text (null first, null counts as empty); repeated rows are one turn.
Rows with a null ``conv_id`` belong to no conversation and take no part. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.operators.ranks import running_sums
from flowloom.session import materialize

START, STOP = "<|im_start|>", "<|im_end|>"
# Sums of 64-bit hashes: a task's have 30 digits and a conversation's 38, room for 10**11 turns a task.
HASH_TYPE = "decimal(20,0)"
WHOLE = ["n_turns", "h1", "h2"]


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: distinct rows; a null turn number sorts before all others."""
    rows = conversations.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1 << 63)).alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")])
    return rows.groupBy("conv_id", "turn", "role", F.sha2("text", 256).alias("digest")).agg(F.first("text").alias("text"))


def _hash(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), "position", "role", "digest").cast(HASH_TYPE)


def prefix_hashes(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, digest, position (from 1), n_turns, and h1, h2 of the prefix up to the turn."""
    order = ["turn", "role", "digest"]
    ranked = running_sums(rows.select("conv_id", *order, F.lit(1).cast("bigint").alias("one")), ["conv_id"], order, ["one"])
    placed = ranked.select("conv_id", *order, (F.col("one_before") + 1).alias("position"), F.col("one_total").alias("n_turns"))
    hashed = placed.withColumn("a", _hash(1)).withColumn("b", _hash(2))
    summed = running_sums(hashed, ["conv_id"], ["position"], ["a", "b"])
    return summed.select("conv_id", *order, "position", "n_turns", (F.col("a_before") + F.col("a")).alias("h1"),
                         (F.col("b_before") + F.col("b")).alias("h2"))


def rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(STOP))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """One row per turn of every conversation that is no prefix of a longer one: conv_id, position, n_turns,
    n_snapshots (logs it stands for, equal and shorter ones, itself included), rendered."""
    stored = materialize(turns(conversations), "turns")
    hashes = materialize(prefix_hashes(stored), "prefix-hashes")
    prefixes = hashes.filter(F.col("position") < F.col("n_turns")).select(
        F.col("position").alias("n_turns"), "h1", "h2").distinct()
    logs = materialize(hashes.filter(F.col("position") == F.col("n_turns")).groupBy(*WHOLE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_logs")), "logs")
    maximal = materialize(logs.join(prefixes, WHOLE, "left_anti").select("conv_id"), "maximal")
    kept = hashes.join(maximal, "conv_id", "left_semi")
    # The logs at every prefix of a kept conversation, itself among them.
    covered = (kept.select("conv_id", F.col("position").alias("n_turns"), "h1", "h2")
               .join(logs.select(*WHOLE, "n_logs"), WHOLE).groupBy("conv_id").agg(F.sum("n_logs").alias("n_snapshots")))
    return (kept.select("conv_id", "turn", "role", "digest", "position", "n_turns").join(covered, "conv_id")
            .join(stored, ["conv_id", "turn", "role", "digest"])
            .select("conv_id", "position", "n_turns", "n_snapshots", rendered(F.col("role"), F.col("text")).alias("rendered")))
