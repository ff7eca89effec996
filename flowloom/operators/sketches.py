"""Cross-flow contexts as mergeable sketches: stored per short window and key, united to longer ones without a second read.

A stored row holds exact packet counts and a HyperLogLog sketch of the distinct pairs. Rows of one key unite to any
coarser window or key in any order, so hours, days and whole sources cost a scan of the sketches and not of the
packets. A sketch of ``2**lg_k`` registers has a relative standard error of ``1.04 / sqrt(2**lg_k)``; few pairs are
counted almost exactly. Building combines on the map side, so a source with most packets sends one sketch per task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.signatures import bare_syn

LG_K = 12


def relative_error(lg_k: int = LG_K) -> float:
    """Standard error of an estimate, relative to the true number."""
    return 1.04 / math.sqrt(1 << lg_k)


def pair_text(pair: list[str]) -> Column:
    """One text per pair; nulls are values of their own."""
    return F.to_json(F.array(*[F.col(p).cast("string") for p in pair]))


def context_sketches(packets: DataFrame, key: list[str], pair: list[str], start: Column, lg_k: int = LG_K) -> DataFrame:
    """start, key columns, n_packets, syn_only, pairs (a sketch), one row per window and key. ``start`` names a packet's
    window; a null key is a key."""
    syn = F.coalesce(bare_syn(F.col("proto"), F.col("flags")), F.lit(False))
    return packets.groupBy(start.alias("start"), *key).agg(
        F.count(F.lit(1)).alias("n_packets"), F.count_if(syn).alias("syn_only"),
        F.hll_sketch_agg(pair_text(pair), lg_k).alias("pairs"))


def roll_up(sketches: DataFrame, key: list[str], start: Column | None = None) -> DataFrame:
    """The same rows for fewer keys or, with ``start`` in terms of the finer one, longer windows; without it over all
    windows. The result can be stored and rolled up again."""
    windows = [start.alias("start")] if start is not None else []
    return sketches.groupBy(*windows, *key).agg(
        F.sum("n_packets").alias("n_packets"), F.sum("syn_only").alias("syn_only"), F.hll_union_agg("pairs").alias("pairs"))


def estimated(sketches: DataFrame, n_pairs: str) -> DataFrame:
    """Sketch rows with ``n_pairs`` (estimated distinct pairs) and ``syn_only_ratio`` in the sketch's place."""
    return (sketches.withColumn(n_pairs, F.hll_sketch_estimate("pairs"))
            .withColumn("syn_only_ratio", F.col("syn_only") / F.col("n_packets")).drop("pairs", "syn_only"))
