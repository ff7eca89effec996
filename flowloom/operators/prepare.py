"""Splits, batches, class weights and length packing of flows.

Packing sees only the packet count of a flow, 1..16. So buckets and bins are planned
from a histogram of 16 counts, and the per-flow work (ranks, joins, grouping) stays
distributed. The planning code below touches those 16 numbers only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions.text import exact_round
from flowloom.operators.ranks import hashed_rank, seeded_prefix, sorted_rank
from flowloom.schema import MAX_PACKETS_PER_FLOW
from flowloom.session import materialize


# --- splits and batches ---------------------------------------------------------------

def train_val_split(flows: DataFrame, keys: list[str], val_fraction: float = 0.1, seed: int = 0) -> DataFrame:
    """Add ``is_train``: exactly ``int(n * (1 - val_fraction))`` flows in seeded order.

    Only keys are stored and ranked, and of them only those around the cut; the flows themselves stay where they are.
    """
    stored = materialize(flows.select(*keys), "split-keys")
    n_train = int(stored.count() * (1.0 - val_fraction))
    return flows.withColumn("is_train", seeded_prefix(stored, keys, n_train, seed))


def assign_batches(flows: DataFrame, keys: list[str], batch_size: int, shuffle: bool = True, seed: int = 0,
                   drop_last: bool = True) -> DataFrame:
    """Add ``batch_id`` and ``slot_in_batch``; a shuffled order is seeded, the other is key order."""
    ranked = hashed_rank(flows, keys, seed) if shuffle else sorted_rank(flows, keys)
    size = F.lit(batch_size)
    out = (ranked.withColumn("batch_id", F.floor(F.col("rank") / size).cast("bigint"))
           .withColumn("slot_in_batch", (F.col("rank") % size).cast("int")).drop("rank"))
    return full_batches(out, flows, batch_size) if drop_last else out


def full_batches(batched: DataFrame, flows: DataFrame, batch_size: int) -> DataFrame:
    """Drop the last batch unless it is full."""
    n_full = flows.select(F.floor(F.count(F.lit(1)) / F.lit(batch_size)).cast("bigint")).scalar()
    return batched.filter(F.col("batch_id") < n_full)


def task_label(task: str) -> Column:
    """Binary label for ``anomaly``, class id for ``class``."""
    return F.col("label_bin") if task == "anomaly" else F.col("label_cls")


# --- class weights --------------------------------------------------------------------

def class_weights(flows: DataFrame, label: str, num_classes: int) -> DataFrame:
    """``n / count`` per class, 0 for an absent class, over the mean of the present ones."""
    spark = flows.sparkSession
    counts = flows.groupBy(F.col(label).alias("label")).agg(F.count(F.lit(1)).alias("n_flows"))
    classes = spark.range(num_classes).select(F.col("id").cast("int").alias("label"))
    # num_classes rows from here on.
    full = classes.join(counts.withColumn("label", F.col("label").cast("int")), "label", "left")
    stats = counts.agg(F.sum("n_flows").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(1 / F.col("n_flows")).alias("inv"))
    n, k, inv = (stats.select(x).scalar() for x in ("n", "k", "inv"))
    return full.select("label", F.coalesce("n_flows", F.lit(0)).alias("n_flows"),
                       F.when(F.col("n_flows") > 0, (n / F.col("n_flows")) / (n * inv / k)).otherwise(0.0).alias("weight"))


def example_weights(flows: DataFrame, label: str, weights: DataFrame) -> DataFrame:
    """``weight`` of each flow; the weight table has one row per class."""
    w = weights.select(F.col("label").alias(label), "weight")
    return flows.join(F.broadcast(w), label)


# --- length buckets -------------------------------------------------------------------

def packet_histogram(flows: DataFrame, n: str = "n", max_len: int = MAX_PACKETS_PER_FLOW) -> DataFrame:
    size = F.greatest(F.lit(1), F.least(F.col(n), F.lit(max_len))).cast("int")
    return flows.groupBy(size.alias("size")).agg(F.count(F.lit(1)).alias("n_flows"))


def histogram_counts(flows: DataFrame, n: str = "n", max_len: int = MAX_PACKETS_PER_FLOW) -> list[int]:
    """The histogram on the driver: ``max_len`` numbers."""
    rows = {r["size"]: r["n_flows"] for r in packet_histogram(flows, n, max_len).collect()}
    return [rows.get(i, 0) for i in range(1, max_len + 1)]


def plan_edges(counts: list[int], num_buckets: int) -> list[int]:
    """Upper edges with the least total padding, the last one ``len(counts)``.

    ``best[e]`` holds (cost, edges) of the cheapest cover of sizes 1..e; comparing the
    cost alone and scanning upwards makes ties keep the smallest previous edge.
    """
    top = len(counts)
    upto = [sum(counts[:e]) for e in range(top + 1)]
    best = {e: (e * upto[e], [e]) for e in range(1, top + 1)}
    for _ in range(max(1, min(num_buckets, top)) - 1):
        best = {e: min(((cost + e * (upto[e] - upto[p]), [*edges, e]) for p, (cost, edges) in best.items() if p < e),
                       key=lambda x: x[0])
                for e in range(1, top + 1) if any(p < e for p in best)}
    return best[top][1]


def optimal_buckets(flows: DataFrame, num_buckets: int = 4, n: str = "n",
                    max_len: int = MAX_PACKETS_PER_FLOW) -> list[int]:
    return plan_edges(histogram_counts(flows, n, max_len), num_buckets)


def bucket_of(n: Column, edges: list[int]) -> Column:
    """Smallest edge >= n, the last edge if there is none."""
    out = F.lit(sorted(edges)[-1])
    for edge in sorted(edges, reverse=True):
        out = F.when(n <= edge, edge).otherwise(out)
    return out.cast("int")


def pack_bucketed(flows: DataFrame, keys: list[str], edges: list[int], max_batch: int = 64,
                  shuffle: bool = True, seed: int = 0, n: str = "n") -> DataFrame:
    """Add ``edge`` and ``batch_no``: chunks of ``max_batch`` inside each bucket."""
    sized = flows.withColumn("edge", bucket_of(F.col(n), edges))
    ranked = hashed_rank(sized, keys, seed, ["edge"]) if shuffle else sorted_rank(sized, keys, ["edge"])
    return ranked.withColumn("batch_no", F.floor(F.col("rank") / max_batch).cast("bigint")).drop("rank")


# --- first-fit decreasing -------------------------------------------------------------

@dataclass
class Run:
    """``bins`` equal bins in order; ``items`` lists (size, flows per bin)."""

    bins: int
    load: int
    card: int
    items: list[tuple[int, int]]


def plan_first_fit(counts: list[int], budget: int, max_batch: int) -> list[Run]:
    """First-fit decreasing over size counts, keeping equal bins together.

    Flows of one size are interchangeable, so a run of equal bins fills the same way:
    so many bins to the brim, one bin with what is left, the rest unchanged. Each size
    splits at most one run further and opens at most two, so the plan has a few dozen
    runs however many flows there are.
    """
    runs: list[Run] = []
    for size in range(len(counts), 0, -1):
        left = counts[size - 1]
        after: list[Run] = []
        for run in runs:
            fit = max(0, min((budget - run.load) // size, max_batch - run.card))
            whole = min(run.bins, left // fit) if fit else 0
            part = left - whole * fit if fit and whole < run.bins else 0
            left -= whole * fit + part
            for bins, q in ((whole, fit), (1 if part else 0, part), (run.bins - whole - bool(part), 0)):
                if bins:
                    after.append(Run(bins, run.load + size * q, run.card + q,
                                     [*run.items, (size, q)] if q else list(run.items)))
        fit = max(1, min(budget // size, max_batch))
        for bins, q in ((left // fit, fit), (1 if left % fit else 0, left % fit)):
            if bins:
                after.append(Run(bins, size * q, q, [(size, q)]))
        runs = after
    return runs


def plan_rows(runs: list[Run], edges: list[int]) -> list[tuple[int, int, int, int, int, int]]:
    """(size, first rank, past rank, first bin, flows per bin, edge) of every item of every run."""
    rows, first_bin, taken = [], 0, {}
    for run in runs:
        top = max(size for size, _ in run.items)
        edge = next((e for e in sorted(edges) if e >= top), max(edges))
        for size, q in run.items:
            lo = taken.get(size, 0)
            taken[size] = lo + run.bins * q
            rows.append((size, lo, taken[size], first_bin, q, edge))
        first_bin += run.bins
    return rows


PLAN_SCHEMA = "size INT, rank_lo BIGINT, rank_hi BIGINT, first_bin BIGINT, q BIGINT, edge INT"


def pack_ffd(flows: DataFrame, keys: list[str], edges: list[int], max_batch: int = 64,
             token_budget: int | None = None, seed: int = 0, n: str = "n",
             max_len: int = MAX_PACKETS_PER_FLOW) -> DataFrame:
    """Add ``bin`` and ``edge``: first-fit decreasing under a token budget and a size cap.

    The plan table has at most a few rows per size and run, whatever the number of
    flows; it is joined by size and rank range.
    """
    counts = histogram_counts(flows, n, max_len)
    runs = plan_first_fit(counts, token_budget or max_batch * max(edges), max_batch)
    plan = flows.sparkSession.createDataFrame(plan_rows(runs, edges), PLAN_SCHEMA)
    size = F.greatest(F.lit(1), F.least(F.col(n), F.lit(max_len))).cast("int")
    ranked = hashed_rank(flows.withColumn("size", size), keys, seed, ["size"])
    inside = (ranked["size"] == plan["size"]) & (ranked["rank"] >= plan["rank_lo"]) & (ranked["rank"] < plan["rank_hi"])
    joined = ranked.join(F.broadcast(plan), inside).drop(plan["size"])
    bin_no = F.col("first_bin") + F.floor((F.col("rank") - F.col("rank_lo")) / F.col("q"))
    return joined.withColumn("bin", bin_no.cast("bigint")).drop("rank", "rank_lo", "rank_hi", "first_bin", "q")


def pack(flows: DataFrame, keys: list[str], strategy: str = "bucket", edges: list[int] | None = None,
         num_buckets: int = 4, max_batch: int = 64, token_budget: int | None = None, shuffle: bool = True,
         seed: int = 0, n: str = "n") -> DataFrame:
    """Either strategy with one shape: ``edge`` and ``batch`` (unique over all buckets)."""
    edges = edges or optimal_buckets(flows, num_buckets, n)
    if strategy == "ffd":
        return pack_ffd(flows, keys, edges, max_batch, token_budget, seed, n).withColumnRenamed("bin", "batch").drop("size")
    packed = pack_bucketed(flows, keys, edges, max_batch, shuffle, seed, n)
    return packed.withColumn("batch", F.col("batch_no") * len(edges) + F.array_position(
        F.array(*[F.lit(e) for e in sorted(edges)]), F.col("edge")) - 1).drop("batch_no")


def trim_flows(packed: DataFrame) -> DataFrame:
    """Cut the packet list to the length of its bucket."""
    return packed.withColumn("packets", F.slice("packets", F.lit(1), F.col("edge")))


def pack_coverage(flows: DataFrame, packed: DataFrame, keys: list[str]) -> DataFrame:
    """Flows missing from the plan, foreign to it, and packed more than once."""
    want, got = flows.select(*keys), packed.select(*keys)
    def one(df: DataFrame) -> Column:
        return df.select(F.count(F.lit(1))).scalar()
    twice = got.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    return flows.agg(F.count(F.lit(1)).alias("n_flows")).select(
        "n_flows", one(want.exceptAll(got)).alias("missing"), one(got.exceptAll(want)).alias("foreign"),
        one(twice).alias("repeated"))


def split_check(split: DataFrame, flows: DataFrame, keys: list[str]) -> DataFrame:
    """Sizes of both sides, shared flows, and flows in neither."""
    train, val = split.filter("is_train").select(*keys), split.filter("NOT is_train").select(*keys)
    def one(df: DataFrame) -> Column:
        return df.select(F.count(F.lit(1))).scalar()
    return flows.agg(F.count(F.lit(1)).alias("n_flows")).select(
        "n_flows", one(train).alias("n_train"), one(val).alias("n_val"),
        one(train.intersect(val)).alias("n_shared"),
        one(flows.select(*keys).exceptAll(train.unionAll(val))).alias("n_missing"))


def padding_report(flows: DataFrame, strategy: str = "bucket", num_buckets: int = 4, max_batch: int = 64,
                   token_budget: int | None = None, edges: list[int] | None = None, n: str = "n",
                   max_len: int = MAX_PACKETS_PER_FLOW) -> DataFrame:
    """Packed against naive padding. All figures follow from the histogram: one aggregate over the flows."""
    counts = histogram_counts(flows, n, max_len)
    edges = sorted(edges or plan_edges(counts, num_buckets))
    spark = flows.sparkSession
    if strategy == "ffd":
        runs = plan_first_fit(counts, token_budget or max_batch * edges[-1], max_batch)
        rows = [(r[0], r[2] - r[1], r[3], r[5]) for r in plan_rows(runs, edges)]
        plan = spark.createDataFrame(rows or [(1, 0, 0, edges[-1])], "size INT, flows BIGINT, bin BIGINT, edge INT")
        n_batches = F.lit(sum(r.bins for r in runs)).cast("bigint")
    else:
        rows = [(s, c) for s, c in enumerate(counts, 1) if c]
        plan = (spark.createDataFrame(rows or [(1, 0)], "size INT, flows BIGINT")
                .withColumn("edge", bucket_of(F.col("size"), edges)))
        per_edge = plan.groupBy("edge").agg(F.ceil(F.sum("flows") / max_batch).alias("b"))
        n_batches = per_edge.select(F.sum("b").cast("bigint")).scalar()
    totals = plan.agg(
        F.sum("flows").alias("n_examples"), F.count_distinct(F.when(F.col("flows") > 0, F.col("edge"))).alias("distinct_shapes"),
        F.sum(F.col("flows") * F.col("size")).alias("real_packet_tokens"),
        F.sum(F.col("flows") * max_len).alias("naive_padded_tokens"),
        F.sum(F.col("flows") * F.col("edge")).alias("packed_padded_tokens"))
    def share(a: Column, b: Column) -> Column:
        return a / F.greatest(b, F.lit(1))
    real, naive, packed = (F.col(x) for x in ("real_packet_tokens", "naive_padded_tokens", "packed_padded_tokens"))
    return totals.select(
        "n_examples", F.lit(",".join(map(str, edges))).alias("buckets"), F.lit(strategy).alias("strategy"),
        n_batches.alias("n_batches"), "distinct_shapes", real, naive, packed,
        exact_round(share(real, naive), 4).alias("naive_efficiency"),
        exact_round(share(real, packed), 4).alias("packed_efficiency"),
        exact_round(1.0 - share(packed, naive), 4).alias("padding_reduction"))
