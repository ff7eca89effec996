import itertools
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from flowloom.operators import prepare as B
from flowloom.operators import ranks as R


def first_fit(counts, budget, cap):
    """Plain first-fit decreasing, one flow at a time."""
    bins = []
    for size in range(len(counts), 0, -1):
        for _ in range(counts[size - 1]):
            for b in bins:
                if b["load"] + size <= budget and b["n"] < cap:
                    break
            else:
                b = {"load": 0, "n": 0, "sizes": []}
                bins.append(b)
            b["load"] += size
            b["n"] += 1
            b["sizes"].append(size)
    return [sorted(b["sizes"]) for b in bins]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=16, max_size=16), st.integers(1, 80), st.integers(1, 12))
def test_planned_first_fit_equals_the_plain_one(counts, budget, cap):
    runs = B.plan_first_fit(counts, budget, cap)
    got = [sorted(s for s, q in r.items for _ in range(q)) for r in runs for _ in range(r.bins)]
    assert got == first_fit(counts, budget, cap)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 50), min_size=16, max_size=16), st.integers(1, 4))
def test_planned_edges_equal_brute_force(counts, k):
    def cost(edges):
        return sum(c * next(e for e in edges if e >= n) for n, c in enumerate(counts, 1))
    options = [(*lower, 16) for lower in itertools.combinations(range(1, 16), k - 1)]
    best = min(options, key=lambda e: (cost(e), *reversed(e)))
    assert tuple(B.plan_edges(counts, k)) == best


def test_plan_stays_small():
    rng = random.Random(0)
    counts = [rng.randrange(10**9, 10**10) for _ in range(16)]
    runs = B.plan_first_fit(counts, 300, 64)
    assert len(runs) < 60 and sum(r.bins * q for r in runs for s, q in r.items) == sum(counts)


def geometric(spark, n):
    rng = random.Random(n)
    sizes = []
    for _ in range(n):
        k = 1
        while rng.random() > 0.4 and k < 16:
            k += 1
        sizes.append(k)
    return spark.createDataFrame(list(enumerate(sizes)), "flow_id BIGINT, n INT")


@pytest.mark.parametrize("strategy", ["bucket", "ffd"])
def test_every_flow_is_packed_once_within_limits(spark, strategy):
    flows = geometric(spark, 500)
    packed = B.pack(flows, ["flow_id"], strategy, max_batch=20, token_budget=64)
    row = B.pack_coverage(flows, packed, ["flow_id"]).first()
    assert (row["n_flows"], row["missing"], row["foreign"], row["repeated"]) == (500, 0, 0, 0)
    batches = packed.groupBy("batch").agg(F.count(F.lit(1)).alias("k"), F.sum("n").alias("load"),
                                          F.max("n").alias("top"), F.countDistinct("edge").alias("e"), F.max("edge").alias("edge"))
    assert batches.filter("k > 20 OR e <> 1 OR top > edge").isEmpty()
    if strategy == "ffd":
        assert batches.filter("load > 64").isEmpty()


@pytest.mark.parametrize("strategy", ["bucket", "ffd"])
def test_padding_report_agrees_with_the_plan(spark, strategy):
    flows = geometric(spark, 400)
    r = B.padding_report(flows, strategy, max_batch=16, token_budget=100).first()
    packed = B.pack(flows, ["flow_id"], strategy, max_batch=16, token_budget=100)
    assert r["packed_padded_tokens"] == packed.agg(F.sum("edge")).first()[0]
    assert r["n_batches"] == packed.select("batch").distinct().count()
    assert r["distinct_shapes"] == packed.select("edge").distinct().count() <= 4
    assert r["real_packet_tokens"] <= r["packed_padded_tokens"] <= r["naive_padded_tokens"] == 400 * 16
    assert r["padding_reduction"] > 0


def test_buckets_end_at_the_cap_and_beat_a_single_one(spark):
    flows = geometric(spark, 300)
    edges = B.optimal_buckets(flows, 4)
    assert edges == sorted(edges) and edges[-1] == 16 and len(edges) == 4
    assert B.optimal_buckets(flows, 1) == [16] and B.optimal_buckets(flows, 99) == list(range(1, 17))


def test_trim(spark):
    flows = spark.createDataFrame([(1, 3)], "flow_id BIGINT, n INT").withColumn("packets", F.array(*[F.lit(i) for i in range(16)]))
    got = B.trim_flows(B.pack(flows, ["flow_id"], edges=[4, 16])).first()
    assert got["packets"] == [0, 1, 2, 3] and got["edge"] == 4


def test_known_split_and_batch_sizes():
    n = 1_593_481
    assert int(n * (1.0 - 0.1)) == 1_434_132 and n - 1_434_132 == 159_349 and 1_434_132 // 256 == 5_602


def test_split_and_batches(spark):
    flows = spark.range(1003).withColumnRenamed("id", "flow_id")
    split = B.train_val_split(flows, ["flow_id"], 0.1, seed=5)
    row = B.split_check(split, flows, ["flow_id"]).first()
    assert (row["n_train"], row["n_val"], row["n_shared"], row["n_missing"]) == (902, 101, 0, 0)
    other = B.train_val_split(flows, ["flow_id"], 0.1, seed=6)
    assert not split.filter("is_train").exceptAll(other.filter("is_train")).isEmpty()
    batches = B.assign_batches(flows, ["flow_id"], 64).groupBy("batch_id").count().collect()
    assert len(batches) == 15 and {r["count"] for r in batches} == {64}
    ordered = B.assign_batches(flows, ["flow_id"], 64, shuffle=False, drop_last=False)
    assert ordered.filter("flow_id <> batch_id * 64 + slot_in_batch").isEmpty()


def test_class_weights_at_the_published_rate(spark):
    flows = spark.range(1000).select((F.col("id") < 36).cast("int").alias("label_bin"))
    w = {r["label"]: r["weight"] for r in B.class_weights(flows, "label_bin", 3).collect()}
    assert round(w[0], 2) == 0.07 and round(w[1], 2) == 1.93 and w[2] == 0.0


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_running_sums_cut_large_groups(spark, parts):
    rows = spark.range(4000).select((F.col("id") % 2000 * 7 % 2000).alias("x"),
                                    F.when(F.col("id") < 2000, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("g"),
                                    (F.col("id") % 3).alias("v")).groupBy("g", "x").agg(F.sum("v").alias("v"))
    got = R.running_sums(rows, ["g"], ["x"], ["v"], parts).toPandas().sort_values(["g", "x"])
    assert (got["v_before"] == got.groupby("g")["v"].cumsum() - got["v"]).all()
    assert (got["v_total"] == got.groupby("g")["v"].transform("sum")).all()


def test_hashed_rank_is_dense_per_group(spark):
    got = R.hashed_rank(spark.range(999).withColumn("s", F.col("id") % 2), ["id"], 1, ["s"])
    for s, n in ((0, 500), (1, 499)):
        ranks = sorted(r["rank"] for r in got.filter(F.col("s") == s).collect())
        assert ranks == list(range(n))
