"""Sketches, as-of edges, bucketed joins, and task counts that follow the input."""

import random

import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import ranks as R
from flowloom.operators import sketches as SK
from flowloom.operators.asof import asof_join
from flowloom.plans import diagnose as P
from flowloom.sources import captures as CP
from flowloom.sources.bucketed import flow_summaries, join_scores, store_bucketed
from tests.helpers import ipv4, packet, packets, pcap, scores, tcp


# --- sketches ---------------------------------------------------------------------------

def _pairs(spark, n):
    """A source with ``n`` distinct pairs, each met three times in different windows, and a small one."""
    big = spark.range(3 * n).select(F.lit("big").alias("src"), (F.col("id") % n).cast("string").alias("dst"), F.lit(80).alias("dport"),
                                    F.floor(F.col("id") / 5000).alias("w"))
    few = spark.range(40).select(F.lit(None).cast("string").alias("src"), (F.col("id") % 4).cast("string").alias("dst"), F.lit(None).cast("int").alias("dport"),
                                 F.lit(1).cast("bigint").alias("w"))
    return big.unionByName(few).withColumn("proto", F.lit(6)).withColumn("flags", F.when(F.col("w") % 2 == 0, "S").otherwise("A"))


def test_merged_sketches_stay_inside_the_bound(spark):
    n = 30_000
    rows = _pairs(spark, n).repartition(6)
    stored = SK.context_sketches(rows, ["src"], ["dst", "dport"], F.col("w")).cache()
    by_steps = SK.roll_up(SK.roll_up(stored, ["src"], F.floor(F.col("start") / 3)), ["src"])
    at_once = SK.roll_up(stored, ["src"])
    got = {r.src: r for r in SK.estimated(by_steps, "n").collect()}
    assert abs(got["big"].n - n) <= 4 * SK.relative_error() * n
    assert got[None].n == 4 and got[None].n_packets == 40
    exact = {r.src: (r.n, r.s) for r in rows.groupBy("src").agg(F.count("*").alias("n"), F.avg((F.col("flags") == "S").cast("double")).alias("s")).collect()}
    assert all(got[k].n_packets == v[0] and abs(got[k].syn_only_ratio - v[1]) < 1e-12 for k, v in exact.items())
    # The order of unions does not matter.
    assert {r.src: r.n for r in SK.estimated(at_once, "n").collect()} == {k: r.n for k, r in got.items()}
    assert SK.estimated(SK.roll_up(stored.limit(0), ["src"]), "n").count() == 0


# --- as-of ------------------------------------------------------------------------------

@pytest.mark.parametrize("forward", [False, True])
def test_asof_with_a_hot_key_over_many_parts(spark, forward):
    rng = random.Random(3)
    rows = [(i, rng.choice(["hot"] * 8 + ["a", None, "none"]), rng.choice([None] + list(range(-50, 400)))) for i in range(3000)]
    edges = [("hot", v, f"h{v}") for v in (0, 7, 7, 350)] + [("a", 100, "x"), ("a", 100, "y"), (None, 5, "n"), ("hot", None, "void"), ("other", 1, "o")]
    df = spark.createDataFrame(rows, "id int, g string, v int").repartition(5)
    got = asof_join(df, spark.createDataFrame(edges, "g string, edge int, tag string"), ["g"], "v", "edge", ["tag"], forward, parts=16)
    want = []
    for i, g, v in rows:
        fit = [(e, t) for k, e, t in edges if k == g and e is not None and v is not None and (e >= v if forward else e <= v)]
        best = (min if forward else max)((e for e, _ in fit), default=None)
        want.append((i, g, v, best, max((t for e, t in fit if e == best), default=None)))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_asof_with_empty_sides(spark):
    df = spark.createDataFrame([(1, "a", 5)], "id int, g string, v int")
    edges = spark.createDataFrame([], "g string, edge int")
    assert [tuple(r) for r in asof_join(df, edges, ["g"], "v", "edge").collect()] == [(1, "a", 5, None)]
    assert asof_join(df.limit(0), edges, ["g"], "v", "edge").count() == 0


# --- bucketed joins ---------------------------------------------------------------------

def test_bucketed_scores_join_without_an_exchange(spark):
    rows = [packet(i, src=f"10.0.0.{i % 9}", dport=80 + i % 5, flags="S") for i in range(300)] + [packet(1000 + i) for i in range(500)]
    wire = packets(spark, rows)
    table = scores(spark, rows[:300] + [packet(0, src="never")], 0.7)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = join_scores(flow_summaries(wire, 4), store_bucketed(table, "t_scores", S.FLOW_KEY, 4))
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        want = P.scored_flow_table(wire, table)
        text = F.to_json(F.struct(*sorted(want.columns)))
        assert sorted(r.t for r in joined.select(text.alias("t")).collect()) == sorted(r.t for r in want.select(text.alias("t")).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


# --- task counts ------------------------------------------------------------------------

def test_capture_tasks_follow_the_chunks(spark, tmp_path):
    for i in range(6):
        (tmp_path / f"{i}.pcap").write_bytes(pcap([ipv4(6, tcp(b"x" * 100)) for _ in range(40)]))
    index = CP.index_captures(spark, str(tmp_path), chunk_bytes=500).cache()
    chunks = index.count()
    assert chunks > 40
    frames = CP.read_frames(index, chunks_per_task=2)
    assert frames.rdd.getNumPartitions() == -(-chunks // 2)
    assert frames.count() == 240
    assert CP.read_frames(index.filter('chunk = 0'), chunks_per_task=100).rdd.getNumPartitions() == 6


def test_small_captures_share_tasks(spark, tmp_path, monkeypatch):
    """A task for every four chunks of any length was mostly the cost of starting tasks."""
    monkeypatch.setattr(CP, "SMALL_BYTES", 1000)
    for i in range(30):
        (tmp_path / f"{i}.pcap").write_bytes(pcap([ipv4(6, tcp(b"x" * 100)) for _ in range(40)]))
    small = CP.index_captures(spark, str(tmp_path), chunk_bytes=500).cache()
    assert small.count() == 300
    frames = CP.read_frames(small)
    assert frames.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert frames.count() == frames.select("capture", "frame_no").distinct().count() == 1200
    large = CP.index_captures(spark, str(tmp_path), chunk_bytes=2500).cache()
    n = large.filter("stop - start >= 1000").count()
    rest = large.count() - n
    frames = CP.read_frames(large)
    assert (n, rest) == (60, 30) and frames.rdd.getNumPartitions() == -(-n // CP.CHUNKS_PER_TASK) + min(rest, spark.sparkContext.defaultParallelism)
    assert frames.count() == frames.select("capture", "frame_no").distinct().count() == 1200
    assert CP.read_frames(small.filter("chunk < 0")).count() == 0


def test_parts_of_running_sums_follow_the_rows(spark, monkeypatch):
    monkeypatch.setattr(R, "PART_ROWS", 100)
    df = spark.range(5000).select((F.col("id") % 3).alias("g"), "id", F.lit(2).alias("x"))
    seen = []
    stored = R.materialize

    def counting(frame, label):
        seen.append(frame.select(F.spark_partition_id().alias("p")).distinct().count())
        return stored(frame, label)

    monkeypatch.setattr(R, "materialize", counting)
    got = R.running_sums(df, ["g"], ["id"], ["x"]).orderBy("id").collect()
    assert seen[0] > 40
    assert all(r.x_before == 2 * (r.id // 3) and r.x_total == 2 * len(range(r.g, 5000, 3)) for r in got)
