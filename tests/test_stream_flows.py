import random

import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import flows as A
from flowloom.plans import diagnose as P
from flowloom.session import scratch_path
from flowloom.streaming import contexts as C
from flowloom.streaming import flows as SF
from flowloom.streaming import verdicts as SV
from flowloom.streaming.run import read_in_turn, run_to_end, state_settings, write_in_turn
from tests.helpers import packet, packets

START = 900 * 1_900_000
FAR = 40 * 86_400


def _timed(spark, rows, turns):
    """Packets one a second, and two far ahead that move the watermark."""
    ends = [packet(FAR + i * FAR, src="end", dst="end") for i in (1, 2)]
    df = packets(spark, rows + ends).withColumn("ts", F.timestamp_seconds(F.col("arrival") + START))
    turn = F.when(F.col("src") == "end", len(turns)).otherwise(F.lit(0))
    for i, wanted in enumerate(turns):
        turn = F.when(F.col("arrival").isin(wanted), i).otherwise(turn)
    return write_in_turn(df, turn, len(turns) + 1, "t-stream", parts=1), df.schema


def _stream(spark, path, schema):
    return read_in_turn(spark, path, schema, files=1)


def _hot(n):
    """A flow with most packets, and some others."""
    rng = random.Random(5)
    return [packet(i, sport=40000 if rng.random() < 0.9 else 1000 + i % 7, flags=rng.choice(["A", "S", ""]), payload=b"x" * (i % 3)) for i in range(n)]


def _indexed(df):
    return sorted((r.sport, r.arrival, r.packet_index, r.flags, bytes(r.payload)) for r in df.filter("src <> 'end'").collect())


def test_index_of_a_hot_flow_in_shuffled_turns_equals_batch(spark):
    rows = _hot(3000)
    order = list(range(3000))
    random.Random(1).shuffle(order)
    turns = [order[:1500], order[1500:]]  # far out of order, inside the lateness
    path, schema = _timed(spark, rows, turns)
    got = spark.read.parquet(run_to_end(SF.packet_index(_stream(spark, path, schema), late="2 hours"), "t-index", 2))
    want = A.packet_index(packets(spark, rows))
    assert _indexed(got) == _indexed(want)
    assert set(got.columns) == {*schema.fieldNames(), "packet_index"}


def test_late_packets_are_dropped_and_quiet_flows_forgotten(spark):
    rows = [packet(i) for i in (10, 11, 500, 501, 5, 9000)] + [packet(i, src="other") for i in (700, 5000, 5001)]
    path, schema = _timed(spark, rows, [[10, 11], [500, 501], [700], [5], [5000], [5001], [9000]])
    stream = SF.packet_index(_stream(spark, path, schema), late="60 seconds", idle_ms=1_000_000)
    out, state = scratch_path(spark, "t-late"), scratch_path(spark, "t-late-state")
    with state_settings(spark, 1):
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start()
        query.awaitTermination()
    got = sorted((r.arrival, r.packet_index) for r in spark.read.parquet(out).filter("src not in ('end', 'other')").collect())
    # 5 comes after the watermark has passed it; 9000 begins anew.
    assert got == [(10, 0), (11, 1), (500, 2), (501, 3), (9000, 0)]
    assert sum(o["numRowsDroppedByWatermark"] for p in query.recentProgress for o in p["stateOperators"]) == 1


def _run(stream, label, partitions=2):
    """Result folder and progress of a stream run to its end."""
    spark = stream.sparkSession
    out = scratch_path(spark, label)
    with state_settings(spark, partitions):
        query = (stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{label}-state"))
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.parquet(out), query.recentProgress


def test_state_rows_follow_the_shards_and_not_the_flows(spark):
    """One state row per flow cost a dozen calls of the state store for each flow of a micro-batch."""
    rows = [packet(i, sport=1000 + i % 300, dport=None if i % 300 == 7 else 80, payload=b"x" * (i % 5)) for i in range(1500)]
    rows += [packet(2000 + i, flags="S") for i in range(100)]  # and one flow of many packets
    at = [r[1] for r in rows]
    random.Random(4).shuffle(at)
    path, schema = _timed(spark, rows, [at[:800], at[800:]])
    columns = [*S.FLOW_KEY, "arrival", "payload", "packet_index"]
    got, progress = _run(SF.packet_index(_stream(spark, path, schema), late="2 hours", shards=3), "t-shards")
    want = A.packet_index(packets(spark, rows))
    text = F.to_json(F.struct(*columns))
    assert (sorted(r.t for r in got.filter("src <> 'end'").select(text.alias("t")).collect())
            == sorted(r.t for r in want.select(text.alias("t")).collect()))
    assert 0 < max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) < 20

    stream = _stream(spark, path, schema).withColumn("capture", F.lit("c"))
    got, progress = _run(SF.flow_windows(stream, "10 hours", "2 hours", shards=3), "t-window-shards")
    counts = packets(spark, rows).groupBy(*S.FLOW_KEY).count()
    assert (sorted(str(tuple(r)) for r in got.filter("src <> 'end'").select(*S.FLOW_KEY, "packets").collect())
            == sorted(str(tuple(r)) for r in counts.collect()))
    assert got.filter("packets = 100").first()["n_packets"] == 16
    assert 0 < max(o["numRowsTotal"] for p in progress for o in p["stateOperators"]) < 30


def test_flows_of_one_shard_expire_on_their_own(spark):
    rows = [packet(i) for i in (10, 500, 9000)] + [packet(i, src="other") for i in (12, 700, 1400, 2100, 2800, 9001)]
    path, schema = _timed(spark, rows, [[10, 12], [500], [700], [1400], [2100], [2800], [9000, 9001]])
    got, _ = _run(SF.packet_index(_stream(spark, path, schema), late="60 seconds", idle_ms=1_000_000, shards=1), "t-expire", 1)
    found = sorted((r.src, r.arrival, r.packet_index) for r in got.filter("src <> 'end'").collect())
    assert found == [("10.0.0.5", 10, 0), ("10.0.0.5", 500, 1), ("10.0.0.5", 9000, 0),
                     *[("other", a, i) for i, a in enumerate((12, 700, 1400, 2100, 2800))], ("other", 9001, 5)]


@pytest.mark.parametrize("make", [C.source_windows, C.target_windows])
def test_exact_contexts_take_two_steps(spark, make):
    rows = _hot(400)
    path, schema = _timed(spark, rows, [list(range(0, 400, 2)), list(range(1, 400, 2))])
    stream = make(_stream(spark, path, schema), "120 seconds", late="1 hour")
    with state_settings(spark, 2):
        query = (stream.writeStream.format("memory").queryName("t_exact").outputMode("append")
                 .option("checkpointLocation", scratch_path(spark, "t-exact")).trigger(availableNow=True).start())
        query.awaitTermination()
    assert [o["operatorName"] for o in query.lastProgress["stateOperators"]] == ["stateStoreSave"] * 2
    key = "src" if make is C.source_windows else "dst"
    batch = make(packets(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("arrival") + START)), "120 seconds")
    got = [r for r in spark.table("t_exact").collect() if r[key] != "end"]
    assert sorted(got) == sorted(batch.collect()) and got
    assert "approx" not in batch._jdf.queryExecution().toString()


def test_reports_of_a_replay_equal_the_batch_reports(spark):
    rows = [packet(i, src="10.0.0.66", dport=20 + i, flags="S") for i in range(15)]  # a scan in the first window
    rows += [packet(100 + i, src=f"9.0.0.{i}", sport=5000 + i, dport=22, flags="S") for i in range(30)]  # a flood over two
    rows += [packet(200 + i, src="10.0.0.9", ttl=64 - i, flags=["S", "SF", "A"][i % 3], payload=b"GET / HTTP/1.1") for i in range(25)]
    rows += [packet(400, dport=53, proto=17, flags="", payload=b"A" * 400), packet(401, ip_ok=False)]
    at = [r[1] for r in rows]
    random.Random(2).shuffle(at)
    path, schema = _timed(spark, rows, [at[:30], at[30:]])
    window = F.window("ts", "120 seconds")["start"].cast("string")

    def scored(flows):
        return flows.withColumn("anomaly_score", (F.col("first")["arrival"] % 10) / 10)

    flows = run_to_end(SF.flow_windows(_stream(spark, path, schema).withColumn("capture", window), "120 seconds", "1 hour"), "t-flows", 2)
    stored = spark.readStream.schema(spark.read.parquet(flows).schema).parquet(flows)
    got = spark.read.parquet(run_to_end(SV.window_reports(stored, scored), "t-reports", 2)).drop("end")

    wire = packets(spark, rows).withColumn("ts", F.timestamp_seconds(F.col("arrival") + START)).withColumn("capture", window).drop("ts")
    scores = wire.groupBy(*S.FLOW_KEY).agg((F.min("arrival") % 10 / 10).alias("score"))
    want = P.diagnose_captures(wire, scores)
    assert set(got.columns) == set(want.columns)
    text = F.to_json(F.struct(*want.columns))
    lines = [sorted(r.t for r in df.filter("flow not like 'end%'").select(text.alias("t")).collect()) for df in (got, want)]
    assert lines[0] == lines[1] and len(lines[0]) > 40
    tags = {r.t for r in got.select(F.col("root_cause")["tag"].alias("t")).collect()}
    assert {"port_scan_reconnaissance", "syn_flood_dos"} <= tags


def test_an_empty_stream(spark):
    schema = packets(spark, []).withColumn("ts", F.timestamp_seconds("arrival")).schema
    path = scratch_path(spark, "t-none")
    spark.createDataFrame([], schema).write.parquet(path)
    out = run_to_end(SF.packet_index(_stream(spark, path, schema)), "t-none-out", 1)
    got = SF.packet_index(_stream(spark, path, schema)).schema
    assert spark.read.schema(got).parquet(out).count() == 0
