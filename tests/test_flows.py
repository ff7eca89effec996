import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.operators import assemble as A
from flowloom.operators import flows as FL
from flowloom.session import scratch_path
from flowloom.sources import flow_tables as FT
from flowloom.sources import packets as PK
from tests.helpers import packet, packets


def wide(spark, n_flows, per_flow, path):
    """Payload-byte rows: odd flows are exploits on port 4444 starting DE AD BE EF."""
    rows = []
    for f in range(n_flows):
        for p in range(per_flow):
            odd = f % 2 == 1
            head = [0xDE, 0xAD, 0xBE, 0xEF] if odd else [None, p, 0, 1]
            rows.append((f, f * 1000 + per_flow - p, 50000, 4444 if odd else 80, "tcp", 20 + p,
                         "exploits" if odd else "normal", *head, *[f % 256] * 125))
    ddl = ("flow_id BIGINT, packet_id BIGINT, source_port BIGINT, destination_port BIGINT, protocol STRING, "
           "payload_length BIGINT, attack_label STRING, " + ", ".join(f"payload_byte_{i} BIGINT" for i in range(1, 130)))
    spark.createDataFrame(rows, ddl).coalesce(1).write.parquet(path)
    return path


@pytest.fixture(scope="module")
def table(spark):
    return PK.read_payload_packets(spark, wide(spark, 40, 5, scratch_path(spark, "t-wide")))


def test_assembly(spark, table):
    flows = A.assemble_flows(table).collect()
    assert len(flows) == 40
    assert {f["npkts"] for f in flows} == {5} and {f["proto_id"] for f in flows} == {6}
    assert {f["label_cls"] for f in flows} == {0, 4}
    assert sum(f["label_bin"] for f in flows) / 40 == 0.5
    odd = next(f for f in flows if f["flow_id"] == 1)
    assert bytes(odd["packets"][0]["payload"][:4]) == b"\xde\xad\xbe\xef"
    assert odd["headers"] == [6, 3, 2, 5, 0]
    # packet_id order: the last written packet comes first
    assert [p["length"] for p in odd["packets"]] == [24, 23, 22, 21, 20]
    even = next(f for f in flows if f["flow_id"] == 2)
    assert bytes(even["packets"][4]["payload"][:2]) == b"\x00\x00"


def test_only_needed_columns_are_read(table):
    plan = table._jdf.queryExecution().executedPlan().toString()
    assert "payload_byte_129" not in plan.split("ReadSchema")[-1]


def test_tokens_are_dense(spark, table):
    rows = A.with_tokens(A.assemble_flows(table)).select("tokens").limit(3).collect()
    for r in rows:
        assert len(r["tokens"]) == 16 and all(len(p) == 128 for p in r["tokens"])
        assert not any(any(p) for p in r["tokens"][5:])


def test_truncation_and_group_limit(spark):
    t = PK.read_payload_packets(spark, wide(spark, 4, 25, scratch_path(spark, "t-wide")))
    flows = A.assemble_flows(t)
    assert [r["npkts"] for r in flows.collect()] == [16] * 4
    # Capped before the shuffle, on every input partition.
    plan = flows._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Exchange hashpartitioning") < plan.rindex("WindowGroupLimit")


def test_round_trip_merge_and_resume(spark, table):
    path = scratch_path(spark, "t-flows")
    one = A.assemble_flows(table.withColumn("source_file", F.lit("a")))
    two = A.assemble_flows(table.withColumn("source_file", F.lit("b")))
    FT.write_flows(one, path)
    expected = spark.createDataFrame([("a",), ("b",)], "source_file STRING")
    assert [r[0] for r in PK.pending_sources(expected, FT.read_flows(spark, path)).collect()] == ["b"]
    FT.write_flows(two, path)
    FT.write_flows(two, path)
    back = FT.read_flows(spark, path)
    assert back.count() == 80 and FT.read_flows(spark, path, ["a"]).count() == 40
    cols = sorted(one.columns)
    assert FT.merge_flows([one, two]).select(cols).exceptAll(back.select(cols)).isEmpty()
    assert {(r[0], r[1]) for r in FT.total_flows(back).collect()} == {("a", 40), ("b", 40), (None, 80)}


def test_empty_source_is_named(spark, table):
    expected = table.select("source_file").distinct().unionAll(spark.createDataFrame([("gone",)], "source_file STRING"))
    errors = [r["error"] for r in PK.check_sources(expected, table).filter("error IS NOT NULL").collect()]
    assert errors == ["No rows read from gone"]
    with pytest.raises(Exception, match="No rows read from gone"):
        PK.require_rows(expected, table).collect()


def test_cap_flows_both_ways(spark, table):
    flows = A.assemble_flows(table)
    assert sorted(r["flow_id"] for r in A.cap_flows(flows, 3).collect()) == [0, 1, 2]
    many = spark.range(5000).select(F.lit("s").alias("source_file"), F.col("id").alias("flow_id"))
    got = A.cap_flows(many, 2500)
    assert got.count() == 2500 and got.agg(F.max("flow_id")).first()[0] == 2499


def test_equal_packet_ids_are_ordered(spark):
    rows = [("f", 1, 5, 1, 1, "tcp", 2, "normal", bytearray(b)) for b in (b"bb", b"aa", b"cc")]
    ddl = ("source_file STRING, flow_id BIGINT, packet_id BIGINT, source_port INT, destination_port INT, "
           "protocol STRING, payload_length INT, attack_label STRING, payload BINARY")
    got = A.assemble_flows(spark.createDataFrame(rows, ddl)).first()
    assert [bytes(p["payload"]) for p in got["packets"]] == [b"aa", b"bb", b"cc"]


def test_hot_flow_keeps_arrival_order(spark):
    rows = [packet(i, sport=1 if i % 3 else 2 + i) for i in range(600)]
    table = packets(spark, rows).repartition(7)
    capped = FL.packet_index(table).filter("sport = 1").orderBy("packet_index").collect()
    assert [r["arrival"] for r in capped] == [i for i in range(600) if i % 3][:16]
    assert FL.packet_counts(table).filter("sport = 1").first()["packets"] == 400


def test_capture_flows_are_ready_for_a_detector(spark):
    rows = [packet(0, payload=b"x" * 200), packet(1, payload=b""), packet(2, sport=9, proto=17, dport=53)]
    got = {r["sport"]: r for r in FL.assemble_capture_flows(packets(spark, rows)).collect()}
    assert got[40000]["headers"] == [6, 2, 1, 2, 0] and got[40000]["packets"][0]["length"] == 128
    assert got[9]["headers"] == [17, 1, 1, 1, 0]
