import pytest
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.dimensions import ACTIONS, CAUSE_LABELS, CODE_TO_CAUSE, action_table
from flowloom.functions import signatures as G
from flowloom.operators import contexts as X
from flowloom.operators import flows as FL
from flowloom.operators import rules as R
from flowloom.operators import verdicts as V
from flowloom.operators.lookups import lookup_join
from flowloom.plans import diagnose as P
from flowloom.sources.reports import report_json
from tests.helpers import packet, packets, scores

DNS = bytes.fromhex("123401000001000000000000")


def codes(spark, rows, **kw):
    got = R.inspect_flows(packets(spark, rows), **kw).orderBy("sport", "position").collect()
    return [(r["packet_index"], r["code"]) for r in got]


def test_each_rule_and_its_neighbours(spark):
    cases = [
        (packet(0, ip_ok=False), ["ip_checksum_mismatch"]),
        (packet(0, l4_ok=False), ["l4_checksum_mismatch"]),
        (packet(0, flags="SF"), ["tcp_syn_fin_violation"]),
        (packet(0, flags="SF", proto=17, dport=5), []),
        (packet(0, flags="S", payload=b"x", dport=5), ["tcp_syn_with_payload"]),
        (packet(0, flags="SA", payload=b"x", dport=5), []),
        (packet(0, flags="S", dport=5), []),
        (packet(0, flags="RS"), ["tcp_syn_rst_violation"]),
        (packet(0, flags="RSA"), []),
        (packet(0, proto=17, flags="", dport=53, payload=b"A" * 500), ["dns_payload_anomalous"]),
        (packet(0, proto=17, flags="", dport=53, payload=DNS), []),
        (packet(0, proto=17, flags="", dport=53, payload=DNS + b"\0" * 289), ["dns_payload_anomalous"]),
        (packet(0, proto=17, flags="", dport=53), []),
        (packet(0, dport=8080, payload=b"nope"), ["port_protocol_mismatch"]),
        (packet(0, dport=80, flags="PA", payload=b"GET / HTTP/1.1\r\n"), []),
        (packet(0, sport=443, dport=50000, payload=b"\x16\x03\x01"), []),
        (packet(0, sport=22, dport=50000, payload=b"zz"), ["port_protocol_mismatch"]),
        (packet(0, dport=80), []),
    ]
    rows = [(*c[0][:2], f"10.9.0.{i}", *c[0][3:]) for i, c in enumerate(cases)]
    got = R.inspect_flows(packets(spark, rows)).groupBy("src").agg(F.collect_list("code").alias("x")).collect()
    found = {r["src"]: r["x"] for r in got}
    for i, (_, want) in enumerate(cases):
        assert found.get(f"10.9.0.{i}", []) == want, i


def test_ttl_rule_needs_three_packets_and_more_than_ten(spark):
    def flow(src, ttls):
        return [packet(i, src=src, ttl=t) for i, t in enumerate(ttls)]
    rows = flow("a", [64, 53, 64]) + flow("b", [64, 54, 64]) + flow("c", [64, 10])
    got = R.inspect_flows(packets(spark, rows)).collect()
    assert [(r["src"], r["packet_index"]) for r in got] == [("a", -1)]
    assert "TTL varies by 11" in got[0]["message"] and got[0]["evidence"] == {"ttl_min": "53", "ttl_max": "64"}


def test_finding_order_and_mismatch_port(spark):
    rows = [packet(0, ttl=64), packet(1, ttl=40, flags="SF", payload=b"x", ip_ok=False, l4_ok=False), packet(2, ttl=64)]
    assert codes(spark, rows) == [(1, "ip_checksum_mismatch"), (1, "l4_checksum_mismatch"),
                                  (1, "tcp_syn_fin_violation"), (1, "tcp_syn_with_payload"),
                                  (1, "port_protocol_mismatch"), (-1, "ttl_inconsistency")]
    got = R.inspect_flows(packets(spark, [packet(0, sport=22, dport=50000, payload=b"zz")])).first()
    assert got["evidence"] == {"expected_protocol": "ssh", "port": "50000"}


def test_packets_beyond_the_cap_are_ignored(spark):
    rows = [packet(i) for i in range(16)] + [packet(16, ip_ok=False)]
    assert codes(spark, rows) == []


def test_rules_can_be_limited_and_signatures_replaced(spark):
    rows = [packet(0, ip_ok=False, l4_ok=False)]
    assert codes(spark, rows, rules=["l4_checksum_mismatch"]) == [(0, "l4_checksum_mismatch")]
    mine = {80: ("mine", lambda p: G.has_prefix(p, "X"))}
    assert codes(spark, [packet(0, payload=b"Xy")], registry=mine) == []
    assert codes(spark, [packet(0, payload=b"GET /")], registry=mine) == [(0, "port_protocol_mismatch")]


def test_contexts_of_a_scan(spark):
    rows = [packet(i, src="10.0.0.66", sport=40000 + i, dport=20 + i, flags="S") for i in range(10)]
    flows = FL.summarize_flows(packets(spark, rows))
    assert flows.count() == 10
    src = X.aggregate_by_src(flows).first()
    assert (src["n_distinct_dst_ports"], src["n_packets"], src["syn_only_ratio"]) == (10, 10, 1.0)
    assert [r["n_distinct_sources"] for r in X.aggregate_by_dst(flows).collect()] == [1] * 10


def judge(spark, rows, score, key=("capture", "src"), **limits):
    flows = R.with_findings(FL.summarize_flows(packets(spark, rows), list(key)))
    flows = P.without_contexts(flows).withColumn("anomaly_score", F.lit(float(score)))
    return V.with_root_cause(flows, V.Limits(**limits)).first()["root_cause"]


def test_single_flow_shapes(spark):
    scan = judge(spark, [packet(i, dport=20 + i, flags="S") for i in range(12)], 0.9)
    assert scan["tag"] == "port_scan_reconnaissance" and scan["reasoning"] and scan["confidence"] == 0.95
    flood = judge(spark, [packet(i, sport=40000 + i, dport=22, flags="S") for i in range(15)], 0.9)
    assert flood["tag"] == "syn_flood_dos" and "100% bare-SYN" in flood["reasoning"][0]
    seven = judge(spark, [packet(i, dport=20 + i % 7, flags="S") for i in range(12)], 0.9)
    assert seven["tag"] == "model_flagged_anomaly"


def test_model_verdict_and_benign(spark):
    rows = [packet(0)]
    high = judge(spark, rows, 0.95)
    assert (high["tag"], high["confidence"], high["contributing_findings"]) == ("model_flagged_anomaly", 0.95, [])
    low = judge(spark, rows, 0.1)
    assert low["tag"] == "benign" and low["confidence"] == pytest.approx(0.9)
    assert judge(spark, rows, 0.5)["tag"] == "model_flagged_anomaly"
    assert judge(spark, rows, 0.6, anomaly_threshold=0.7)["tag"] == "benign"


def test_equal_score_is_flagged_by_the_ladder_only(spark):
    rows = [packet(0)]
    r = P.diagnose_captures(packets(spark, rows), scores(spark, rows, 0.5)).first()
    assert r["anomaly"] is False and r["root_cause"]["tag"] == "model_flagged_anomaly"


def test_structural_cause_severity_frequency_then_first(spark):
    high_once = judge(spark, [packet(0, dport=80, payload=b"x"), packet(1, dport=80, payload=b"x"), packet(2, l4_ok=False)], 0.1)
    assert high_once["tag"] == "packet_corruption_or_tampering" and high_once["contributing_findings"] == ["l4_checksum_mismatch"]
    frequent = judge(spark, [packet(0, flags="SF"), packet(1, l4_ok=False), packet(2, l4_ok=False)], 0.1)
    assert frequent["tag"] == "packet_corruption_or_tampering" and frequent["confidence"] == pytest.approx(0.97)
    first = judge(spark, [packet(0, flags="SF"), packet(1, l4_ok=False)], 0.1)
    assert first["tag"] == "scanner_or_evasion_tooling" and first["confidence"] == pytest.approx(0.92)
    quoted = judge(spark, [packet(i, l4_ok=False) for i in range(5)], 0.1)["reasoning"][0]
    assert quoted.startswith("5 structural finding(s) map to 'Packet corruption") and quoted.count("Transport-layer") == 3


def flood(n_src, n_packets, n_bare):
    return [packet(i, src=f"9.9.9.{i % n_src}", sport=1000 + i % n_src, dst="10.1.0.9", dport=7777,
                   flags="S" if i < n_bare else "A") for i in range(n_packets)]


@pytest.mark.parametrize("rows,tag", [
    (flood(8, 10, 8), "syn_flood_dos"), (flood(7, 10, 10), "benign"), (flood(8, 9, 9), "benign"),
    (flood(8, 10, 7), "benign"),
    ([packet(i, dst=f"10.2.0.{i}", dport=7777) for i in range(8)], "port_scan_reconnaissance"),
    ([packet(i, dst=f"10.2.0.{i}", dport=7777) for i in range(7)], "benign"),
])
def test_cross_flow_limits(spark, rows, tag):
    got = P.diagnose_captures(packets(spark, rows), scores(spark, rows, 0.1)).collect()
    assert {r["root_cause"]["tag"] for r in got} == {tag}


def test_whole_capture(spark):
    rows = [packet(0, flags="PA", payload=b"GET / HTTP/1.1\r\n")]
    rows += [packet(1 + i, src="10.0.0.66", sport=40000 + i, dport=20 + i, flags="S", ip_ok=i != 3) for i in range(10)]
    reports = P.diagnose_captures(packets(spark, rows), scores(spark, rows, 0.9)).cache()
    got = reports.collect()
    assert len(got) == 11
    scan = [r for r in got if r["root_cause"]["tag"] == "port_scan_reconnaissance"]
    assert len(scan) == 10 and all(len(r["suggested_actions"]) == 4 for r in scan)
    # The scan hides the structural finding, which stays listed.
    hidden = next(r for r in scan if r["mismatch_detected"])
    assert hidden["root_cause"]["contributing_findings"] == ["ip_checksum_mismatch"]
    assert [r["first_seen"] for r in P.cap_reports(reports, 3).orderBy("first_seen").collect()] == [0, 1, 2]
    assert P.envelope(reports, 10).first()["truncated"] and not P.envelope(reports, 11).first()["truncated"]
    import json
    for r in report_json(reports).collect():
        assert set(json.loads(r["json"])) == {"flow", "packets", "anomaly_score", "anomaly", "mismatch_findings",
                                               "mismatch_detected", "root_cause", "suggested_actions"}
    text = P.text_report(reports).filter("first_seen = 0").first()["text"]
    assert text.splitlines()[0] == "[ANOMALY] score=0.9000 | 10.0.0.5:40000 -> 10.0.0.10:80 (proto 6) | packets=1"
    assert "  mismatches : none" in text
    reports.unpersist()


def test_captures_do_not_mix_and_empty_ones_give_nothing(spark):
    rows = [packet(i, dst=f"10.2.0.{i}", dport=7777, capture="a" if i < 4 else "b") for i in range(8)]
    got = P.diagnose_captures(packets(spark, rows), scores(spark, rows, 0.1)).collect()
    assert {r["root_cause"]["tag"] for r in got} == {"benign"}
    assert P.diagnose_captures(packets(spark, []), scores(spark, rows, 0.1).limit(0)).count() == 0


def test_unscored_flows_count_in_contexts_and_uncapped_packets_are_reported(spark):
    rows = [packet(i, dst=f"10.2.0.{i}", dport=7777) for i in range(8)] + [packet(100 + i, dst="10.2.0.0", dport=7777) for i in range(30)]
    one = scores(spark, rows[:1], 0.1)
    got = P.diagnose_captures(packets(spark, rows), one).collect()
    assert len(got) == 1 and got[0]["packets"] == 31
    assert got[0]["root_cause"]["tag"] == "port_scan_reconnaissance"


def test_plain_shape(spark):
    rows = [packet(i) for i in range(20)]
    got = P.plain_scores(packets(spark, rows), scores(spark, rows, 0.7), 0.8).drop("capture").first().asDict()
    assert got == {"flow": "10.0.0.5:40000 -> 10.0.0.10:80 (proto 6)", "score": 0.7, "anomaly": False, "packets": 20}


@pytest.mark.parametrize("tag", sorted(CAUSE_LABELS))
def test_every_cause_has_actions(tag):
    assert len(ACTIONS[tag]) >= 1


def test_action_table_is_editable_with_a_default(spark):
    causes = spark.createDataFrame([("benign",), ("new",)], "tag STRING")
    mine = action_table(spark).withColumn("actions", F.when(F.col("tag") == "benign", F.array(F.lit("rest"))).otherwise(F.col("actions")))
    got = {r["tag"]: r["actions"] for r in V.suggest_actions_from(causes, mine).collect()}
    assert got == {"benign": ["rest"], "new": ACTIONS["model_flagged_anomaly"]}
    assert set(CODE_TO_CAUSE.values()) < set(ACTIONS)


@pytest.mark.parametrize("heavy_keys", [1, 3, 10_000])
def test_lookup_join_with_a_hot_key(spark, heavy_keys):
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500).alias("k"))
    right = left.groupBy("k").agg(F.count(F.lit(1)).alias("w")).withColumn("v", F.col("k") * 2)
    right = right.filter("k <> 7")
    got = lookup_join(left, right, ["k"], "w", ["id"], heavy_keys=heavy_keys)
    assert got.count() == 6000
    assert got.filter("v IS NOT NULL AND v <> 2 * k").isEmpty()
    assert got.filter("v IS NULL AND k <> 7").isEmpty() and not got.filter("k = 7").isEmpty()
