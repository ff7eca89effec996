import base64
import json

from pyspark.sql import functions as F

from flowloom.plans.fixtures import wire_scores
from flowloom.plans.requests import answer_requests, responses
from tests.helpers import ipv4, pcap, tcp

HTTP = ipv4(6, tcp(b"GET / HTTP/1.1\r\n", flags=0x18))
SCAN = [ipv4(6, tcp(b"", 40000 + i, 20 + i, 2, src="10.0.0.66"), src="10.0.0.66") for i in range(10)]


def test_requests_end_to_end(spark):
    one, scan = pcap([HTTP]), pcap([HTTP, *SCAN])
    b64 = base64.b64encode(scan).decode()
    rows = [("raw", bytearray(one), None, None, None, None, None),
            ("text", None, b64, None, 0.9, None, 4),
            ("map", None, None, {"pcap_base64": b64}, None, False, None),
            ("bad", None, "12345", None, None, None, None),
            ("none", None, None, None, None, None, None),
            ("empty", bytearray(pcap([])), None, None, None, None, None)]
    df = spark.createDataFrame(rows, "request_id STRING, raw BINARY, b64 STRING, fields MAP<STRING,STRING>, "
                                     "threshold DOUBLE, diagnose BOOLEAN, max_flows INT")
    envelopes, results = answer_requests(df, lambda p: wire_scores(p).withColumn("score", F.lit(0.7)),
                                         raw="raw", text="b64", fields="fields")
    env = {r["capture"]: r for r in envelopes.collect()}
    assert {k: (r["n_flows"], r["truncated"]) for k, r in env.items() if r["error"] is None} == {
        "raw": (1, False), "text": (11, True), "map": (11, False), "empty": (0, False)}
    assert env["bad"]["error"] and env["none"]["error"] and env["bad"]["n_flows"] is None
    got = {}
    for r in results.orderBy("capture", "position").collect():
        got.setdefault(r["capture"], []).append(json.loads(r["json"]))
    assert {k: len(v) for k, v in got.items()} == {"raw": 1, "text": 4, "map": 11}
    raw = got["raw"][0]
    assert raw["anomaly"] and raw["root_cause"]["tag"] == "model_flagged_anomaly" and "threshold 0.50" in raw["root_cause"]["reasoning"][0]
    assert not got["text"][0]["anomaly"] and got["text"][0]["root_cause"]["tag"] == "benign"
    assert [r["root_cause"]["tag"] for r in got["text"][1:]] == ["port_scan_reconnaissance"] * 3
    assert set(got["map"][0]) == {"flow", "score", "anomaly", "packets"}


def test_bytes_that_are_no_capture_are_an_error(spark):
    good = pcap([ipv4(6, tcp(b"hi"))])
    df = spark.createDataFrame([("a", bytearray(good)), ("b", bytearray(b"hello")), ("c", None)], "request_id STRING, raw BINARY")
    envelopes, results = answer_requests(df, lambda p: wire_scores(p).withColumn("score", F.lit(0.7)), raw="raw",
                                         model={"name": "m"})
    got = {r["capture"]: r for r in envelopes.collect()}
    assert got["a"]["n_flows"] == 1 and got["a"]["error"] is None and got["a"]["model"] == '{"name": "m"}'
    assert "not a capture" in got["b"]["error"] and got["b"]["n_flows"] is None and got["c"]["error"]
    texts = {r["capture"]: json.loads(r["response"]) for r in responses(envelopes, results).collect()}
    assert set(texts["b"]) == set(texts["c"]) == {"error"}
    assert texts["a"]["n_flows"] == 1 and len(texts["a"]["results"]) == 1 and texts["a"]["model"] == {"name": "m"}
