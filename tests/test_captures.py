import base64
import gzip
import struct

import pytest
from pyspark.sql import functions as F

from flowloom.functions.frames import header_fields, word_sum
from flowloom.plans import diagnose as P
from flowloom.session import scratch_path
from flowloom.sources import captures as C
from tests.helpers import checksum, ether, ip4, ipv4, pcap, pcapng, tcp, udp


def decode(spark, frames, link=228, **kw):
    rows = [("c", i, link, bytearray(f)) for i, f in enumerate(frames)]
    df = spark.createDataFrame(rows, "capture STRING, frame_no BIGINT, link_type INT, frame BINARY")
    return header_fields(df, **kw).orderBy("frame_no").collect()


def test_headers_of_all_protocols(spark):
    got = decode(spark, [ipv4(6, tcp(b"hi", 1234, 80, 0x12), ttl=9), ipv4(17, udp(b"q", 5, 53)), ipv4(1, b"\x08\x00ping")])
    assert [(r["src"], r["dst"], r["sport"], r["dport"], r["proto"], r["flags"], r["ttl"], bytes(r["payload"])) for r in got] == [
        ("10.0.0.5", "10.0.0.10", 1234, 80, 6, "SA", 9, b"hi"), ("10.0.0.5", "10.0.0.10", 5, 53, 17, "", 64, b"q"),
        ("10.0.0.5", "10.0.0.10", 0, 0, 1, "", 64, b"\x08\x00ping")]
    assert all(r["ip_checksum_ok"] and r["l4_checksum_ok"] for r in got)


def test_checksums_with_options_odd_lengths_and_damage(spark):
    good = [ipv4(6, tcp(bytes(range(n % 251))), options=b"\x01" * 4 * (n % 4)) for n in (0, 1, 7, 64, 128, 250)]
    good += [ipv4(6, tcp(b"abc", options=b"\x01" * 8)), ipv4(17, udp(b"odd"))]
    assert all(r["ip_checksum_ok"] and r["l4_checksum_ok"] for r in decode(spark, good))
    bad = decode(spark, [ipv4(6, tcp(), ip_sum=0x1234), ipv4(6, tcp(b"abc", l4_sum=0x1234)), ipv4(17, udp(b"x", l4_sum=1))])
    assert [(r["ip_checksum_ok"], r["l4_checksum_ok"]) for r in bad] == [(False, True), (True, False), (True, False)]


def test_udp_checksums_of_zero(spark):
    # A datagram whose computed sum is 0 travels as FFFF.
    body = checksum(ip4("10.0.0.5") + ip4("10.0.0.10") + b"\0\x11\0\x0a" + b"\0\x05\0\x35\0\x0a\0\0").to_bytes(2, "big")
    datagram = udp(body, 5, 53)
    assert datagram[6:8] == b"\xff\xff"
    assert decode(spark, [ipv4(17, datagram)])[0]["l4_checksum_ok"]
    unused = ipv4(17, udp(b"x", l4_sum=0))
    assert not decode(spark, [unused])[0]["l4_checksum_ok"]
    assert decode(spark, [unused], udp_zero_ok=True)[0]["l4_checksum_ok"]


def test_links_padding_and_other_traffic(spark):
    inner = ipv4(6, tcp(b"hi"))
    got = decode(spark, [ether(inner + b"\0" * 9), ether(inner, vlan=True), ether(b"\x60" * 60, kind=0x86DD), ether(inner, kind=0x0806)], link=1)
    assert [(r["frame_no"], bytes(r["payload"])) for r in got] == [(0, b"hi"), (1, b"hi")]
    assert len(decode(spark, [inner], link=101)) == 1 and len(decode(spark, [inner], link=147)) == 0
    assert len(decode(spark, [b"\0\0" + b"\0" * 12 + b"\x08\0" + inner], link=113)) == 1
    assert decode(spark, [b"", inner[:10]]) == []


def test_later_fragments_have_no_ports(spark):
    got = decode(spark, [ipv4(6, tcp(b"hi"), frag=5)])[0]
    assert (got["sport"], got["dport"], got["flags"], got["l4_checksum_ok"]) == (0, 0, "", True)
    assert len(got["payload"]) == 22


def write(folder, files):
    import os
    os.makedirs(folder)
    for name, data in files.items():
        with open(f"{folder}/{name}", "wb") as f:
            f.write(data)
    return folder


def test_reader_formats_chunks_and_bad_files(spark):
    frames = [ipv4(6, tcp(bytes([i]) * i, 1000 + i, 80)) for i in range(50)]
    folder = write(scratch_path(spark, "t-pcap"), {
        "little.pcap": pcap(frames), "big.pcap": pcap(frames, order=">"), "nano.pcap": pcap(frames, magic=0xA1B23C4D),
        "new.pcapng": pcapng([ether(f) for f in frames]), "newbig.pcapng": pcapng([ether(f) for f in frames], order=">"),
        "cut.pcap": pcap(frames[:3])[:-5], "empty.pcap": pcap([]), "bad.pcap": b"hello"})
    index = C.index_captures(spark, folder, chunk_bytes=500)
    bad = index.filter("error IS NOT NULL").collect()
    assert len(bad) == 1 and bad[0]["capture"].endswith("bad.pcap")
    assert index.filter("capture LIKE '%little%'").count() > 3
    with pytest.raises(C.CaptureError, match="bad.pcap"):
        C.read_captures(spark, folder)
    got, errors = C.read_captures(spark, folder, 500, on_error="keep")
    assert [r["capture"].rsplit("/", 1)[-1] for r in errors.collect()] == ["bad.pcap"]
    whole, _ = C.read_captures(spark, folder, on_error="keep")
    assert got.exceptAll(whole).isEmpty() and whole.exceptAll(got).isEmpty()
    rows = whole.withColumn("file", F.regexp_extract("capture", "[^/]+$", 0)).orderBy("file", "arrival").collect()
    for name in ("little.pcap", "big.pcap", "nano.pcap", "new.pcapng", "newbig.pcapng"):
        mine = [r for r in rows if r["file"] == name]
        assert [(r["arrival"], r["sport"], len(r["payload"])) for r in mine] == [(i, 1000 + i, i) for i in range(50)], name
        assert all(r["ip_checksum_ok"] and r["l4_checksum_ok"] for r in mine)
        if name != "nano.pcap":
            assert [r["ts_us"] for r in mine] == [(1000 + i) * 10**6 + 7 for i in range(50)]
    assert len([r for r in rows if r["file"] == "cut.pcap"]) == 3


def _blocks(frames, kind=6, interface=0, order="<"):
    """Frame blocks of a newer capture, of either kind."""
    out = b""
    for i, f in enumerate(frames):
        ts = (1000 + i) * 10**6 + 7
        head = struct.pack(order + ("I" if kind == 6 else "HH"), *((interface,) if kind == 6 else (interface, 0)))
        body = head + struct.pack(order + "IIII", ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f
        body += b"\0" * (-len(body) % 4)
        out += struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    return out


def test_old_blocks_and_compressed_files(spark):
    frames = [ether(ipv4(6, tcp(bytes([i]) * i, 1000 + i, 80))) for i in range(20)]
    folder = write(scratch_path(spark, "t-pcap"), {
        "old.cap": pcapng([]) + _blocks(frames, kind=2), "oldbig.cap": pcapng([], order=">") + _blocks(frames, 2, order=">"),
        "packed.cap": gzip.compress(pcap(frames, link=1)), "packednew.cap": gzip.compress(pcapng(frames)),
        "mixed.cap": pcapng(frames[:10]) + _blocks(frames[10:], kind=2)})
    rows = C.read_captures(spark, folder, chunk_bytes=300).collect()
    for name in ("old", "oldbig", "packed", "packednew", "mixed"):
        mine = sorted((r["arrival"], r["sport"], len(r["payload"])) for r in rows if r["capture"].endswith(f"/{name}.cap"))
        assert mine == [(i, 1000 + i, i) for i in range(20)], name


@pytest.mark.parametrize("name, data, reason", [
    ("block", pcapng([b"x" * 60]) + struct.pack("<III", 6, 5, 5) + _blocks([b"y" * 60]), "block length 5"),
    ("interface", pcapng([b"x" * 60]) + _blocks([b"y" * 60], interface=3), "names interface 3 of 1"),
    ("oldinterface", pcapng([b"x" * 60]) + _blocks([b"y" * 60], kind=2, interface=9), "names interface 9 of 1"),
    ("gzip", gzip.compress(pcap([b"x" * 600]))[:-20], "EOFError"), ("text", b"hello", "not a capture file")])
def test_broken_captures_are_errors_as_a_whole(spark, name, data, reason):
    good = pcap([ipv4(6, tcp(b"hi"))])
    folder = write(scratch_path(spark, "t-pcap"), {"good.pcap": good, f"{name}.cap": data})
    with pytest.raises(C.CaptureError, match=reason):
        C.read_captures(spark, folder)
    packets, errors = C.read_captures(spark, folder, on_error="keep")
    assert packets.count() == 1
    assert [reason in r["error"] for r in errors.collect()] == [True]


def test_labels_and_sessions_before_the_address(spark):
    inner = ipv4(6, tcp(b"hi"))
    def label(last):
        return struct.pack(">I", 77 << 12 | (0x100 if last else 0) | 64)
    frames = [ether(label(True) + inner, kind=0x8847), ether(label(False) + label(True) + inner, kind=0x8847),
              ether(label(True) + b"\x60" * 60, kind=0x8847), ether(label(False) * 9 + inner, kind=0x8847),
              ether(b"\x11\0\0\1\0\x50\0\x21" + inner, kind=0x8864), ether(b"\x11\0\0\1\0\x50\0\x57" + inner, kind=0x8864)]
    assert [r["frame_no"] for r in decode(spark, frames, link=1)] == [0, 1, 4]
    assert len(decode(spark, [b"\0\0\0\2" + inner], link=108)) == 1


def test_no_python_checksum_per_packet(spark):
    segments = [b"", b"\1", b"\1\2\3", bytes(range(256)) * 250, None]
    df = spark.createDataFrame([(i, None if s is None else bytearray(s)) for i, s in enumerate(segments)], "i INT, s BINARY")
    got = {r["i"]: r["t"] for r in df.select("i", word_sum("s").alias("t")).collect()}
    for i, s in enumerate(segments):
        padded = None if s is None else s + b"\0" * (len(s) % 2)
        assert got[i] == (None if s is None else sum(struct.unpack(f">{len(padded) // 2}H", padded)))


def test_raw_bytes_under_a_map_key(spark):
    data = pcap([ipv4(6, tcp(b"hi"))])
    df = spark.createDataFrame([(1, {"pcap": bytearray(data)}), (2, {"pcap_base64": bytearray(b""), "pcap": bytearray(data)}),
                                (3, {"other": bytearray(data)})], "id INT, fields MAP<STRING,BINARY>")
    got = {r["id"]: r for r in C.decode_captures(df, fields="fields").collect()}
    assert bytes(got[1]["content"]) == bytes(got[2]["content"]) == data and got[3]["error"]


def test_capture_to_report(spark):
    frames = [ipv4(6, tcp(b"GET / HTTP/1.1\r\n", flags=0x18))]
    frames += [ipv4(6, tcp(b"", 40000 + i, 20 + i, 2, src="10.0.0.66"), src="10.0.0.66") for i in range(10)]
    packets = C.read_captures(spark, write(scratch_path(spark, "t-pcap"), {"scan.pcap": pcap(frames)}))
    from flowloom.plans.fixtures import wire_scores
    got = P.diagnose_captures(packets, wire_scores(packets).withColumn("score", F.lit(0.1))).collect()
    assert len(got) == 11
    assert sum(r["root_cause"]["tag"] == "port_scan_reconnaissance" for r in got) == 10
    assert not any(r["mismatch_detected"] for r in got)


def test_request_columns(spark):
    data = pcap([ipv4(6, tcp(b"hi"))])
    text = base64.b64encode(data).decode()
    rows = [(1, bytearray(data), None, None), (2, None, text, None), (3, None, None, {"pcap_base64": text}),
            (4, None, None, {"pcap": text}), (5, None, "!!", None), (6, None, None, {"other": text}),
            (7, None, text + "\n", None), (8, None, text[:-1], None), (9, None, None, {"pcap_base64": "", "pcap": text}),
            (10, None, "", None)]
    df = spark.createDataFrame(rows, "id INT, raw BINARY, b64 STRING, fields MAP<STRING,STRING>")
    got = {r["id"]: r for r in C.decode_captures(df, "raw", "b64", "fields").collect()}
    assert [i for i, r in got.items() if r["error"] is None] == [1, 2, 3, 4, 9, 10]
    assert all(bytes(got[i]["content"]) == data for i in (1, 2, 3, 4, 9))
    frames = C.frames_of_content(C.decode_captures(df, "raw", "b64", "fields"), "id")
    assert frames.filter("error IS NULL").count() == 5
    assert [r["capture"] for r in frames.filter("error IS NOT NULL").collect()] == ["10"]
    newer = spark.createDataFrame([("n", bytearray(pcapng([ether(ipv4(6, tcp(b"hi")))] * 3)))], "id STRING, content BINARY")
    assert [r["frame_no"] for r in C.frames_of_content(newer, "id").collect()] == [0, 1, 2]
