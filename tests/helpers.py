"""Small packet tables and hand-made capture files."""

from __future__ import annotations

import struct

from flowloom.schema import FLOW_KEY, WIRE_SCHEMA


def packet(arrival, src="10.0.0.5", dst="10.0.0.10", sport=40000, dport=80, proto=6, flags="A", ttl=64, payload=b"",
           ip_ok=True, l4_ok=True, capture="c"):
    return (capture, arrival, src, dst, sport, dport, proto, flags, ttl, bytearray(payload), ip_ok, l4_ok)


def packets(spark, rows):
    return spark.createDataFrame(rows, WIRE_SCHEMA)


def scores(spark, rows, score):
    """The same score for every flow of packet rows."""
    keys = {(r[0], r[2], r[4], r[3], r[5], r[6]) for r in rows}
    return spark.createDataFrame([(*k, float(score)) for k in sorted(keys)],
                                 "capture STRING, src STRING, sport INT, dst STRING, dport INT, proto INT, score DOUBLE"
                                 ).select(*FLOW_KEY, "score")


def checksum(data: bytes) -> int:
    if len(data) % 2:
        data += b"\0"
    total = sum(struct.unpack(f">{len(data) // 2}H", data))
    while total >> 16:
        total = (total & 0xFFFF) + (total >> 16)
    return ~total & 0xFFFF


def ip4(address: str) -> bytes:
    return bytes(int(x) for x in address.split("."))


def ipv4(proto, l4, src="10.0.0.5", dst="10.0.0.10", ttl=64, ip_sum=None, options=b"", frag=0):
    ihl = 5 + len(options) // 4
    head = struct.pack(">BBHHHBBH4s4s", 0x40 | ihl, 0, ihl * 4 + len(l4), 1, frag, ttl, proto, 0, ip4(src), ip4(dst)) + options
    total = checksum(head) if ip_sum is None else ip_sum
    return head[:10] + struct.pack(">H", total) + head[12:] + l4


def tcp(payload=b"", sport=40000, dport=80, flags=0x10, src="10.0.0.5", dst="10.0.0.10", l4_sum=None, options=b""):
    offset = (20 + len(options)) // 4
    seg = struct.pack(">HHIIHHHH", sport, dport, 1, 0, offset << 12 | flags, 8192, 0, 0) + options + payload
    total = checksum(ip4(src) + ip4(dst) + struct.pack(">HH", 6, len(seg)) + seg) if l4_sum is None else l4_sum
    return seg[:16] + struct.pack(">H", total) + seg[18:]


def udp(payload=b"", sport=40000, dport=53, src="10.0.0.5", dst="10.0.0.10", l4_sum=None):
    seg = struct.pack(">HHHH", sport, dport, 8 + len(payload), 0) + payload
    total = checksum(ip4(src) + ip4(dst) + struct.pack(">HH", 17, len(seg)) + seg) or 0xFFFF
    return seg[:6] + struct.pack(">H", total if l4_sum is None else l4_sum) + seg[8:]


def ether(packet_bytes, kind=0x0800, vlan=False):
    tag = struct.pack(">HH", 0x8100, 10) if vlan else b""
    return b"\2\0\0\0\0\1\2\0\0\0\0\2" + tag + struct.pack(">H", kind) + packet_bytes


def pcap(frames, link=228, order="<", magic=0xA1B2C3D4):
    out = struct.pack(order + "IHHiIII", magic, 2, 4, 0, 0, 65535, link)
    for i, f in enumerate(frames):
        out += struct.pack(order + "IIII", 1000 + i, 7, len(f), len(f)) + f
    return out


def pcapng(frames, link=1, order="<"):
    def block(kind, body):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, 12 + len(body)) + body + struct.pack(order + "I", 12 + len(body))
    out = block(0x0A0D0D0A, struct.pack(order + "IHHq", 0x1A2B3C4D, 1, 0, -1))
    out += block(1, struct.pack(order + "HHI", link, 0, 65535))
    for i, f in enumerate(frames):
        ts = (1000 + i) * 10**6 + 7
        out += block(6, struct.pack(order + "IIIII", 0, ts >> 32, ts & 0xFFFFFFFF, len(f), len(f)) + f)
    return out
