"""Captured frames (BINARY) to header fields and checksum flags.

All fields are byte offsets into the frame, so the decode stays in native
expressions. Only the 16-bit word sum over whole segments goes through an Arrow
UDF: a higher-order function over up to 65,535 bytes per packet costs far more
than one vectorised sum.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowloom.functions.signatures import hex_at, uint_at
from flowloom.schema import TCP, UDP

# Link types, EtherTypes and flag letters (lowest bit first).
LINK_NULL, LINK_ETHERNET, LINK_RAW_BSD, LINK_RAW, LINK_LOOP = 0, 1, 12, 101, 108
LINK_SLL, LINK_IPV4, LINK_SLL2 = 113, 228, 276
ETHERTYPE_IPV4 = 0x0800
ETHERTYPES_VLAN = [0x8100, 0x88A8]
ETHERTYPE_MPLS, ETHERTYPE_PPPOE, PPP_IPV4 = 0x8847, 0x8864, 0x0021
MPLS_LABELS = 4
FLAG_LETTERS = "FSRPAUECN"


def ip_offset(frame: Column, link_type: Column) -> Column:
    """0-based start of the IPv4 header, null where the frame carries none.

    Types are compared as hex text, which is cheaper than turning them into numbers.
    """
    def kind_is(at: int, *kinds: int) -> Column:
        return hex_at(frame, at, 2).isin([f"{k:04X}" for k in kinds])

    # The bottom label has the lowest bit of its third byte set; an IPv4 header must follow.
    mpls = F.lit(None).cast("int")
    for k in reversed(range(MPLS_LABELS)):
        bottom = F.substring(hex_at(frame, 14 + 4 * k + 2, 1), 2, 1).isin(*"13579BDF")
        version = F.substring(hex_at(frame, 18 + 4 * k, 1), 1, 1) == "4"
        mpls = F.when(bottom, F.when(version, 18 + 4 * k)).otherwise(mpls)
    tagged, twice = kind_is(12, *ETHERTYPES_VLAN), kind_is(16, *ETHERTYPES_VLAN)
    return (F.when(link_type.isin(LINK_RAW, LINK_IPV4, LINK_RAW_BSD), 0)
            .when((link_type == LINK_ETHERNET) & kind_is(12, ETHERTYPE_IPV4), 14)
            .when((link_type == LINK_ETHERNET) & tagged & kind_is(16, ETHERTYPE_IPV4), 18)
            .when((link_type == LINK_ETHERNET) & tagged & twice & kind_is(20, ETHERTYPE_IPV4), 22)
            .when((link_type == LINK_ETHERNET) & kind_is(12, ETHERTYPE_PPPOE) & kind_is(20, PPP_IPV4), 22)
            .when((link_type == LINK_ETHERNET) & kind_is(12, ETHERTYPE_MPLS), mpls)
            .when(link_type.isin(LINK_NULL, LINK_LOOP), 4)
            .when((link_type == LINK_SLL) & kind_is(14, ETHERTYPE_IPV4), 16)
            .when((link_type == LINK_SLL2) & kind_is(0, ETHERTYPE_IPV4), 20)
            .cast("int"))


def ipv4_only(frames: DataFrame) -> DataFrame:
    """Keep frames with an IPv4 header; adds ``ip`` (the bytes from that header on)."""
    first = F.hex(F.expr("substring(frame, _ip_at + 1, 1)"))
    return (frames.withColumn("_ip_at", ip_offset(F.col("frame"), F.col("link_type")))
            .filter((F.length("frame") >= F.col("_ip_at") + 20) & first.between("45", "4F"))
            .withColumn("ip", F.expr("substring(frame, _ip_at + 1)")).drop("_ip_at"))


@F.pandas_udf(T.LongType())
def word_sum(data: pd.Series) -> pd.Series:
    """Sum of big-endian 16-bit words; an odd last byte is padded with zero."""
    there = data.notna()
    # All segments of a batch in one buffer, each followed by a zero word so that none is empty.
    padded = [raw + (b"\0\0" if len(raw) % 2 == 0 else b"\0\0\0") for raw in data[there]]
    sums = pd.Series(pd.NA, index=data.index, dtype="Int64")
    if padded:
        words = np.frombuffer(b"".join(padded), dtype=">u2").astype(np.int64)
        sizes = np.array([len(p) // 2 for p in padded])
        sums[there] = np.add.reduceat(words, np.cumsum(sizes) - sizes)
    return sums


def header_word_sum(data: Column, start: int, stop: int) -> Column:
    """Word sum of the bytes ``start``..``stop`` modulo 65535, as far as ``data`` reaches.

    Six bytes are read as one number: 2**16 is 1 modulo 65535, so its value equals the
    sum of its three words there.
    """
    parts = [F.coalesce(uint_at(data, i, 6), F.lit(0)) for i in range(start, stop, 6)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def ones_complement(total: Column) -> Column:
    """Checksum of a positive word sum: carries folded, bits inverted."""
    return F.lit(0xFFFE) - F.pmod(total - 1, F.lit(0xFFFF))


def bits(number: Column, shift: int, width: int) -> Column:
    """``width`` bits of a number from bit ``shift`` on."""
    return F.shiftright(number, shift).bitwiseAND((1 << width) - 1)


def dotted(address: Column) -> Column:
    return F.concat_ws(".", *[bits(address, s, 8).cast("string") for s in (24, 16, 8, 0)])


def _header_numbers(ipv4: DataFrame) -> DataFrame:
    """Working columns of an IPv4 frame. Headers are read as a few wide numbers, and the
    fields cut out of those by shifts, since turning bytes into a number is the dear step."""
    c = F.col
    rows = (ipv4.withColumn("_a", uint_at(c("ip"), 0, 6))       # version, length, total length, id
            .withColumn("_b", uint_at(c("ip"), 6, 6))           # fragment, TTL, protocol, checksum
            .withColumn("_src", uint_at(c("ip"), 12, 4)).withColumn("_dst", uint_at(c("ip"), 16, 4))
            .withColumns({"_ihl": bits(c("_a"), 40, 4).cast("int") * 4, "_total": bits(c("_a"), 16, 16).cast("int"),
                          "_first": bits(c("_b"), 32, 13) == 0, "_ttl": bits(c("_b"), 24, 8).cast("int"),
                          "proto": bits(c("_b"), 16, 8).cast("int"), "_ip_stored": bits(c("_b"), 0, 16)})
            .withColumn("_rest", F.when(c("_total") >= c("_ihl"), c("_total") - c("_ihl")).otherwise(F.length("ip")))
            .withColumn("_l4", F.expr("substring(ip, _ihl + 1, _rest)"))
            .withColumns({"_tcp": c("_first") & (c("proto") == TCP) & (F.length("_l4") >= 20),
                          "_udp": c("_first") & (c("proto") == UDP) & (F.length("_l4") >= 8)})
            .withColumn("_c", F.when(c("_tcp") | c("_udp"), uint_at(c("_l4"), 0, 6)))    # ports, UDP length
            .withColumn("_d", F.when(c("_tcp"), uint_at(c("_l4"), 12, 6))                # offset, flags, TCP checksum
                        .when(c("_udp"), uint_at(c("_l4"), 6, 2))))                      # UDP checksum
    return rows.withColumns({
        "_doff": F.greatest(F.lit(20), bits(c("_d"), 44, 4).cast("int") * 4), "_ulen": bits(c("_c"), 0, 16).cast("int"),
        "_l4_stored": bits(c("_d"), 0, 16)})


def with_checksums(rows: DataFrame, udp_zero_ok: bool = False) -> DataFrame:
    """Add both checksum flags to the working columns. A packet without a transport
    checksum counts as good."""
    c = F.col
    udp = c("proto") == UDP
    options = F.when(c("_ihl") > 20, header_word_sum(F.expr("substring(ip, 1, _ihl)"), 20, 60)).otherwise(F.lit(0))
    length = F.when(c("_total") >= c("_ihl"), c("_total") - c("_ihl")).otherwise(F.length("_l4"))
    segment = word_sum(F.when(c("_l4_stored").isNotNull(), c("_l4")))
    rows = (rows.withColumn("_ip_sum", c("_a") + c("_b") + c("_src") + c("_dst") + options)
            .withColumn("_l4_sum", c("_src") + c("_dst") + c("proto") + length + segment)
            .withColumn("_l4_want", ones_complement(c("_l4_sum") - c("_l4_stored"))))
    # A computed UDP checksum of 0 is sent as all ones.
    want = F.when(udp & (c("_l4_want") == 0), 0xFFFF).otherwise(c("_l4_want"))
    l4_ok = c("_l4_stored").isNull() | (c("_l4_stored") == want)
    if udp_zero_ok:
        l4_ok = l4_ok | (udp & (c("_l4_stored") == 0))
    return rows.withColumns({
        "ip_checksum_ok": ones_complement(c("_ip_sum") - c("_ip_stored")) == c("_ip_stored"),
        "l4_checksum_ok": l4_ok})


def header_fields(frames: DataFrame, udp_zero_ok: bool = False, checksums: bool = True) -> DataFrame:
    """IPv4 frames to packet rows: addresses, ports, flags, TTL, payload and checksum flags.

    TCP and UDP need offset 0 in the fragment field and a whole header; everything
    else keeps ports 0 and the IP payload. Columns of ``frames`` other than the raw
    bytes are kept.
    """
    c = F.col
    keep = [n for n in frames.columns if n not in ("frame", "link_type")]
    rows = _header_numbers(ipv4_only(frames))
    letters = [F.when(bits(c("_d"), 32 + i, 1) == 1, letter).otherwise("") for i, letter in enumerate(FLAG_LETTERS)]
    payload = (F.when(c("_tcp"), F.expr("substring(_l4, _doff + 1)"))
               .when(c("_udp") & (c("_ulen") >= 8), F.expr("substring(_l4, 9, _ulen - 8)"))
               .when(c("_udp"), F.expr("substring(_l4, 9)"))
               .otherwise(c("_l4")))
    out = [*keep, dotted(c("_src")).alias("src"), dotted(c("_dst")).alias("dst"),
           F.coalesce(bits(c("_c"), 32, 16), F.lit(0)).cast("int").alias("sport"),
           F.coalesce(bits(c("_c"), 16, 16), F.lit(0)).cast("int").alias("dport"),
           c("proto"),
           F.when(c("_tcp"), F.concat(*letters)).otherwise("").alias("flags"),
           c("_ttl").alias("ttl"), payload.alias("payload")]
    if checksums:
        rows = with_checksums(rows, udp_zero_ok)
        out += [c("ip_checksum_ok"), c("l4_checksum_ok")]
    return rows.select(*out)
