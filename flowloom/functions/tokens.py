"""Payload bytes as tokens, and the header fields of a flow."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom import schema as S
from flowloom.dimensions import ATTACK_CLASSES, PROTOCOL_NUMBERS, lookup

# What str.strip removes from ASCII text.
WHITESPACE = " \t\n\r\x0b\x0c"


def strip_lower(value: Column) -> Column:
    return F.lower(F.trim(value.cast("string"), F.lit(WHITESPACE)))


def clip(value: Column, low: int, high: int) -> Column:
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def cut_payload(payload: Column, max_len: int = S.PAYLOAD_MAX_LEN) -> Column:
    return F.substring(payload, 1, max_len)


def cut_length(length: Column, max_len: int = S.PAYLOAD_MAX_LEN) -> Column:
    return clip(F.coalesce(length, F.lit(0)), 0, max_len).cast("int")


def byte_values(payload: Column) -> Column:
    """BINARY to ARRAY<INT> of 0..255: one character per byte in ISO-8859-1."""
    chars = F.split(F.decode(payload, "ISO-8859-1"), "")
    return (F.when(F.length(payload) > 0, F.transform(chars, lambda c: F.ascii(c)))
            .otherwise(F.array().cast("array<int>")))


def tokenize(payload: Column, length: Column | None = None, max_len: int = S.PAYLOAD_MAX_LEN) -> Column:
    """``3 + byte`` for the first ``length`` bytes, then PAD up to ``max_len``.

    Bytes missing from a payload shorter than its length count as zero bytes.
    """
    real = cut_length(F.length(payload) if length is None else length, max_len)
    tokens = F.transform(byte_values(F.substring(payload, F.lit(1), real)), lambda b: b + S.BYTE_OFFSET)
    zeros = F.array_repeat(F.lit(S.BYTE_OFFSET), F.greatest(F.lit(0), real - F.size(tokens)))
    return F.concat(tokens, zeros, F.array_repeat(F.lit(S.PAD_ID), F.lit(max_len) - real))


def port_bucket(port: Column) -> Column:
    """0 unusable, 1 system, 2 registered, 3 dynamic."""
    p = port.try_cast("bigint")
    return (F.when(p.isNull() | (p < 0), 0).when(p < 1024, 1).when(p < 49152, 2).otherwise(3)).cast("int")


def protocol_number(protocol: Column) -> Column:
    """Number, digit string or name to the protocol number; unknown names hash into 256..511. A column of whole
    numbers is taken as it is, negative ones too."""
    s = F.coalesce(strip_lower(protocol), F.lit("none"))
    digits = F.when(s.rlike("^[0-9]+(\\.0+)?$"), F.split_part(s, F.lit("."), F.lit(1)).try_cast("bigint"))
    hashed = F.conv(F.substring(F.md5(s), 1, 2), 16, 10).cast("bigint") + 256
    whole = F.when(F.typeof(protocol).isin("tinyint", "smallint", "int", "bigint"),
                   protocol.cast("string").try_cast("bigint"))
    return F.coalesce(whole, digits, lookup(PROTOCOL_NUMBERS, s).cast("bigint"), hashed)


def protocol_id(number: Column, vocab: int = S.PROTO_VOCAB) -> Column:
    return F.pmod(number, F.lit(vocab)).cast("int")


def class_id(label: Column) -> Column:
    s = F.coalesce(strip_lower(label), F.lit("none"))
    known = lookup({name: i for i, name in enumerate(ATTACK_CLASSES)}, s)
    return (F.when(s.isin("", "nan", "none", "-"), 0)
            .when(known.isNotNull(), known)
            .when(s.startswith("normal"), 0)
            .otherwise(1)).cast("int")


def label_binary(cls: Column) -> Column:
    return (cls != 0).cast("int")


def header_vector(proto_id: Column, sport: Column, dport: Column, npkts: Column) -> Column:
    return F.array(proto_id.cast("int"), port_bucket(sport), port_bucket(dport), npkts.cast("int"),
                   F.lit(0))


def derived_packets(spkts: Column | None, dpkts: Column | None,
                    max_packets: int = S.MAX_PACKETS_PER_FLOW) -> Column:
    """Packets of a tabular flow: both directions, clipped to 1..max; absent or bad counts are 0."""
    def count(c: Column | None) -> Column:
        return F.lit(0) if c is None else F.coalesce(c.try_cast("double").try_cast("bigint"), F.lit(0))
    return clip(count(spkts) + count(dpkts), 1, max_packets).cast("int")


def proxy_bytes(fields: list[Column], slot: Column, length: int = S.PAYLOAD_MAX_LEN) -> Column:
    """Deterministic pseudo-payload of a tabular row: SHA-256 blocks over the joined fields."""
    joined = [F.coalesce(f.cast("string"), F.lit("nan")) for f in fields]
    blocks = [F.sha2(F.concat_ws("|", *joined, slot.cast("string"), F.lit(str(block))), 256)
              for block in range((length + 31) // 32)]
    return F.substring(F.unhex(F.concat(*blocks)), 1, length)


def real_packet_count(packets: Column) -> Column:
    """Slots holding at least one byte; never below 1."""
    return F.greatest(F.lit(1), F.size(F.filter(packets, lambda p: p["length"] > 0)))
