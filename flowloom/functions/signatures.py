"""Payload signatures, the port registry and TCP flag tests, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowloom.schema import TCP

# Leading bytes of HTTP messages, TLS record types, SSH banner, DNS limits.
HTTP_PREFIXES = ["GET ", "POST ", "PUT ", "HEAD ", "DELETE ", "OPTIONS ", "HTTP/1."]
TLS_CONTENT_TYPES = [0x14, 0x15, 0x16, 0x17]
TLS_MAJOR = 0x03
SSH_BANNER = "SSH-"
DNS_HEADER_BYTES = 12
DNS_MAX_QUESTIONS = 16
DNS_MAX_ANSWERS = 64
DNS_OVERSIZE_BYTES = 300


def hex_at(payload: Column, start: int, n: int) -> Column:
    """Hex text of ``n`` bytes from 0-based ``start``."""
    return F.hex(F.substring(payload, start + 1, n))


def uint_at(payload: Column, start: int, n: int) -> Column:
    """Big-endian unsigned number of ``n`` bytes (n <= 7) from 0-based ``start``."""
    return F.conv(hex_at(payload, start, n), 16, 10).cast("bigint")


def has_prefix(payload: Column, text: str) -> Column:
    return hex_at(payload, 0, len(text)) == text.encode().hex().upper()


def looks_like_http(payload: Column) -> Column:
    head = hex_at(payload, 0, max(len(p) for p in HTTP_PREFIXES))
    tests = [head.startswith(p.encode().hex().upper()) for p in HTTP_PREFIXES]
    out = tests[0]
    for t in tests[1:]:
        out = out | t
    return out


def looks_like_tls(payload: Column) -> Column:
    return ((F.length(payload) >= 3)
            & hex_at(payload, 0, 1).isin([f"{t:02X}" for t in TLS_CONTENT_TYPES])
            & (hex_at(payload, 1, 1) == f"{TLS_MAJOR:02X}"))


def looks_like_ssh(payload: Column) -> Column:
    return has_prefix(payload, SSH_BANNER)


def looks_like_dns(payload: Column) -> Column:
    return F.when(F.length(payload) >= DNS_HEADER_BYTES,
                  (uint_at(payload, 4, 2) <= DNS_MAX_QUESTIONS)
                  & (uint_at(payload, 6, 2) <= DNS_MAX_ANSWERS)).otherwise(F.lit(False))


Signature = tuple[str, Callable[[Column], Column]]

# Port to (name, test). Pass a changed copy to the rules to extend it.
PORT_SIGNATURES: dict[int, Signature] = {
    80: ("http", looks_like_http),
    8080: ("http", looks_like_http),
    443: ("tls", looks_like_tls),
    22: ("ssh", looks_like_ssh),
    53: ("dns", looks_like_dns),
}


def port_signature(sport: Column, dport: Column, registry: dict[int, Signature] | None = None) -> Column:
    """Name of the signature expected on this pair of ports; the destination port wins."""
    registry = PORT_SIGNATURES if registry is None else registry
    if not registry:
        return F.lit(None).cast("string")
    names = F.create_map(*[F.lit(x) for port, (name, _) in registry.items() for x in (port, name)])
    return F.coalesce(F.try_element_at(names, dport), F.try_element_at(names, sport))


def signature_matches(name: Column, payload: Column, registry: dict[int, Signature] | None = None) -> Column:
    """True where the payload passes the named test; null for an unknown name."""
    registry = PORT_SIGNATURES if registry is None else registry
    tests = {name_: test for name_, test in registry.values()}
    out = F.lit(None).cast("boolean")
    for name_, test in tests.items():
        out = F.when(name == name_, test(payload)).otherwise(out)
    return out


# --- TCP flags arrive as letters (any order, repeats harmless) -------------------------

def has_flag(flags: Column, letter: str) -> Column:
    return flags.contains(letter)


def flags_are(flags: Column, letters: str) -> Column:
    """The set of flags is exactly ``letters``."""
    out = F.translate(flags, letters, "") == ""
    for letter in letters:
        out = out & flags.contains(letter)
    return out


def bare_syn(proto: Column, flags: Column) -> Column:
    return (proto == TCP) & flags_are(flags, "S")


def with_ack(proto: Column, flags: Column) -> Column:
    return (proto == TCP) & has_flag(flags, "A")


def flag_set(flags: Column) -> Column:
    """Distinct flag letters in order, as text."""
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(flags, ""), lambda c: c != ""))), "")
