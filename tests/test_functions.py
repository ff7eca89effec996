import random

from pyspark.sql import functions as F

from flowloom.dimensions import PROTOCOL_NUMBERS
from flowloom.functions import signatures as G
from flowloom.functions import text as X
from flowloom.functions import tokens as K

c = F.col


def values(spark, rows, ddl, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*columns).collect()]


def test_tokens_of_every_length(spark):
    for n in (0, 1, 7, 64, 128, 300):
        raw = bytes(i % 256 for i in range(n))
        (got,), = values(spark, [(bytearray(raw),)], "p BINARY", K.tokenize(c("p")))
        assert got == [b + 3 for b in raw[:128]] + [0] * max(0, 128 - n)


def test_zero_byte_is_not_padding(spark):
    (got,), = values(spark, [(bytearray(b"\x00\x00"), 2)], "p BINARY, n INT", K.tokenize(c("p"), c("n"), 4))
    assert got == [3, 3, 0, 0]


def test_length_masks_and_extends(spark):
    rows = values(spark, [(bytearray(b"\x05\x06"), 1), (bytearray(b"\x05"), 3), (bytearray(b"\x05"), -2)],
                  "p BINARY, n INT", K.tokenize(c("p"), c("n"), 4))
    assert rows == [([8, 0, 0, 0],), ([8, 3, 3, 0],), ([0, 0, 0, 0],)]


def test_port_buckets(spark):
    cases = [("80", 1), ("1023", 1), ("1024", 2), ("49151", 2), ("49152", 3), ("-1", 0), ("x", 0), (None, 0), ("80.9", 0),
             (" 443 ", 1)]
    assert values(spark, cases, "p STRING, want INT", K.port_bucket(c("p")), "want") == [(w, w) for _, w in cases]


def test_protocol_numbers(spark):
    rows = [(n, v) for n, v in PROTOCOL_NUMBERS.items()] + [(" TCP ", 6), ("17", 17), ("6.0", 6), ("300", 300)]
    assert values(spark, rows, "p STRING, n INT", K.protocol_number(c("p")), "n") == [(v, v) for _, v in rows]
    (a,), (b,) = values(spark, [("zz",), ("ZZ ",)], "p STRING", K.protocol_number(c("p")))
    assert a == b and 256 <= a < 512


def test_protocol_id_wraps(spark):
    assert values(spark, [(132,), (6,), (-1,)], "n INT", K.protocol_id(c("n"))) == [(0,), (6,), (131,)]


def test_class_ids(spark):
    cases = [("normal", 0), ("Exploits", 4), (" worms\n", 9), ("", 0), ("-", 0), ("NaN", 0), (None, 0), ("normal_x", 0),
             ("something", 1)]
    assert values(spark, cases, "l STRING, w INT", K.class_id(c("l")), "w") == [(w, w) for _, w in cases]


def test_derived_packets(spark):
    cases = [("3", "4", 7), ("20", "1", 16), ("0", "0", 1), ("nan", None, 1), ("nan", "2", 2)]
    assert values(spark, cases, "s STRING, d STRING, w INT", K.derived_packets(c("s"), c("d")), "w") == [
        (w, w) for *_, w in cases]
    assert values(spark, [(1,)], "x INT", K.derived_packets(None, None)) == [(1,)]


def test_proxy_bytes_are_deterministic_and_differ_by_slot(spark):
    rows = values(spark, [("a", 1), ("a", 1), ("b", 1)], "x STRING, y INT",
                  K.proxy_bytes([c("x"), c("y")], F.lit(0), 128), K.proxy_bytes([c("x"), c("y")], F.lit(1), 40))
    assert rows[0] == rows[1] and rows[0] != rows[2]
    assert len(rows[0][0]) == 128 and len(rows[0][1]) == 40 and rows[0][0][:40] != rows[0][1]


def test_signatures(spark):
    dns = bytes.fromhex("123401000001000000000000")
    cases = [
        (b"GET / HTTP/1.1", (True, False, False, True)),
        (b"get / HTTP/1.1", (False, False, False, True)),
        (b"HTTP/1.1 200 OK", (True, False, False, True)),
        (b"OPTIONS *", (True, False, False, False)),
        (b"\x17\x03\x03\x00", (False, True, False, False)),
        (b"\x18\x03\x03\x00", (False, False, False, False)),
        (b"\x16\x03", (False, False, False, False)),
        (b"SSH-2.0", (False, False, True, False)),
        (dns, (False, False, False, True)),
        (dns[:11], (False, False, False, False)),
        (b"", (False, False, False, False)),
    ]
    p = c("p")
    got = values(spark, [(bytearray(b),) for b, _ in cases], "p BINARY", G.looks_like_http(p), G.looks_like_tls(p),
                 G.looks_like_ssh(p), G.looks_like_dns(p))
    for (raw, want), row in zip(cases, got):
        assert row[:3] == want[:3], raw
        if raw[:1] in (b"", b"\x12"):
            assert row[3] == want[3], raw


def test_dns_limits(spark):
    def message(qd, an):
        return bytearray(bytes(4) + qd.to_bytes(2, "big") + an.to_bytes(2, "big") + bytes(4))
    rows = [(message(16, 64), True), (message(17, 0), False), (message(0, 65), False)]
    assert values(spark, rows, "p BINARY, w BOOLEAN", G.looks_like_dns(c("p")), "w") == [(w, w) for _, w in rows]


def test_port_signature_prefers_destination_and_can_be_extended(spark):
    rows = [(22, 80), (53, 9999), (1, 2), (0, 443)]
    assert values(spark, rows, "s INT, d INT", G.port_signature(c("s"), c("d"))) == [
        ("http",), ("dns",), (None,), ("tls",)]
    mine = {**G.PORT_SIGNATURES, 2: ("mine", lambda p: G.has_prefix(p, "X"))}
    assert values(spark, rows, "s INT, d INT", G.port_signature(c("s"), c("d"), mine))[2] == ("mine",)


def test_flags(spark):
    rows = [("S",), ("SS",), ("SA",), ("RS",), ("SR",), ("RSF",), ("",)]
    got = values(spark, rows, "f STRING", G.flags_are(c("f"), "S"), G.flags_are(c("f"), "RS"), G.flag_set(c("f")))
    assert got == [(True, False, "S"), (True, False, "S"), (False, False, "AS"), (False, True, "RS"),
                   (False, True, "RS"), (False, False, "FRS"), (False, False, "")]


def test_numbers_print_the_exact_binary_value(spark):
    rng = random.Random(1)
    numbers = [0.125, 0.375, 0.905, 0.665, 0.995, 0.0005, 0.335, 0.0, 1.0, 2.5, -0.665, 123456.785]
    numbers += [round(rng.random() * 10 ** rng.randrange(4), rng.randrange(1, 6)) for _ in range(3000)]
    numbers += [rng.randrange(10 ** 6) / 2 ** rng.randrange(1, 20) for _ in range(1000)]
    rows = values(spark, [(x,) for x in numbers], "x DOUBLE", X.percent(c("x")), *[X.fixed(c("x"), n) for n in (2, 3, 4)],
                  X.exact_round(c("x"), 4))
    for x, row in zip(numbers, rows, strict=True):
        assert row == (f"{x:.0%}", f"{x:.2f}", f"{x:.3f}", f"{x:.4f}", round(x, 4)), x
