"""Number formatting as printed from the exact binary value, and the display form of a flow key."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Cuts a double into two halves whose products are exact.
_SPLITTER = 134217729.0


def _halves(x: Column) -> tuple[Column, Column]:
    scaled = x * _SPLITTER
    high = scaled - (scaled - x)
    return high, x - high


def exact_round(value: Column, digits: int) -> Column:
    """Round the exact binary value to ``digits`` decimals; only a true tie goes to even.

    ``value * 10**digits`` is taken without error as product plus remainder, so 0.665, which lies above 0.665
    in binary, becomes 0.67, and 0.995, which lies below, 0.99.
    """
    x, scale = F.abs(value.cast("double")), 10.0 ** digits
    product = x * scale
    (x1, x2), (s1, s2) = _halves(x), _halves(F.lit(scale))
    remainder = ((x1 * s1 - product) + x1 * s2 + x2 * s1) + x2 * s2
    down = F.floor(product).cast("double")
    part = product - down
    up = (part > 0.5) | ((part == 0.5) & ((remainder > 0) | ((remainder == 0) & (down % 2 == 1))))
    steps = F.when(product >= 2.0 ** 52, product).when(up, down + 1).otherwise(down)
    return F.when(value < 0, -steps / scale).otherwise(steps / scale)


def fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of the exact binary value."""
    return F.format_string(f"%.{digits}f", exact_round(value, digits))


def percent(ratio: Column) -> Column:
    return F.concat(exact_round(ratio * 100, 0).cast("bigint").cast("string"), F.lit("%"))


def flow_key(src: Column, sport: Column, dst: Column, dport: Column, proto: Column) -> Column:
    """``src:sport -> dst:dport (proto p)``; directed."""
    return F.concat(src, F.lit(":"), sport.cast("string"), F.lit(" -> "), dst, F.lit(":"),
                    dport.cast("string"), F.lit(" (proto "), proto.cast("string"), F.lit(")"))


def fill(template: str, *args: Column) -> Column:
    """Fill ``{}`` slots of a message template with columns."""
    parts = template.split("{}")
    out: list[Column] = [F.lit(parts[0])]
    for arg, text in zip(args, parts[1:], strict=True):
        out += [arg.cast("string"), F.lit(text)]
    return F.concat(*out)
