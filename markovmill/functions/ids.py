"""Token ids of a fixed number of bytes, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ZERO = 0


def successor(token: Column, size: int = 3) -> Column:
    """The next id; the last one of `size` bytes (up to 7) is followed by 0."""
    return F.pmod(token.cast("bigint") + 1, F.lit(1 << (8 * size)))


def nth(n: Column, size: int = 3) -> Column:
    """The id n places after zero."""
    return F.pmod(n.cast("bigint"), F.lit(1 << (8 * size)))


def to_bytes(token: Column, size: int = 3) -> Column:
    """`size` bytes, the lowest first. Transitions of a file are in the order of these."""
    wide = F.lpad(F.hex(token.cast("bigint")), 2 * size, "0")
    return F.unhex(F.concat(*[F.substring(wide, 2 * (size - 1 - i) + 1, 2) for i in range(size)]))


def from_bytes(data: Column, size: int = 3) -> Column:
    wide = F.hex(data)
    return F.conv(F.concat(*[F.substring(wide, 2 * (size - 1 - i) + 1, 2) for i in range(size)]), 16, 10).cast("bigint")
