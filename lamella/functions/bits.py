"""Zigzag, width codes and fixed-width byte orders as Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bit widths by five-bit code: fixed values of the format.
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 13, 14, 15, 16, 17, 18, 19, 20, 21, 22, 23, 24, 26, 28, 30, 32, 40, 48, 56, 64)


def _col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def zigzag(value: Column | str, signed: bool = True) -> Column:
    """Small numbers of either sign as small codes. The code is an unsigned 64-bit number in a bigint, so the least bigint gives -1. unsigned: as it is."""
    v = _col(value).cast("bigint")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63)) if signed else v


def unzigzag(code: Column | str, signed: bool = True) -> Column:
    c = _col(code).cast("bigint")
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-(c.bitwiseAND(F.lit(1).cast("bigint")))) if signed else c


def zigzag_wide(value: Column | str) -> Column:
    """The 128-bit form within decimal(38,0): 2n for n >= 0, else -2n - 1. Values beyond 37 digits raise, as Spark's decimals end there."""
    v = _col(value).cast("decimal(37,0)")
    return F.when(v >= 0, v * 2).otherwise(-v * 2 - 1).cast("decimal(38,0)")


def unzigzag_wide(code: Column | str) -> Column:
    c = _col(code).cast("decimal(38,0)")
    half = F.floor(c / 2).cast("decimal(38,0)")
    return F.when(c % 2 == 0, half).otherwise(-half - 1).cast("decimal(38,0)")


def bit_width(code: Column | str) -> Column:
    """The width that a five-bit code (0..31) stands for; null beyond."""
    return F.try_element_at(F.array(*map(F.lit, WIDTHS)), _col(code).cast("int") + 1)


def unsigned_byte(value: Column | str) -> Column:
    """A signed byte as 0..255."""
    return _col(value).cast("smallint").bitwiseAND(F.lit(255).cast("smallint"))


def word24_le(b: Column | str, at: int = 1) -> Column:
    """The little-endian number in three bytes, from position `at` (1-based)."""
    b = _col(b)
    parts = [F.conv(F.hex(F.substring(b, at + i, 1)), 16, 10).cast("bigint") * (1 << 8 * i) for i in range(3)]
    return parts[0] + parts[1] + parts[2]


def word24_le_bytes(value: Column | str) -> Column:
    """A number below 2^24 as three little-endian bytes."""
    h = F.lpad(F.hex(_col(value).cast("bigint")), 6, "0")
    return F.unhex(F.concat(F.substring(h, 5, 2), F.substring(h, 3, 2), F.substring(h, 1, 2)))


def big_endian(b: Column | str, size: int, signed: bool = True) -> Column:
    """A big-endian number of `size` bytes (at most 8); signed: zigzag-coded."""
    b, v = _col(b), F.lit(0).cast("bigint")
    for i in range(size):
        v = F.shiftleft(v, 8).bitwiseOR(F.conv(F.hex(F.substring(b, i + 1, 1)), 16, 10).cast("bigint"))
    return unzigzag(v, signed)


def sign_magnitude(b: Column | str, size: int) -> Column:
    """A big-endian number whose top bit is its sign, as patched runs store their base."""
    v = big_endian(b, size, signed=False)
    top = 1 << (8 * size - 1)
    if size == 8:
        magnitude = v.bitwiseAND(F.lit(top - 1).cast("bigint"))
        return F.when(v < 0, -magnitude).otherwise(magnitude)
    magnitude = v.bitwiseAND(F.lit(top - 1).cast("bigint"))
    return F.when(v.bitwiseAND(F.lit(top).cast("bigint")) != 0, -magnitude).otherwise(magnitude)
