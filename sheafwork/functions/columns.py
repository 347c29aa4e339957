"""Scalar functions as Column expressions: they stay in the JVM, inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MASK32 = 0xFFFFFFFF


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def varint_size(c: Column | str) -> Column:
    """Bytes of a variable-length integer: 7 payload bits a byte up to 8 bytes, and 9 bytes beyond 2^56 - 1."""
    c, out = _col(c), F.lit(9)
    for n in range(8, 0, -1):
        out = F.when((c >= 0) & (c < F.lit(1 << (7 * n))), F.lit(n)).otherwise(out)
    return out.cast("int")


def wrap32(c: Column | str) -> Column:
    return _col(c).bitwiseAND(F.lit(MASK32))


def signed32(c: Column | str) -> Column:
    """An unsigned 32-bit value as a signed one, both in a long."""
    c = wrap32(c)
    return F.when(c >= F.lit(1 << 31), c - F.lit(1 << 32)).otherwise(c)


def zigzag32(c: Column | str) -> Column:
    """A signed 32-bit value to an unsigned one: 0, -1, 1, -2 become 0, 1, 2, 3."""
    c = _col(c)
    return wrap32(F.shiftleft(c, 1).bitwiseXOR(F.shiftright(c, 31)))


def unzigzag32(c: Column | str) -> Column:
    c = _col(c)
    return F.shiftrightunsigned(c, 1).bitwiseXOR(-c.bitwiseAND(F.lit(1)))


def width_class(c: Column | str) -> Column:
    """Class of a single integer by the bytes that it needs; 0, 1 and -1 need none."""
    c = _col(c)
    out = F.lit("8 bytes")
    for n in range(7, 0, -1):
        out = F.when(c < F.lit(1 << (8 * n)), F.lit(f"{n} byte" + "s" * (n > 1))).otherwise(out)
    out = F.when(c == 0, F.lit("zero")).when(c == 1, F.lit("one")).otherwise(out)
    return F.when(c == -1, F.lit("minus one")).when(c < 0, F.lit("negative")).otherwise(out)


def string_class(c: Column | str) -> Column:
    """Class of a single string by its bytes."""
    n = F.octet_length(_col(c))
    return F.when(n <= 3, n.cast("string")).otherwise(F.lit("N"))


def float_class(c: Column | str) -> Column:
    """Class of a single double: 0.0, 1.0, -1.0, NaN, or fixed. -0.0 is fixed, so that its sign is kept."""
    c = _col(c)
    negative_zero = (c == 0) & (F.concat(c.cast("string")).startswith("-"))
    return F.when(F.isnan(c), F.lit("nan")).when(negative_zero, F.lit("fixed")).when(c == 0, F.lit("zero")).when(c == 1, F.lit("one")).when(c == -1, F.lit("minus one")).otherwise(F.lit("fixed"))


def quantize(c: Column | str, tolerance: int) -> Column:
    """Round down to a multiple of 2^tolerance. Values too large to have such a fraction stay as they are."""
    c = _col(c)
    scaled = c * F.lit(2.0**-tolerance)
    return F.when(F.abs(scaled) < F.lit(2.0**53), F.floor(scaled).cast("double") * F.lit(2.0**tolerance)).otherwise(c)


def int_width(largest: Column | str) -> Column:
    """Type that a column of unsigned integers is lowered to, by its largest value."""
    c = _col(largest)
    return F.when(c.isNull(), F.lit("void")).when(c < 2, F.lit("bool")).when(c < 1 << 8, F.lit("u8")).when(c < 1 << 16, F.lit("u16")).when(c < F.lit(1 << 32), F.lit("u32")).otherwise(F.lit("u64"))
