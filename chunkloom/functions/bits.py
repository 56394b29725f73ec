"""Column expressions on integers and their bits; all are built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F


def canonical_zero(x: Column) -> Column:
    """-0.0 becomes 0.0, anything else stays."""
    return F.when(x == 0, F.lit(0.0).cast("double")).otherwise(x)


def double_bits(x: Column) -> Column:
    """The 64 bits of a double as a long."""
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("doubleToRawLongBits"), x.cast("double")).cast("long")


def bits_double(x: Column) -> Column:
    """The double that these 64 bits are."""
    return F.call_function("reflect", F.lit("java.lang.Double"), F.lit("longBitsToDouble"), x.cast("long")).cast("double")


def float_bits(x: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("floatToRawIntBits"), x.cast("float")).cast("int")


def bits_float(x: Column) -> Column:
    return F.call_function("reflect", F.lit("java.lang.Float"), F.lit("intBitsToFloat"), x.cast("int")).cast("float")


def wrapped_minus(a: Column, b: Column) -> Column:
    """a - b in two's complement of 64 bits, without overflow errors."""
    half = "9223372036854775808"
    wide = a.cast("decimal(38,0)") - b.cast("decimal(38,0)")
    turned = F.pmod(wide + F.lit(half).cast("decimal(38,0)"), F.lit("18446744073709551616").cast("decimal(38,0)")) - F.lit(half).cast("decimal(38,0)")
    return F.coalesce(F.try_subtract(a, b), turned.cast("long"))


def wrapped_sum(x: Column, window: WindowSpec) -> Column:
    """The sum of a 64-bit column over a window in two's complement: of its halves, which can't overflow within 2 ** 31 rows."""
    low = F.sum(x.cast("long").bitwiseAND(0xFFFFFFFF)).over(window)
    high = F.sum(F.shiftright(x.cast("long"), 32)).over(window) + F.shiftright(low, 32)
    return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF))


def zigzag(x: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ... (long)."""
    return F.shiftleft(x, 1).bitwiseXOR(F.shiftright(x, 63))


def unzigzag(u: Column) -> Column:
    return F.shiftrightunsigned(u, 1).bitwiseXOR(-u.bitwiseAND(1))


def bit_width(u: Column) -> Column:
    """Bits that an unsigned number needs; 0 for 0."""
    return F.when(u == 0, F.lit(0)).otherwise(F.length(F.bin(u))).cast("int")


def leb128_size(u: Column) -> Column:
    """Bytes of an unsigned number in base 128."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(u)) / F.lit(7.0))).cast("int")


def leb128_hex(u: Column) -> Column:
    """The bytes of an unsigned number in base 128, low first, as hex digits."""
    n = leb128_size(u)

    def digit(j: Column) -> Column:
        seven = F.call_function("shiftrightunsigned", u, (j * 7).cast("int")).bitwiseAND(127)
        return F.lpad(F.hex(seven + F.when(j == n - 1, F.lit(0)).otherwise(F.lit(128))), 2, "0")

    return F.array_join(F.transform(F.sequence(F.lit(0), n - 1), digit), "")


def byte_plane(u: Column, plane: Column) -> Column:
    """Byte number ``plane`` of a long, the lowest first."""
    return F.call_function("shiftrightunsigned", u, (plane * 8).cast("int")).bitwiseAND(255).cast("int")
