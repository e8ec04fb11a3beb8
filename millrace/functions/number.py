"""Arithmetic, rounding and bits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def floor_div(a: Column, b: Column) -> Column:
    """Integer quotient, rounded down."""
    return F.call_function("div", a - modulo(a, b), b)


def modulo(a: Column, b: Column) -> Column:
    """Remainder with the divisor's sign, the partner of floor_div."""
    r = a % b
    return F.when((r != 0) & ((r < 0) != (b < 0)), r + b).otherwise(r)


def close(a: Column, b: Column, eps: float = 2.220446049250313e-16) -> Column:
    """Equality of floating-point numbers up to a relative epsilon."""
    return F.abs(a - b) <= F.lit(eps) * F.greatest(F.lit(1.0), F.abs(a), F.abs(b))


def root(c: Column) -> Column:
    """Square root; null for negative numbers."""
    return F.when(c >= 0, F.sqrt(c))


def log(c: Column, base: float) -> Column:
    return F.when(c > 0, F.ln(c) / F.ln(F.lit(float(base))))


def round_to(c: Column, precision: int = 0) -> Column:
    """Half away from zero."""
    return F.round(c, precision)


#: Name -> function of a number: the elementary functions, all in radians.
ELEMENTARY = {
    "abs": F.abs, "arccos": F.acos, "arccosh": F.acosh, "arcsin": F.asin, "arcsinh": F.asinh, "arctan": F.atan, "arctanh": F.atanh,
    "cbrt": F.cbrt, "ceil": F.ceil, "cos": F.cos, "cosh": F.cosh, "exp": F.exp, "floor": F.floor, "ln": F.ln, "log1p": F.log1p,
    "sign": F.signum, "sin": F.sin, "sinh": F.sinh, "sqrt": root, "tan": F.tan, "tanh": F.tanh,
}


def elementary(name: str, c: Column, degrees: bool = False) -> Column:
    """An elementary function; with `degrees`, angles in degrees."""
    if degrees and name in ("sin", "cos", "tan"):
        c = F.radians(c)
    out = ELEMENTARY[name](c)
    return F.degrees(out) if degrees and name.startswith("arc") else out


def _mask(bits: int) -> int:
    return (1 << bits) - 1 if bits < 64 else -1


def bits_not(c: Column, bits: int = 64) -> Column:
    """Flip all bits of a number of the given width; unsigned below 64 bits."""
    return F.bitwise_not(c).bitwiseAND(F.lit(_mask(bits)))


def shift_left(c: Column, by: int, bits: int = 64) -> Column:
    return F.shiftleft(c.cast("long"), by).bitwiseAND(F.lit(_mask(bits)))


def shift_right(c: Column, by: int) -> Column:
    return F.shiftright(c.cast("long"), by)


def rotate_left(c: Column, by: int, bits: int = 64) -> Column:
    """Rotate the lowest `bits` bits."""
    by %= bits
    x = c.cast("long").bitwiseAND(F.lit(_mask(bits)))
    return x if not by else F.shiftleft(x, by).bitwiseOR(F.shiftrightunsigned(x, bits - by)).bitwiseAND(F.lit(_mask(bits)))


def rotate_right(c: Column, by: int, bits: int = 64) -> Column:
    return rotate_left(c, bits - by % bits, bits)


def count_ones(c: Column) -> Column:
    return F.bit_count(c)


def count_zeros(c: Column, bits: int = 64) -> Column:
    return F.lit(bits) - F.bit_count(c)


def _padded(c: Column, bits: int) -> Column:
    return F.substring(F.lpad(F.bin(c.cast("long")), 64, "0"), 65 - bits, bits)


def leading(c: Column, digit: str, bits: int = 64) -> Column:
    """How many of the highest bits equal the digit."""
    return F.char_length(F.regexp_extract(_padded(c, bits), f"^({digit}*)", 1))


def trailing(c: Column, digit: str, bits: int = 64) -> Column:
    return F.char_length(F.regexp_extract(_padded(c, bits), f"({digit}*)$", 1))


def format_bits(c: Column) -> Column:
    """Binary digits in groups of eight, as many groups as the number needs."""
    raw = F.bin(c.cast("long"))
    whole = F.lpad(raw, (F.ceil(F.char_length(raw) / 8) * 8).cast("int"), F.lit("0"))
    return F.trim(F.regexp_replace(whole, "(.{8})", "$1 "))


def format_number(c: Column, prefix: bool = True) -> Column:
    """A whole number in several bases."""
    n = c.cast("long")
    p = lambda x: F.lit(x if prefix else "")
    return F.struct(F.concat(p("0b"), F.bin(n)).alias("binary"), n.cast("string").alias("display"), F.concat(p("0x"), F.lower(F.hex(n))).alias("lowerhex"), F.concat(p("0o"), F.conv(n, 10, 8)).alias("octal"), F.concat(p("0x"), F.hex(n)).alias("upperhex"))
