"""Hexadecimal quantities of any width, without leaving the JVM.

A node reports quantities as ``0x`` strings of up to 256 bits. Three widths are
offered: 64-bit longs, 38-digit decimals and exact decimal text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Base-58 alphabet (fixed values of the public encoding).
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_HEX = r"^0[xX][0-9a-fA-F]+$"
_CHUNK = 1 << 32


def _div(a: Column, b: int) -> Column:
    return F.call_function("div", a, F.lit(b).cast("bigint"))


def _conv(digits: Column) -> Column:
    return F.conv(digits, 16, 10)


def is_hex(col: Column) -> Column:
    return col.rlike(_HEX)


def significant_digits(col: Column) -> Column:
    """Digits of ``0x`` text without prefix and leading zeros."""
    return F.ltrim(F.substring(col, F.lit(3), F.length(col)), F.lit("0"))


def radix_limbs(digits: Column, base: int, limbs: int, hex_width: int) -> Column:
    """``digits`` as ``limbs`` longs in the given base, most significant first.

    Schoolbook conversion over 32-bit pieces. ``base`` must stay under 2**31 so a
    limb times 2**32 plus the carry fits a long.
    """
    padded = F.lpad(digits, hex_width, "0")
    pieces = F.transform(
        F.sequence(F.lit(0), F.lit(hex_width // 8 - 1)),
        lambda i: _conv(F.substring(padded, i * 8 + 1, F.lit(8))).cast("bigint"),
    )
    zero = F.array_repeat(F.lit(0).cast("bigint"), limbs)
    empty = F.array().cast("array<bigint>")

    def absorb(number: Column, piece: Column) -> Column:
        def step(state: Column, limb: Column) -> Column:
            wide = limb * F.lit(_CHUNK).cast("bigint") + state["carry"]
            return F.struct(
                _div(wide, base).alias("carry"),
                F.array_append(state["limbs"], wide % F.lit(base).cast("bigint")).alias("limbs"),
            )

        start = F.struct(piece.alias("carry"), empty.alias("limbs"))
        return F.aggregate(number, start, step, lambda s: s["limbs"])

    return F.reverse(F.aggregate(pieces, zero, absorb))


def hex_to_long(col: Column) -> Column:
    """Value as a long; null when the text is not hex or needs more than 63 bits."""
    digits = significant_digits(col)
    short = _conv(F.substring(col, F.lit(3), F.lit(16))).try_cast("bigint")
    long = F.when(F.length(digits) <= 16, _conv(F.concat(F.lit("0"), digits)).try_cast("bigint"))
    return F.when(is_hex(col), F.when(F.length(col) <= 18, short).otherwise(long))


def _two_limbs(digits: Column) -> Column:
    """Value of 16 to 29 hex digits as a decimal, from pieces of 15."""
    low = _conv(F.right(digits, F.lit(15))).cast("decimal(19,0)")
    high = _conv(F.left(digits, F.length(digits) - 15)).cast("decimal(18,0)")
    return (high * F.lit(16**15).cast("decimal(19,0)") + low).cast("decimal(38,0)")


def _wide_text(digits: Column) -> Column:
    limbs = radix_limbs(digits, 10**9, 9, 64)
    text = F.array_join(F.transform(limbs, lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.ltrim(text, F.lit("0"))


def hex_to_text(col: Column) -> Column:
    """Exact decimal text for any width up to 256 bits.

    Text that is not a hex quantity passes through unchanged, and null stays null.
    """
    digits = significant_digits(col)
    value = (
        F.when(F.length(digits) <= 15, _conv(F.concat(F.lit("0"), digits)))
        .when(F.length(digits) <= 29, _two_limbs(digits).cast("string"))
        .when(F.length(digits) <= 64, _wide_text(digits))
        .otherwise(col)
    )
    return F.when(is_hex(col), value).otherwise(col)


def hex_to_decimal(col: Column) -> Column:
    """Value as ``decimal(38,0)``; null when it has more than 38 digits."""
    digits = significant_digits(col)
    dec = "decimal(38,0)"
    value = (
        F.when(F.length(digits) <= 15, _conv(F.concat(F.lit("0"), digits)).cast(dec))
        .when(F.length(digits) <= 29, _two_limbs(digits))
        .when(F.length(digits) <= 64, _wide_text(digits).try_cast(dec))
    )
    return F.when(is_hex(col), value)


def long_to_hex(col: Column, width: int | None = None) -> Column:
    """``0x`` text of a non-negative long, optionally zero-padded."""
    digits = F.lower(F.hex(col.cast("bigint")))
    if width:
        digits = F.lpad(digits, width, "0")
    return F.concat(F.lit("0x"), digits)


def content_hash(word: Column) -> Column:
    """Base-58 multihash text of a 32-byte word (sha2-256 prefix ``1220``)."""
    digits = F.concat(F.lit("001220"), F.lower(F.regexp_replace(word, "^0[xX]", "")))
    limbs = radix_limbs(F.lpad(digits, 72, "0"), 58**5, 10, 72)
    alphabet = F.lit(BASE58)

    def spell(limb: Column) -> Column:
        places = [F.substring(alphabet, (_div(limb, 58**p) % 58 + 1).cast("int"), F.lit(1)) for p in (4, 3, 2, 1, 0)]
        return F.concat(*places)

    text = F.array_join(F.transform(limbs, spell), "")
    return F.when(word.rlike("^0[xX][0-9a-fA-F]{64}$"), F.ltrim(text, F.lit("1")))
