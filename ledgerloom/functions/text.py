"""Addresses, data words, safe numeric casts and text cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = 64


def normalize_address(col: Column) -> Column:
    return F.lower(col)


def word_to_address(col: Column) -> Column:
    """Last 20 bytes of a data word as a lower-case address."""
    return F.when(
        F.length(col) >= 40, F.concat(F.lit("0x"), F.lower(F.right(col, F.lit(40))))
    ).otherwise(F.lower(col))


def split_to_words(data: Column) -> Column:
    """32-byte words of ``0x`` data; the last one may be short, empty data gives []."""
    pieces = F.regexp_extract_all(F.substring(data, F.lit(3), F.length(data)), F.lit(f"(.{{1,{WORD}}})"), F.lit(1))
    words = F.transform(pieces, lambda w: F.concat(F.lit("0x"), w))
    return F.when(F.length(data) > 2, words).otherwise(F.array().cast("array<string>"))


def to_int_or_null(col: Column) -> Column:
    return F.trim(col.cast("string")).try_cast("bigint")


def to_float_or_null(col: Column) -> Column:
    return F.trim(col.cast("string")).try_cast("double")


def number_or_zero(col: Column) -> Column:
    return F.coalesce(to_float_or_null(col), F.lit(0.0))


def clean_text(col: Column) -> Column:
    """Text without NUL characters."""
    return F.translate(col, "\0", "")


def split_topics(col: Column) -> Column:
    """Comma-joined topics back to an array; blank text is an empty array."""
    text = F.trim(col)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ","))


def data_directory(html: Column) -> Column:
    """Directory named by a shop index page, null when it names none."""
    found = F.regexp_extract(html, '<link rel="data-dir" href="(.+?)"', 1)
    return F.when(found != "", found)
