"""Spans, checked arithmetic and little-endian numbers as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span_fits(start: Column, length: Column, total: Column) -> Column:
    """Without adding, so nothing overflows."""
    return (start >= 0) & (length >= 0) & (start <= total) & (length <= total - start)


def span_end(start: Column, length: Column) -> Column:
    """Saturates at the largest long."""
    return F.coalesce(F.try_add(start, length), F.lit(9223372036854775807))


def checked_add(a: Column, b: Column) -> Column:
    """Null where the sum of two non-negative numbers overflows a long."""
    return F.try_add(a.cast("long"), b.cast("long"))


def checked_multiply(a: Column, b: Column) -> Column:
    """Null where the product of two non-negative numbers overflows a long."""
    return F.try_multiply(a.cast("long"), b.cast("long"))


def spans_overlap(a: Column, a_len: Column, b: Column, b_len: Column) -> Column:
    """Empty spans overlap nothing."""
    return (a_len > 0) & (b_len > 0) & (a < span_end(b, b_len)) & (b < span_end(a, a_len))


def little_endian(data: Column, at: int | Column, width: int) -> Column:
    """Unsigned number of up to 7 bytes, or the two's complement of 8, from byte ``at`` (0-based) of a binary column."""
    at = F.lit(at) if isinstance(at, int) else at
    parts = [F.shiftleft(F.conv(F.hex(F.substring(data, at + i + 1, F.lit(1))), 16, 10).cast("long"), 8 * i) for i in range(width)]
    out = parts[0]
    for p in parts[1:]:
        out = out.bitwiseOR(p)
    return out


def encode_little_endian(value: Column, width: int) -> Column:
    """The low ``width`` bytes of a long, least first."""
    h = F.lpad(F.hex(value), 16, "0")
    return F.unhex(F.concat(*(F.substring(h, 15 - 2 * i, 2) for i in range(width))))
