"""Little-endian fields in binary columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hex_at(col: Column, offset: int, width: int) -> Column:
    """The hex digits of a field, most significant byte first."""
    return F.concat(*[F.hex(F.substring(col, offset + i + 1, 1)) for i in reversed(range(width))])


def le_uint(col: Column, offset: int, width: int) -> Column:
    """An unsigned field of up to 4 bytes as bigint; null if the value is too short."""
    return F.when(F.octet_length(col) >= offset + width, F.conv(_hex_at(col, offset, width), 16, 10).cast("bigint"))


def le_int64(col: Column, offset: int) -> Column:
    """A signed field of 8 bytes as bigint; null if the value is too short."""
    return F.when(F.octet_length(col) >= offset + 8, F.conv(_hex_at(col, offset, 8), 16, -10).cast("bigint"))


def le_bytes(value: Column, width: int) -> Column:
    """An integer as ``width`` little-endian bytes, two's complement; higher bytes are cut off."""
    digits = F.lpad(F.hex(value.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))
