"""Expressions on byte strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

def empty() -> Column:
    return F.lit("").cast("binary")


def prefix(col: Column | str, n: Column | str | int) -> Column:
    """The first n bytes of a BINARY column."""
    c = F.col(col) if isinstance(col, str) else col
    n = F.lit(n) if isinstance(n, int) else F.col(n) if isinstance(n, str) else n
    return F.substring(c, F.lit(1), n)


def common_prefix(a: Column, b: Column) -> Column:
    """Length in bytes of the longest common prefix of two BINARY columns: bisection, O(n log n) for n bytes."""
    most = F.least(F.octet_length(a), F.octet_length(b))
    steps = F.sequence(F.floor(F.log2(F.greatest(most, F.lit(1)).cast("double"))).cast("int"), F.lit(0), F.lit(-1))

    def longer(acc: Column, bit: Column) -> Column:
        n = F.pow(F.lit(2), bit).cast("int")
        at = acc + F.lit(1)
        fits = (acc + n <= most) & (F.substring(a, at, n) == F.substring(b, at, n))
        return F.when(fits, acc + n).otherwise(acc)

    return F.aggregate(steps, F.lit(0), longer)


def display(col: Column | str) -> Column:
    """Text of a BINARY column, with U+FFFD for bytes that are no UTF-8."""
    c = F.col(col) if isinstance(col, str) else col
    return F.make_valid_utf8(c.cast("string"))


def successor(value: bytes) -> bytes | None:
    """The least byte string above all that start with value, or None if there is none."""
    v = value.rstrip(b"\xff")
    return v[:-1] + bytes([v[-1] + 1]) if v else None
