"""Hash expressions. ``h60`` has the same value in any engine with md5; ``fast`` is xxhash64."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RANGE = float(1 << 60)


def h60(x: Column, seed: str | None = None, fast: bool = False) -> Column:
    """A 60-bit non-negative hash of a value's string form, optionally seeded. A null
    value has a null hash."""
    s = x.cast("string")
    if seed is not None:
        s = F.concat(F.lit(f"{seed}|"), s)
    if fast:
        return F.when(s.isNotNull(), F.shiftrightunsigned(F.xxhash64(s), 4))
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("bigint")


def u01(h: Column) -> Column:
    """A 60-bit hash as a number in (0, 1]."""
    return (h + F.lit(1)) / F.lit(RANGE)


def sql_h60(x: str) -> str:
    """The same hash in the SQL of an engine that casts hexadecimal strings."""
    return f"cast('0x' || substr(md5({x}), 1, 15) as bigint)"
