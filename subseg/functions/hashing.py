"""Deterministic pseudo-random numbers from column values.

``rand(seed)`` depends on partitioning, so sampling and splits use the first
32 bits of an md5 digest instead.  The same value is computed by other SQL
engines as ``('0x' || substr(md5(x), 1, 8))::BIGINT``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def md5_u32(col: Column) -> Column:
    """First 32 bits of md5(col) as BIGINT in [0, 2^32)."""
    return F.conv(F.substring(F.md5(col.cast("string")), 1, 8), 16, 10).cast("bigint")


def md5_unit(col: Column) -> Column:
    """md5-derived value in [0, 1)."""
    return md5_u32(col) / F.lit(4294967296.0)


def every_kth(col: Column, prop: float) -> Column:
    """True for rows falling in the held-out slice of size ``prop``.

    Same rule as "row index modulo int(1/prop) == 0", evaluated on the md5
    bucket of a stable row key so that it needs no global row numbering.
    """
    step = int(1 / prop) if prop > 0 else 0
    if step <= 0:
        return F.lit(False)
    return F.pmod(md5_u32(col), F.lit(step)) == 0
