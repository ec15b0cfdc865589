"""Exact row numbers without one task that sees every row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir

#: ``monotonically_increasing_id`` keeps the partition above these bits, the place in it below
_PLACE_BITS = 33


def _checkpoint(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def number_rows(df: DataFrame, order: list[str | Column], name: str = "row_no",
                keep: Callable[[DataFrame], DataFrame] = _checkpoint) -> DataFrame:
    """Add ``name BIGINT``: the row's 0-based place in the order of ``order``.

    Rows are range-partitioned and sorted by ``order`` and written once
    (``keep``), so that places stay fixed.  A partition's offset is the count
    of rows in the partitions before it; the counts, one a partition, are
    all that the driver sees.  Rows with equal keys share a partition: end
    ``order`` with a unique column where one key may hold many rows.
    """
    placed = keep(df.repartitionByRange(*order).sortWithinPartitions(*order)
                  .withColumn("__at", F.monotonically_increasing_id()))
    part = F.shiftright("__at", _PLACE_BITS).cast("int")
    counts = sorted((r["part"], r["n"]) for r in placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())
    offsets, total = [], 0
    for p, n in counts:
        offsets.append((p, total))
        total += n
    table = df.sparkSession.createDataFrame(offsets, "__part int, __offset long")
    place = F.col("__at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (placed.withColumn("__part", part).join(F.broadcast(table), "__part")
            .withColumn(name, F.col("__offset") + place).drop("__at", "__part", "__offset"))


def number_in_groups(df: DataFrame, groups: list[str], order: list[str | Column], name: str = "row_no",
                     keep: Callable[[DataFrame], DataFrame] = _checkpoint) -> DataFrame:
    """Add ``name BIGINT``: the 0-based place within the row's group.

    A group of any size is spread over range partitions; its first row number
    is a partial aggregate joined back (AQE splits a hot group's side).
    """
    numbered = number_rows(df, [*groups, *order], "__row", keep)
    first = numbered.groupBy(*groups).agg(F.min("__row").alias("__first"))
    same = F.lit(True)
    for g in groups:
        same &= F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}"))
    cols = [F.col(f"a.{c}") for c in df.columns]
    return numbered.alias("a").join(first.alias("b"), same).select(*cols, (F.col("__row") - F.col("__first")).alias(name))
