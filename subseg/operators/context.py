"""Ordered-context operators.

Context itself (W1/W2) is built with the word arrays in ``sources.corpus``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import every_kth
from .numbering import number_rows
from .seats import SEAT, has_seats


def holdout_split(rows: DataFrame, key_cols: list[str], test_prop: float = 0.1) -> DataFrame:
    """Add ``is_test INT``: about ``test_prop`` of rows, chosen by md5 of the row key.

    A hash of the key replaces "every k-th row of the file", which would need
    one global row numbering; the share and the determinism are the same.
    """
    key = F.concat_ws("#", *[F.col(c).cast("string") for c in key_cols])
    return rows.withColumn("is_test", every_kth(key, test_prop).cast("int"))


def holdout_kth(rows: DataFrame, order: list[str], test_prop: float = 0.1) -> DataFrame:
    """Add ``is_test INT``: exactly every k-th row in the order of ``order``, k = int(1 / test_prop).

    Rows are numbered from 1, so that the first held-out row is the k-th.  The
    numbers come from partition counts and offsets, not from one task.
    """
    step = int(1 / test_prop) if test_prop > 0 else 0
    if not step:
        return rows.withColumn("is_test", F.lit(0))
    numbered = number_rows(rows, order, "__no")
    return numbered.withColumn("is_test", ((F.col("__no") + 1) % step == 0).cast("int")).drop("__no")


def sentence_chunks(words: DataFrame, doc_col: str = "doc_id", pos_col: str = "pos",
                    max_len: int = 100) -> DataFrame:
    """Sentence numbers: a sentence closes after a ``.`` word or at ``max_len + 1`` words.

    Closed form of the greedy loop: ``dots`` = number of ``.`` words before this
    one in the document; within a ``dots`` group, chunks of ``max_len + 1``.
    The windows are per document, i.e. per input row of prose, all of one
    order, so that a document is sorted once: a group's rows are counted from
    the row number of its first one.
    """
    w = Window.partitionBy(doc_col).orderBy(pos_col)
    dot = F.col("word") == "."
    dots = F.coalesce(F.sum(dot.cast("int")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = words.select("*", dots.cast("int").alias("sent_dots"), F.row_number().over(w).alias("__row"), F.lag(dot, 1, True).over(w).alias("__opens"))
    t = t.withColumn("__first", F.max(F.when(F.col("__opens"), F.col("__row"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("sent_chunk", F.floor((F.col("__row") - F.col("__first")) / (max_len + 1)).cast("int")).drop("__row", "__opens", "__first")


def restrict_positions(rows: DataFrame, positions: DataFrame, key_cols: list[str]) -> DataFrame:
    """Keep only the requested positions (Q3); context must already be attached.

    Positions of the same seated rows are found at their seats.
    """
    keys = [*([SEAT] if has_seats(rows) and has_seats(positions) else []), *key_cols]
    return rows.join(positions.select(*keys), keys, "left_semi")
