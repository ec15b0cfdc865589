"""Boundary precision / recall / F and perfect word forms.

Gold and predicted rows are joined on their row key (not by running
character position), flags are compared inside each row, and one global
aggregate (partial per task, final on one row) yields the scores.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.segstr import boundary_bits, malformed


MASK_BITS = 62  # flags compared at a time


def _ones(bits: Column) -> Column:
    return F.length(F.replace(bits, F.lit("0"), F.lit("")))


def _flag_counts(gb: Column, pb: Column, n: Column) -> tuple[Column, Column, Column]:
    """(tp, fp, fn) over positions 1..n-1, for words of any length.

    Flag strings are read ``MASK_BITS`` at a time as integers whose common
    bits ``bit_count`` counts.
    """
    k = n - 1
    g, p = F.substring(gb, F.lit(1), k), F.substring(pb, F.lit(1), k)
    part = lambda x, i: F.conv(F.substring(x, i * MASK_BITS + 1, F.lit(MASK_BITS)), 2, 10).cast("bigint")
    chunks = F.sequence(F.lit(0), F.floor((k - 1) / MASK_BITS).cast("int"))
    both = F.aggregate(chunks, F.lit(0), lambda acc, i: acc + F.bit_count(part(g, i).bitwiseAND(part(p, i))))
    some = lambda c: F.when(n > 1, c).otherwise(0).cast("int")
    return some(both), some(_ones(p) - both), some(_ones(g) - both)


def _numbered(rows: DataFrame, key_cols: list[str], carry: tuple[str, ...], name: str) -> DataFrame:
    """Rows with their number within the key; a key's second row is a duplicate, whatever the order of input."""
    seg = F.trim(F.replace("seg", F.lit("\r"), F.lit(""))).alias(name)
    w = Window.partitionBy(*key_cols).orderBy(name)
    return rows.select(*key_cols, *carry, seg).withColumn("copy", F.row_number().over(w))


def row_flags(gold: DataFrame, pred: DataFrame, key_cols: list[str], carry: tuple[str, ...] = ()) -> DataFrame:
    """Per-row comparison: chars, perfect, tp, fp, fn and an error reason (or NULL).

    Both sides are kept: a prediction without a gold row is ``extra_pred``, a
    key's second row on either side ``duplicate_key``.  ``carry`` columns of
    ``gold`` (e.g. a slice label) ride along the one join; the numbering of
    rows within a key uses the join's own partitioning.
    """
    j = (_numbered(gold, key_cols, carry, "gold")
         .join(_numbered(pred, key_cols, (), "pred"), [*key_cols, "copy"], "full"))
    g, p = F.col("gold"), F.col("pred")
    gb, pb = boundary_bits(g), boundary_bits(p)
    gn = F.length(F.when(g == "|", g).otherwise(F.replace(g, F.lit("|"), F.lit(""))))
    pn = F.length(F.when(p == "|", p).otherwise(F.replace(p, F.lit("|"), F.lit(""))))
    err = (F.when(F.col("copy") > 1, F.lit("duplicate_key"))
           .when(g.isNull(), F.lit("extra_pred"))
           .when(p.isNull(), F.lit("missing_pred"))
           .when(malformed(g).isNotNull(), F.concat(F.lit("gold_"), malformed(g)))
           .when(malformed(p).isNotNull(), F.concat(F.lit("pred_"), malformed(p)))
           .when(gn != pn, F.lit("char_mismatch")))
    j = j.select(*key_cols, *carry, "gold", "pred", gb.alias("gb"), pb.alias("pb"), gn.alias("gn"), pn.alias("pn"),
                 err.alias("error"))
    # equal segmentations, most rows, need no comparison of their flags
    hits = F.when(F.col("gn") > 1, _ones(F.substring("gb", F.lit(1), F.col("gn") - 1))).otherwise(0).cast("int")
    alike = (hits, F.lit(0), F.lit(0))
    tp, fp, fn = (F.when(F.col("error").isNull(), F.when(F.col("gold") == F.col("pred"), a).otherwise(c))
                  for a, c in zip(alike, _flag_counts(F.col("gb"), F.col("pb"), F.col("gn"))))
    return j.select(
        *key_cols, *carry, "gold", "pred",
        F.col("pn").cast("bigint").alias("chars"), F.col("gn").cast("bigint").alias("gold_chars"),
        (F.col("gold") == F.col("pred")).cast("int").alias("perfect"),
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), "error",
    )


def error_report(flags: DataFrame) -> DataFrame:
    """``(error, rows, gold_chars, chars)`` per reason; NULL is the rows that were scored."""
    return flags.groupBy("error").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce("gold_chars", F.lit(0))).cast("bigint").alias("gold_chars"),
        F.sum(F.coalesce("chars", F.lit(0))).cast("bigint").alias("chars"))


def score(flags: DataFrame, group_cols: tuple[str, ...] = ()) -> DataFrame:
    """Micro-averaged scores, optionally per group (M8).

    ``rows`` counts gold rows; rows with an error reason count as not perfect
    and add no flags.  ``chars`` and ``gold_chars`` are the totals of both sides.
    """
    ok = F.col("error").isNull()
    agg = flags.groupBy(*group_cols).agg(
        F.count("gold").alias("rows"),
        F.sum(F.coalesce("chars", F.lit(0))).cast("bigint").alias("chars"),
        F.sum(F.coalesce("gold_chars", F.lit(0))).cast("bigint").alias("gold_chars"),
        F.sum(F.when(ok, F.col("perfect")).otherwise(0)).cast("bigint").alias("perfect"),
        F.sum(F.when(ok, F.col("tp")).otherwise(0)).cast("bigint").alias("tp"),
        F.sum(F.when(ok, F.col("fp")).otherwise(0)).cast("bigint").alias("fp"),
        F.sum(F.when(ok, F.col("fn")).otherwise(0)).cast("bigint").alias("fn"),
        F.sum((~ok).cast("int")).cast("bigint").alias("errors"),
    )
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    prec = F.coalesce(F.try_divide(tp, tp + fp), F.lit(0.0))
    rec = F.coalesce(F.try_divide(tp, tp + fn), F.lit(0.0))
    return (agg.withColumn("precision", prec).withColumn("recall", rec)
            .withColumn("f_score", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"),
                                                           F.col("precision") + F.col("recall")), F.lit(0.0)))
            .withColumn("perfect_ratio", F.coalesce(F.try_divide(F.col("perfect").cast("double"),
                                                                 F.col("rows").cast("double")), F.lit(0.0))))


def evaluate(gold: DataFrame, pred: DataFrame, key_cols: list[str], group_cols: tuple[str, ...] = ()) -> DataFrame:
    """End-to-end evaluation: one row (per group) of counts and scores."""
    return score(row_flags(gold, pred, key_cols, carry=tuple(group_cols)), group_cols)


def char_accuracy(scored: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Held-out character accuracy with the last char of each word forced to 0."""
    p = F.when(F.col("idx") + 1 == F.col("len_bound_group"), F.lit(0)).otherwise(F.col(pred_col))
    return scored.agg(F.avg((F.col(label_col) == p).cast("double")).alias("accuracy"),
                      F.count(F.lit(1)).alias("chars"))
