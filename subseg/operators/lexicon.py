"""Lexicon and frequency tables.

All are hash aggregations keyed by word; Spark does the partial (map-side)
aggregation, so a very frequent word is reduced inside each task before the
shuffle and no group is ever materialised whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import SegConfig
from ..functions.hashing import md5_unit
from ..functions.rules import collapse_tag


def lexicon_tags(lex: DataFrame, cfg: SegConfig) -> DataFrame:
    """``(word, tag)`` rows -> ``(word, tags)``: collapsed tags, sorted, ``|``-joined."""
    t = (lex.select(F.trim("word").alias("word"), collapse_tag(F.trim(F.col("tag")), cfg).alias("tag"))
         .filter((F.col("word") != "") & (F.col("tag") != ""))
         .distinct())
    return t.groupBy("word").agg(F.array_join(F.sort_array(F.collect_list("tag")), "|").alias("tags"))


def corpus_lexicon(words: DataFrame) -> DataFrame:
    """Fixture lexicon: each word tagged with the upper-cased language of its documents."""
    return words.select("word", F.upper("lang").alias("tag"))


def word_counts(words: DataFrame) -> DataFrame:
    """Corpus frequency table ``(word, cnt BIGINT)``."""
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("cnt"))


def normalise_freqs(counts: DataFrame, dup: str = "sum") -> DataFrame:
    """``(word, cnt[, line_no])`` -> ``(word, cnt, freq)`` with ``freq = cnt / Σcnt`` (A2).

    ``dup="sum"`` adds duplicate words; ``dup="last"`` keeps the last row's
    count (needs ``line_no``) while the total still covers every row.  The
    total is a one-row aggregate cross-joined back (a broadcast of one row).
    """
    total = counts.agg(F.sum(F.col("cnt").cast("double")).alias("total"))
    if dup == "last":
        per_word = counts.groupBy("word").agg(F.max_by("cnt", "line_no").alias("cnt"))
    else:
        per_word = counts.groupBy("word").agg(F.sum("cnt").alias("cnt"))
    return (per_word.crossJoin(F.broadcast(total))
            .select("word", "cnt", (F.col("cnt").cast("double") / F.col("total")).alias("freq")))


def train_freqs(seg_rows: DataFrame) -> DataFrame:
    """Counts of each training word and each of its segments (A3)."""
    items = F.array_append(F.split(F.col("seg"), r"\|"), F.col("word"))
    # ``explode`` infers a filter that makes the segmentation once more
    return (seg_rows.select(F.posexplode_outer(items).alias("k", "word")).filter(F.col("k").isNotNull())
            .groupBy("word").agg(F.count(F.lit(1)).alias("n")))


def prune_lexicon(lex_tags: DataFrame, tfreqs: DataFrame, prune: float) -> DataFrame:
    """Drop a ``prune`` share of the lexicon words seen at most once in training (O1).

    The draw is md5-based (``u = md5(word)/2^32``), so it is stable across
    partitionings and reproducible in plain SQL.  ``prune=0`` keeps all.
    """
    if prune <= 0:
        return lex_tags
    j = lex_tags.join(tfreqs, "word", "left")
    keep = (F.coalesce(F.col("n"), F.lit(0)) > 1) | (md5_unit(F.col("word")) > F.lit(prune))
    return j.filter(keep).select("word", "tags")


def lookup_dict(lex_tags: DataFrame, freqs: DataFrame | None) -> DataFrame:
    """One probe table ``(word, tags, freq)`` for all substring lookups (J9 side).

    Keys of the two inputs differ, hence the full outer join.
    """
    if freqs is None:
        return lex_tags.select("word", "tags", F.lit(None).cast("double").alias("freq"))
    return lex_tags.join(freqs.select("word", "freq"), "word", "full_outer")
