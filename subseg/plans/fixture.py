"""Fixture plans over the driver tables: words, silver segmentations,
lexicon and frequencies, all derived by Spark from ``documents``."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN, SegConfig
from ..functions.hashing import md5_u32
from ..operators.lexicon import corpus_lexicon, lexicon_tags, normalise_freqs, word_counts
from ..operators.seats import SEAT, seated
from ..operators.silver import with_silver
from ..session import table
from ..sources.corpus import words_from_documents, words_with_context


CHECK_MOD = 2305843009213693951  # 2^61 - 1


def _words32_sum(c: Column) -> Column:
    """``mod_sum`` of values below 2^32, summed as two halves: longs hold 2^47 rows' halves, so no row needs a decimal."""
    high, low = F.sum(F.shiftright(c, 16)), F.sum(c.bitwiseAND(F.lit(65535)))
    total = high.cast("decimal(20,0)") * F.lit(65536).cast("decimal(5,0)") + low.cast("decimal(20,0)")
    return F.pmod(total.cast("decimal(38,0)"), F.lit(CHECK_MOD).cast("decimal(38,0)")).cast("bigint")


def mod_sum(c: Column) -> Column:
    """Exact sum (decimal, no overflow at any row count) reduced mod 2^61-1 to BIGINT."""
    return F.pmod(F.sum(c.cast("decimal(38,0)")), F.lit(CHECK_MOD).cast("decimal(38,0)")).cast("bigint")


def checksum(*cols) -> Column:
    """Order-insensitive content checksum: Σ md5_u32 of the tab-joined row (mod 2^61-1)."""
    return _words32_sum(md5_u32(F.concat_ws("\t", *[F.col(c).cast("string") if isinstance(c, str) else c.cast("string")
                                                     for c in cols])))


def words(spark: SparkSession, sf: str, by: str | None = None, ranges: bool = False, seats: bool = False) -> DataFrame:
    """Document words with context.

    Texts, not words, are dealt to the tasks: a table of few large row groups
    would otherwise be split and exploded by as few tasks.  Plans that read the
    words several times share that exchange; the words, several times the
    text, are kept nowhere.  ``by="doc_id"`` deals whole documents by their id,
    so that windows over a document need no exchange of words; with ``ranges``
    in ranges of it, so that a text in order needs none.  ``seats`` adds the
    column that lookups of words need in order to leave the words in place;
    a document's rows have one seat.
    """
    docs = table(spark, sf, "documents").select("doc_id", "lang", "text")
    if seats:
        own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id"))
        return words_with_context(seated(docs, own), "doc_id", keep=("lang", SEAT))
    key = F.col(by) if by else F.xxhash64("doc_id", "text")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))  # a number, as tasks are small by their words, not by their texts
    return words_from_documents(docs.repartitionByRange(n, key) if ranges else docs.repartition(n, key))


def silver(spark: SparkSession, sf: str, drop_suffix: str | None = None, by: str | None = None, ranges: bool = False,
           seats: bool = False) -> DataFrame:
    return with_silver(words(spark, sf, by, ranges, seats), drop_suffix=drop_suffix)


def lexicon_rows(spark: SparkSession, sf: str, cfg: SegConfig = LATIN) -> DataFrame:
    return lexicon_tags(corpus_lexicon(words(spark, sf)), cfg)


def freq_rows(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_freqs(word_counts(words(spark, sf)))


def lexicon(spark: SparkSession, sf: str, cfg: SegConfig = LATIN) -> DataFrame:
    """The lexicon, kept for plans that look words up several times."""
    return lexicon_rows(spark, sf, cfg).persist(StorageLevel.MEMORY_AND_DISK)


def freqs(spark: SparkSession, sf: str) -> DataFrame:
    return freq_rows(spark, sf).persist(StorageLevel.MEMORY_AND_DISK)
