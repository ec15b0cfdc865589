"""Streaming word-frequency table.

Every micro-batch writes its own partial counts per (window, word) under its
batch id, so a replayed batch overwrites itself.  The table is the sum of the
partial counts on read: no state is kept, no watermark drops late rows, and
rows without a time are counted in a window of their own (null).
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def windowed_counts(words: DataFrame, seconds: int = DAY) -> DataFrame:
    """``(window_start, word, cnt)`` of a batch; ``words`` has ``ts`` (may be null) and ``word``."""
    micros = F.unix_micros("ts")
    start = F.timestamp_micros(micros - F.pmod(micros, F.lit(seconds * 1_000_000)))
    return words.groupBy(start.alias("window_start"), "word").agg(F.count(F.lit(1)).alias("cnt"))


def run_freq_stream(spark: SparkSession, source: DataFrame, words_fn, out_path: str, checkpoint: str,
                    seconds: int = DAY) -> DataFrame:
    """Count ``words_fn(batch)`` of every micro-batch of ``source``; return the summed table."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (windowed_counts(words_fn(batch), seconds).write.mode("overwrite")
         .parquet(os.path.join(out_path, f"batch_id={batch_id}")))

    q = (source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    parts = spark.read.schema("window_start timestamp, word string, cnt bigint").parquet(os.path.join(out_path, "*"))
    return parts.groupBy("window_start", "word").agg(F.sum("cnt").cast("bigint").alias("cnt"))
