"""Streaming queries (X1, X2): same results as their batch forms, so they
share the batch oracle SQL."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import decode as dec
from ..session import table
from ..sources.corpus import words_from_documents, words_with_context
from ..streaming.freq import run_freq_stream
from ..streaming.segment import run_segment_stream, scratch_path, table_stream
from . import catalog
from .catalog import CFG, _decode_summary, _pseudo, cks
from .fixture import checksum


def q_stream_segment(spark: SparkSession, sf: str) -> DataFrame:
    src = table_stream(spark, sf, "documents")

    def seg(batch: DataFrame) -> DataFrame:
        return dec.segment_with(words_from_documents(batch), ["doc_id", "pos"], CFG,
                                proba_array_fn=dec.pseudo_proba_array)

    out = run_segment_stream(spark, src, seg, scratch_path(spark, "stream-seg"), scratch_path(spark, "stream-seg-ckpt"))
    return _decode_summary(spark.read.parquet(out).drop("batch_id"), "doc_id")


def q_stream_freq(spark: SparkSession, sf: str) -> DataFrame:
    docs = table_stream(spark, sf, "documents")
    ev = table(spark, sf, "events").select(F.col("event_id").alias("doc_id"), F.col("ts").cast("timestamp").alias("ts"))

    def timed_words(batch: DataFrame) -> DataFrame:
        # a document without an event keeps its words, in the window of unknown time
        return words_with_context(batch.join(ev, "doc_id", "left"), "doc_id", keep=("ts",)).select("ts", "word")

    final = run_freq_stream(spark, docs, timed_words, scratch_path(spark, "stream-freq"), scratch_path(spark, "stream-freq-ckpt"))
    return final.groupBy(F.date_format("window_start", "yyyy-MM-dd HH:mm:ss").alias("window_start")).agg(
        F.count(F.lit(1)).alias("n_words"), F.sum("cnt").cast("bigint").alias("tokens"),
        checksum("word", "cnt").alias("checksum"))


SPARK_QUERIES = {
    "stream_segment": q_stream_segment,
    "stream_freq": q_stream_freq,
}

ORACLE_SQL = {
    "stream_segment": catalog.ORACLE_SQL["allowed_decode"],
    "stream_freq": f"""WITH {catalog.WORDS},
tw AS (SELECT e.ts, w.word FROM words w LEFT JOIN events e ON e.event_id = w.doc_id),
c AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, word, count(*) AS cnt FROM tw GROUP BY 1, 2)
SELECT strftime(window_start, '%Y-%m-%d %H:%M:%S') AS window_start, count(*) AS n_words, sum(cnt)::BIGINT AS tokens, {cks('word', 'cnt')} AS checksum
FROM c GROUP BY window_start""",
}
