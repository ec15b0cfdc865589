"""Flagship query: documents -> words with context -> rule tokenisation and
positional decode -> segmented words, summarised per language."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN
from ..operators.decode import pseudo_proba_array, segment_with
from ..session import table
from ..sources.corpus import words_from_documents


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    words = words_from_documents(table(spark, sf, "documents"), predict=True)
    segd = segment_with(words, ["doc_id", "pos", "lang"], LATIN, proba_array_fn=pseudo_proba_array)
    n_segs = F.size(F.split("seg", r"\|"))
    return segd.groupBy("lang").agg(
        F.count(F.lit(1)).alias("words"),
        F.sum((n_segs > 1).cast("int")).cast("bigint").alias("split_words"),
        F.sum(n_segs).cast("bigint").alias("segments"),
    )
