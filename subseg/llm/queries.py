"""Registered queries opN_<name> and the SQL that says the same where SQL can."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from subseg.llm.oracles import ORACLE_SQL as ORACLE_SQL


ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Python workers find this package where the driver did; a cluster ships it with ``--py-files``."""
    env = spark.sparkContext.environment
    if ROOT not in (have := env.get("PYTHONPATH", "").split(os.pathsep)):
        env["PYTHONPATH"] = os.pathsep.join([ROOT, *filter(None, have)])
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.fourier_quality import score_documents

    scored, _ = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), "held_key % 4 <> 2")
    return scored.select("doc_id", (F.col("held_key") % 4 == 2).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.decision_list import judge

    judged, _ = judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.secret_scan import scan_secrets, span_text

    found = scan_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="found")
    n = lambda k: F.size(F.filter("found", lambda x: x["kind"] == k)).cast("long")
    return found.select(
        "doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"),
        F.sha2(span_text(F.filter("found", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        span_text(F.col("found")).alias("spans"),
    )


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.license_scan import scan_licenses

    found = scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), out_col="found")
    return found.select("doc_id", F.explode_outer("found").alias("f")).where("f is not null").select("doc_id", "f.license", "f.template", "f.first_shingle", "f.containment")


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.lm_scoring import score_documents

    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return score_documents(table(spark, sf_dir, "documents"), held_out)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.block_labeller import extract_text

    out = extract_text(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.unigram_counts import token_counts

    return token_counts(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op9_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op10_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.bm25_decontam import find_leaks

    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.hard_negatives import mine

    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0, label=label)


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.substring_dedup import drop_repeats

    left = drop_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from subseg.llm.prefix_trie import grafted, prefix_trie, turn_table

    return prefix_trie(*grafted(turn_table(table(spark, sf_dir, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_license_scan, op2_lm_score, op3_html_text, op4_token_counts, op5_quality_classifier,
        op6_packing, op7_quality_rules, op8_secret_scan, op9_jaccard_join, op10_benchmark_leaks,
        op11_hard_negatives, op12_substring_dedup, op13_prefix_trie,
    )
}

