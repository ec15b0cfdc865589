"""Every operator and stage: nulls, empty and very long texts, repeated rows, empty tables, clashing columns."""
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_helpers import SF_SMALL, frame, odd_texts
from subseg.llm import bm25_decontam, decision_list, fourier_quality, jaccard_join, license_scan, lm_scoring, packing, secret_scan, substring_dedup, unigram_counts
from subseg.llm.queries import tokenizer_path


def labels(spark):
    return spark.createDataFrame([(i, i % 2, 0) for i in range(10)] + [(3, None, 0), (None, 1, 0)], "doc_id long, quality long, toxic long")


def items(spark):
    return spark.createDataFrame([(1, "one two three four five. six seven eight."), (2, None), (3, ""), (1, "one two three four five. six seven eight.")], "item_id long, text string")


OPERATORS = {
    "license": lambda s, d: license_scan.scan_licenses(d.drop("licenses")),
    "lm": lambda s, d: lm_scoring.score_documents(d, F.col("doc_id") % 3 == 1),
    "counts": lambda s, d: unigram_counts.token_counts(d, tokenizer_path("piece_bpe_32k.model")),
    "quality": lambda s, d: fourier_quality.score_documents(d, labels(s), "doc_id >= 0")[0],
    "packing": lambda s, d: packing.pack_documents(d, tokenizer_path("word_bpe_49k.json")),
    "rules": lambda s, d: decision_list.judge(d, labels(s))[0],
    "secrets": lambda s, d: secret_scan.scan_secrets(d),
    "jaccard": lambda s, d: jaccard_join.jaccard_components(d),
    "repeats": lambda s, d: substring_dedup.drop_repeats(d),
    "leaks": lambda s, d: bm25_decontam.find_leaks(d, items(s)),
}
ONE_ROW_EACH = {"license", "lm", "counts", "quality", "rules", "secrets", "jaccard", "repeats"}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows(spark, name):
    texts = odd_texts()
    ids = [*range(len(texts) - 1), None]
    docs = frame(spark, texts + texts[5:7], ids + [5, 6], clash=True).repartition(4)
    got = OPERATORS[name](spark, docs).toPandas()
    if name in ONE_ROW_EACH:
        assert len(got) == len(texts) + 2
        assert got["doc_id"].isna().sum() == 1
    if name == "packing":
        assert got.length.sum() >= len(texts) + 2


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, name):
    assert OPERATORS[name](spark, frame(spark, ["x"], clash=True).limit(0)).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    texts = odd_texts()
    docs = frame(spark, texts + texts[5:6], [*range(len(texts) - 1), None, 5], clash=True)
    out = stage(spark, docs, SF_SMALL)
    if name != "packing":
        assert out.columns == docs.columns
    out.count()
    assert stage(spark, docs.limit(0), SF_SMALL).count() == 0
