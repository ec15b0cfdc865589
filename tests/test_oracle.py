"""Registered queries against their DuckDB oracle SQL on the smallest tables."""
import os

import duckdb
import pytest

from conftest import SF_SMALL

FAST = ["words", "turn_words", "silver_segs", "boundary_bits", "align_check", "lexicon_tags", "freq_norm",
        "split_hash", "train_freqs", "prune_lexicon", "letter_feats", "lexicon_feats", "freq_ratio",
        "regex_rules", "allowed_decode", "char_decode", "encoders", "benchmark_decode", "segments_long", "sentence_chunks", "eval_prf",
        "eval_by_quality", "char_accuracy", "unit_ranges", "superpos", "affix_labels", "pos_labels",
        "morph_filter", "sentence_split", "pred_formats", "treebank_segs", "stream_freq"]


def _norm(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(repr(v) for v in r) for r in df.astype(object).itertuples(index=False))


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "conversations", "benchmark", "labels", "events"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(SF_SMALL, t + '.parquet')}')")
    return c


@pytest.mark.parametrize("name", FAST)
def test_query_matches_oracle(spark, con, name):
    from __spark_entry__ import oracle_sql, queries
    got = queries()[name](spark, SF_SMALL).toPandas()
    want = con.execute(oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert len(got) == len(want)
    assert _norm(got) == _norm(want)


def test_every_query_has_sql_or_is_known_rows_only():
    from subseg.plans.registry import all_oracle_sql, all_queries
    rows_only = set(all_queries()) - set(all_oracle_sql())
    assert rows_only <= {"model_eval", "benchmark_segment", "importances", "tune"}


def test_entry_runs(spark):
    from __spark_entry__ import entry
    df = entry(spark)
    rows = df.collect()
    assert rows and set(df.columns) == {"lang", "words", "split_words", "segments"}
