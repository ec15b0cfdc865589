"""Words looked up at the seats of their documents: the same rows as by joins of tokens, and no token is shuffled."""
import re

import pytest
from pyspark.sql import functions as F

from subseg.config import LATIN
from subseg.operators import features as fe
from subseg.operators.lexicon import normalise_freqs, word_counts
from subseg.operators.seats import SEAT, seated
from subseg.sources.corpus import words_with_context

TEXTS = [(1, "the reader rereads a long-winded text"), (2, "the | text's end"), (2, "the reader"), (None, "unseen words end the text"), (None, "a a a"), (5, None),
         (6, "   "), (7, "_ the _ a")]


@pytest.fixture()
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id long, text string")


def _words(docs, seats):
    if seats:
        return words_with_context(seated(docs, F.xxhash64("doc_id", "text"), 4), "doc_id", keep=(SEAT,))
    return words_with_context(docs, "doc_id")


def _lexicon(spark):
    return spark.createDataFrame([("the", "ART"), ("a", "ART"), ("read", "V"), ("er", "SUF|X"), ("end", "N"), ("_", "Z"), ("text", None)], "word string, tags string")


@pytest.mark.parametrize("sets", [0, 10_000])
@pytest.mark.parametrize("only", [None, ["freq_ratio", "idx"], ["prev_grp_pos", "current_letter"], ["so_far_pos"], ["next_grp_len"]])
def test_seated_features_are_the_joined_ones(spark, docs, monkeypatch, only, sets):
    monkeypatch.setattr(fe, "MAX_TAG_SETS", sets)
    lex, freqs = _lexicon(spark), normalise_freqs(word_counts(_words(docs, False)))
    frames = [fe.char_features(_words(docs, s), lex, freqs, LATIN, keep=("doc_id", "pos"), only=only) for s in (True, False)]
    assert frames[0].columns == frames[1].columns
    a, b = (sorted(map(repr, f.collect())) for f in frames)
    assert a == b and a


def _exchanges(plan: str) -> list[str]:
    return re.findall(r"Exchange (\w+)\((.*?)\), (\w+)", plan)


def test_tokens_stay_at_their_seats(spark, docs):
    lex, freqs = _lexicon(spark), normalise_freqs(word_counts(_words(docs, False)))
    df = fe.char_features(_words(docs, True), lex, freqs, LATIN, keep=("doc_id", "pos"), only=fe.CAT_COLS)
    plan = df._jdf.queryExecution().executedPlan().toString()
    keys = [k for _, k, _ in _exchanges(plan)]
    assert keys and not [k for k in keys if SEAT in k and "word" in k or SEAT in k and "_nb" in k], keys


def test_scores_need_no_exchange_of_words(spark, tmp_path):
    from subseg.plans import catalog
    docs = [(k, f"the reading of text {k} was unfairly ended, really", "en") for k in range(9)] + [(3, "really repeated", "de"), (None, "nearly ended", "fr")]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    for query in (catalog.q_eval_prf, catalog.q_eval_by_lang, catalog.q_eval_errors):
        df = query(spark, str(tmp_path))
        plan = df._jdf.queryExecution().executedPlan().toString()
        keys = [k for _, k, _ in _exchanges(plan)]
        assert keys and not [k for k in keys if re.search(r"doc_id#\d+L?, pos#", k)], keys
        assert df.count() > 0
