"""Search: draws and folds that SQL states, trees that learn, ranks, a validation frame, refitting."""
import duckdb
import numpy as np
from pyspark.sql import functions as F

from conftest import SF_SMALL
from subseg.operators.planted import PLANTED, planted_seg
from subseg.plans import fixture as fx
from subseg.plans import model_queries as mq
from subseg.plans import tune as T

KEYS = ["doc_id", "pos"]


def test_draws_equal_sql(spark):
    pick = ", ".join(f"{v}[(('0x' || substr(md5('7#' || c || '#{k}'), 1, 8))::BIGINT % {len(v)} + 1)::INTEGER] AS {k}" for k, v in T.SPACE.items())
    want = duckdb.sql(f"SELECT c AS candidate, {pick} FROM range(40) t(c) ORDER BY c").fetchall()
    got = [tuple(r) for r in T.draw_candidates(spark, 40, seed=7).orderBy("candidate").collect()]
    assert [tuple(map(float, r)) for r in got] == [tuple(map(float, r)) for r in want]
    assert {r[2] for r in got} > {8} or len({r[2] for r in got}) > 10
    assert all(g[1] in T.SPACE["n_estimators"] and g[2] in T.SPACE["max_depth"] for g in got)


def test_folds_are_stratified(spark):
    df = spark.range(100).withColumn("label", (F.col("id") % 10 == 0).cast("int")).repartition(4)
    got = T.stratified_folds(df, ["id"], 3).groupBy("label", "fold").count().collect()
    assert sorted((r.label, r["count"]) for r in got) == [(0, 30), (0, 30), (0, 30), (1, 3), (1, 3), (1, 4)]


def test_trees_learn_interactions_and_ignore_unweighted_rows():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 20, (3000, 5))
    y = ((x[:, 0] > 9) ^ (x[:, 1] > 4)).astype(float)
    held = np.arange(3000) % 3 == 0
    noisy = np.where(held, 1 - y, y)  # labels of rows without weight must not matter
    s = T.boosted_scores(T.binned(x.astype(float)), noisy, np.where(held, 0.0, 1.0), 40, 6, 0.3, 0.01, 1.0, 1.0)
    assert ((s[held] > 0) == (y[held] == 1)).mean() > 0.97
    flat = T.boosted_scores(T.binned(x.astype(float)), y, np.ones(3000), 5, 6, 0.3, 1e9, 1.0, 1.0)
    assert np.allclose(flat, flat[0])  # no split gains that much


def test_search_ranks_refits_and_takes_a_validation_frame(spark):
    rows = mq.planted(spark, SF_SMALL).filter("doc_id < 60")
    lex, freqs = fx.lexicon(spark, SF_SMALL, PLANTED), fx.freqs(spark, SF_SMALL)
    model, _, ranked = T.tune_then_train(rows, KEYS, PLANTED, lex, freqs, search={"n_candidates": 3, "folds": 2, "max_contexts": 300},
                                         max_contexts=500, test_prop=0.0)
    got = ranked.collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0].f1 >= got[1].f1 >= got[2].f1 and got[0].f1 > 0.9
    assert model.gbt.getNumTrees == got[0].n_estimators
    seg = model.segment(rows, KEYS)
    assert seg.filter(F.col("seg") == planted_seg(F.col("word"))).count() > 0.97 * seg.count()
    val = T.tune(rows.filter("doc_id < 30"), KEYS, PLANTED, lex, freqs, n_candidates=2, validation=rows.filter("doc_id >= 30"), max_contexts=300).collect()
    assert [r["rank"] for r in val] == [1, 2] and val[0].f1 > 0.9
