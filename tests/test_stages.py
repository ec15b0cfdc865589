"""The whole model path on a gold that trees state exactly: stage, tags, positions, streams, splits, retraining."""
import os
import tempfile

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from conftest import SF_SMALL
from subseg import config as C
from subseg.operators.planted import PLANTED, planted_seg
from subseg.plans import fixture as fx
from subseg.plans import model_queries as mq
from subseg.plans.segmenter import Tags, gbt_estimator, train, train_then_retrain
from subseg.plans.stages import Segmenter
from subseg.streaming.model import ModelStream, publish

KEYS = ["doc_id", "pos"]


@pytest.fixture(scope="module")
def parts(spark):
    rows = mq.planted(spark, SF_SMALL)
    return rows, fx.lexicon(spark, SF_SMALL, PLANTED), fx.freqs(spark, SF_SMALL)


def wrong(segd):
    return segd.filter(F.col("seg") != planted_seg(F.col("word"))).count()


def test_pipeline_fits_saves_and_loads(spark, parts):
    rows, lex, freqs = parts
    pipe = Pipeline(stages=[Segmenter(PLANTED, lex, freqs, sep="~~", max_contexts=5000)]).fit(rows)
    out = pipe.transform(rows)
    assert set(out.columns) == {*rows.columns, "min_boundary_p"} and out.count() == rows.count()
    assert out.filter(F.replace("seg", F.lit("~~"), F.lit("|")) != planted_seg(F.col("word"))).count() == 0
    assert pipe.stages[0].report.holdout.first().accuracy == 1.0
    path = os.path.join(tempfile.mkdtemp(prefix="subseg-stage-"), "m")
    pipe.write().overwrite().save(path)
    again = PipelineModel.load(path)
    assert again.stages[0].uid == pipe.stages[0].uid
    a, b = (sorted(tuple(r) for r in m.transform(rows).select(*KEYS, "seg", "min_boundary_p").collect()) for m in (pipe, again))
    assert a == b


def test_positions_give_the_rows_of_the_full_result(spark, parts):
    rows, lex, freqs = parts
    model, _ = train(rows, KEYS, PLANTED, lex, freqs, test_prop=0.0, max_contexts=5000, exact_split=True)
    some = rows.filter("pos % 5 = 2").select(*KEYS)
    full = model.segment(rows, KEYS).join(some, KEYS, "left_semi")
    got = model.segment(rows, KEYS, positions=some.union(some))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, full.collect())) and wrong(got) == 0
    assert model.segment(rows, KEYS, positions=some.limit(0)).count() == 0


def test_tags_reach_the_model_and_unseen_ones_are_rare(spark, parts):
    _, lex, freqs = parts
    rows = mq.tagged(spark, SF_SMALL)
    model, _ = train(rows, KEYS, PLANTED, lex, freqs, test_prop=0.0, max_contexts=5000, tags=Tags("tag", mq.KNOWN_TAGS, "CDO"))
    probe = spark.createDataFrame([(1, 0, "xabcd", "_", "_", "CUT"), (1, 1, "xabcd", "_", "_", "KEEP"), (1, 2, "xabcd", "_", "_", "NEVER"), (1, 3, "xabcd", "_", "_", None)],
                                  "doc_id long, pos int, word string, prev_word string, next_word string, tag string")
    path = os.path.join(tempfile.mkdtemp(prefix="subseg-tags-"), "m")
    model.save(path)
    for m in (model, type(model).load(spark, path)):
        got = {r.pos: r.seg for r in m.segment(probe, KEYS).collect()}
        assert (got[0], got[1], got[2]) == ("xa|bcd", "xabcd", "xa|bcd") and len(got) == 4


def test_retrained_model_keeps_the_holdout_report(spark, parts):
    rows, lex, freqs = parts
    model, report = train_then_retrain(rows, KEYS, PLANTED, lex, freqs, max_contexts=3000)
    assert report.holdout.first().accuracy == 1.0 and wrong(model.segment(rows.filter("doc_id % 7 = 1"), KEYS)) == 0


@pytest.mark.parametrize("preset", ["DEFAULT_PRESET", "ARA_PRESET", "TAGGED_PRESET"])
def test_presets_fit(spark, preset):
    """The published shapes, in full, on a handful of rows."""
    from pyspark.ml.feature import VectorAssembler
    df = spark.range(40).selectExpr("cast(id % 4 as double) a", "cast(id % 2 as double) label", "1.0 weight").coalesce(1)
    p = getattr(C, preset)
    model = gbt_estimator(C.GBTParams(**{**p.__dict__, "max_iter": 3})).fit(VectorAssembler(inputCols=["a"], outputCol="features").transform(df))
    assert model.getNumTrees == 3 and model.getOrDefault("maxDepth") == p.max_depth and model.getOrDefault("stepSize") == p.step_size


def test_stream_keeps_a_batchs_version(spark, parts):
    rows, lex, freqs = parts
    model, _ = train(rows, KEYS, PLANTED, lex, freqs, test_prop=0.0, max_contexts=3000)
    d = tempfile.mkdtemp(prefix="subseg-stream-")
    assert publish(model, d + "/models") == 1
    words = rows.filter("doc_id < 20")
    stream = ModelStream(d + "/models", lambda b: b, KEYS, d + "/out")
    stream.write_batch(words, 0)
    assert publish(model, d + "/models") == 2
    stream.write_batch(words, 0)  # replayed: same version, same folder
    stream.write_batch(words.filter("doc_id = 3"), 1)
    out = spark.read.parquet(d + "/out/rows")
    assert {(r.batch_id, r.model_version) for r in out.select("batch_id", "model_version").distinct().collect()} == {(0, 1), (1, 2)}
    assert out.filter("batch_id = 0").count() == words.count() and wrong(out) == 0
    with pytest.raises(ValueError, match="no model"):
        ModelStream(d + "/none", lambda b: b, KEYS, d + "/other").write_batch(words, 0)
