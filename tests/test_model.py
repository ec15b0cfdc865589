"""Model: trains, beats the all-zero baseline, is deterministic, round-trips."""
import os
import tempfile

from conftest import SF_SMALL
from subseg.config import GBTParams, LATIN
from subseg.operators.context import holdout_split
from subseg.operators.evaluate import evaluate
from subseg.plans import fixture as fx
from subseg.plans.segmenter import SegmenterModel, train

KEYS = ["doc_id", "pos"]
SMALL = GBTParams(max_iter=5, max_depth=4, step_size=0.3)


def test_train_segment_evaluate(spark):
    rows = fx.silver(spark, SF_SMALL)
    model, report = train(rows, KEYS, LATIN, fx.lexicon(spark, SF_SMALL), fx.freqs(spark, SF_SMALL), params=SMALL)
    assert report.rejected_rows == 0
    acc = report.holdout.first()
    assert acc.accuracy > 0.9
    test = holdout_split(rows, KEYS, 0.1).filter("is_test = 1")
    pred = model.segment(test, KEYS)
    assert pred.count() == test.count()
    r = evaluate(test.select(*KEYS, "seg"), pred.select(*KEYS, "seg"), KEYS).first()
    assert r.errors == 0 and r.tp > 0 and r.f_score > 0.3      # all-zero baseline scores 0
    imp = model.importances().collect()
    assert len(imp) == len(model.cat_cols) + len(model.num_cols)

    path = os.path.join(tempfile.mkdtemp(prefix="subseg-model-"), "m")
    model.save(path)
    again = SegmenterModel.load(spark, path)
    a = sorted(tuple(x) for x in model.segment(test, KEYS).select(*KEYS, "seg").collect())
    b = sorted(tuple(x) for x in again.segment(test, KEYS).select(*KEYS, "seg").collect())
    assert a == b
