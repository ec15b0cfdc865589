"""Evaluator against the published counts of the shipped gold/prediction pairs.

Pairs are found by rule (``<x>_pred.tab`` in the predictions folder, gold
``<x>_gold.tab`` or ``<x>.tab`` in the data folder); expected counts are
keyed by the pair's row count.
"""
import glob
import os

import pytest

from conftest import ref_dirs
from subseg.operators.evaluate import evaluate, row_flags
from subseg.sources.tables import read_pred_lines

# rows -> (chars, perfect, tp, fp, fn), as published
EXPECTED = {
    12740: (50763, 12636, 4137, 48, 57),
    5066: (21231, 5019, 1786, 27, 28),
    24123: (110026, 23754, 10099, 262, 129),
    4209: (23394, 4007, 4603, 95, 173),
}


def _pairs():
    out = []
    for pred_dir, data_dir in zip(ref_dirs("pred"), ref_dirs("data")):
        for pred in sorted(glob.glob(os.path.join(pred_dir, "*_pred.tab"))):
            stem = os.path.basename(pred)[:-len("_pred.tab")]
            for cand in (f"{stem}_gold.tab", f"{stem}.tab"):
                gold = os.path.join(data_dir, cand)
                if os.path.exists(gold):
                    out.append((gold, pred))
                    break
    return out


PAIRS = _pairs()


@pytest.mark.skipif(not PAIRS, reason="reference data not available")
def test_all_pairs_found():
    assert len(PAIRS) == len(EXPECTED)


@pytest.mark.parametrize("gold,pred", PAIRS)
def test_golden_scores(spark, gold, pred):
    g = read_pred_lines(spark, gold, column=1).select("pos", "seg")
    p = read_pred_lines(spark, pred).select("pos", "seg")
    r = evaluate(g, p, ["pos"]).first()
    chars, perfect, tp, fp, fn = EXPECTED[r.rows]
    assert (r.chars, r.perfect, r.tp, r.fp, r.fn, r.errors) == (chars, perfect, tp, fp, fn, 0)
    assert r.precision == pytest.approx(tp / (tp + fp))
    assert r.f_score == pytest.approx(2 * r.precision * r.recall / (r.precision + r.recall))


def frame(spark, rows):
    return spark.createDataFrame(rows, "pos int, seg string")


def test_every_reason_is_reported(spark):
    gold = frame(spark, [(1, "a|b"), (2, "ab"), (3, "abc"), (4, "x|y"), (5, "z"), (5, "z"), (6, "|q")])
    pred = frame(spark, [(1, "a|b"), (1, "ab"), (2, "abc"), (4, "x||y"), (5, "z"), (6, "q"), (9, "new")])
    flags = row_flags(gold, pred, ["pos"])
    got = {(r.pos, r.error) for r in flags.collect()}
    # of two predictions for key 1 the first in order of text is scored, the other reported
    assert got == {(1, None), (1, "duplicate_key"), (2, "char_mismatch"), (3, "missing_pred"), (4, "pred_double_pipe"), (5, None),
                   (5, "duplicate_key"), (6, "gold_leading_pipe"), (9, "extra_pred")}
    r = evaluate(gold, pred, ["pos"]).first()
    assert (r.rows, r.errors, r.gold_chars, r.chars) == (7, 7, 2 + 2 + 3 + 2 + 1 + 1 + 1, 2 + 2 + 3 + 2 + 1 + 1 + 3)


def test_surplus_predictions_count(spark):
    r = evaluate(frame(spark, [(1, "ab")]), frame(spark, [(1, "ab"), (2, "cd"), (3, "ef")]), ["pos"]).first()
    assert (r.rows, r.errors) == (1, 2)


def test_words_of_any_length(spark):
    import random
    rnd = random.Random(4)
    rows, want = [], [0, 0, 0]
    for k in range(60):
        n = rnd.choice([1, 2, 62, 63, 64, 65, 126, 300])
        g, p = ([rnd.random() < 0.3 for _ in range(n - 1)] for _ in range(2))
        spell = lambda bits: "".join("a" + "|" * b for b in bits) + "a"
        rows.append((k, spell(g), spell(p)))
        want = [w + sum(x) for w, x in zip(want, ([a and b for a, b in zip(g, p)], [b and not a for a, b in zip(g, p)], [a and not b for a, b in zip(g, p)]))]
    r = evaluate(frame(spark, [(k, g) for k, g, _ in rows]), frame(spark, [(k, p) for k, _, p in rows]), ["pos"]).first()
    assert [r.tp, r.fp, r.fn] == want and r.errors == 0
