"""Hard negatives against a full ranking of every anchor, odd rows included."""
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from subseg.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label long, score int, rank string"


def brute(rows):
    clean = {}
    for i, v, lab in rows:
        if i is None or lab is None or not v or any(x is None or not math.isfinite(x) or abs(x) >= H.MAX_COMPONENT for x in v):
            continue
        clean.setdefault(i, []).append((lab, [math.floor(256 * x) for x in v]))
    clean = {i: min(r) for i, r in clean.items()}
    out = set()
    for a, (lab, v) in clean.items():
        if a % 10:
            continue
        ranked = sorted((-sum(x * y for x, y in zip(v, w)), i, lb) for i, (lb, w) in clean.items() if len(w) == len(v) and i != a)
        for ps, p, _ in [r for r in ranked if r[2] == lab][:5]:
            inside = [(s, i) for s, i, lb in ranked if lb != lab and 80 * -ps <= 100 * -s <= 100 * -ps][:5]
            out |= {(a, p, k + 1, i, -ps, -s) for k, (s, i) in enumerate(inside)}
    return out


def mined(spark, rows, **kw):
    df = spark.createDataFrame([(i, v, lab, 1, "x") for i, v, lab in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in H.mine(df, F.col("vec_id") % 10 == 0, **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_rows(seed, n=400, dim=6):
    rnd = random.Random(seed)
    hot = [round(rnd.gauss(0, 1), 2) for _ in range(dim)]
    return [(i, hot if rnd.random() < 0.35 else [round(rnd.gauss(0.3, 1), 2) for _ in range(dim)], rnd.choice([0, 0, 0, 1, 2, 3])) for i in range(n)]


@pytest.mark.parametrize("small", [False, True])
def test_equals_full_ranking_with_hot_vector_and_label(spark, monkeypatch, small):
    if small:  # deep trees, many tiles, several passes
        monkeypatch.setattr(H, "LEAF_ROWS", 4)
        monkeypatch.setattr(H, "FANOUT", 2)
        monkeypatch.setattr(H, "TILE_ROWS", 60)
    rows = some_rows(3)
    assert mined(spark, rows, **({"anchor_bytes": 400} if small else {})) == brute(rows)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = some_rows(5, 80, 3)
    odd = [(None, [1.0, 1.0, 1.0], 1), (500, None, 1), (510, [1.0, None, 1.0], 2), (520, [nan, 1.0, 1.0], 1), (530, [inf, 0.0, 0.0], 1), (540, [1.0, 2.0, 3.0], None),
           (550, [], 1), (560, [1.0, 2.0], 1), (561, [1.0, 2.0], 1), (562, [1.0, 1.9], 2), (570, [1e9, 0.0, 0.0], 1), (600, [-5.0, -5.0, -5.0], 9), (601, [5.0, 5.0, 5.0], 9)]
    rows = good + good[:20] + odd + [(3, [9.0, 9.0, 9.0], 7)]
    want = brute(rows)
    assert any(a == 560 for a, *_ in want)
    assert mined(spark, rows) == want


def test_no_anchor_and_empty_table(spark):
    assert mined(spark, [(1, [1.0], 1), (2, [2.0], 2)]) == set()
    df = spark.createDataFrame([], SCHEMA)
    got = H.mine(df, F.col("vec_id") % 10 == 0)
    assert got.count() == 0 and got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_bounds_hold_every_row():
    rng = np.random.default_rng(1)
    tile = H.Tile(np.arange(1000), rng.integers(0, 4, 1000), rng.integers(-50, 50, (1000, 9)))
    a = rng.integers(-50, 50, (3, 9)).astype(float)
    for level in range(len(tile.levels)):
        lower, upper = tile.bounds(level, 0, len(tile.levels[level][0]), np.maximum(a, 0), np.minimum(a, 0))
        width = H.LEAF_ROWS * H.FANOUT**level
        for b in range(lower.shape[1]):
            s = a @ tile.vec[b * width : (b + 1) * width].T
            assert (s.min(axis=1) >= lower[:, b]).all() and (s.max(axis=1) <= upper[:, b]).all()
    assert sorted(tile.ids) == list(range(1000))
