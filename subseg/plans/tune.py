"""Hyper-parameter search (M3).

Candidates are a seeded draw from the published space; each is scored by
stratified k-fold cross-validation, or on a validation frame, by the F1 of the
boundary class.  Every (candidate, fold) is a row of its own and is fitted in a
task of its own on the labelled sample, which is bounded by ``max_contexts``
and so can be sent to every task; the best parameters then train the full
model (``tune_then_train``).

Draws and folds are md5 values, so SQL can state them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import GBTParams, SegConfig
from ..functions.hashing import md5_u32
from ..session import ship_package
from .segmenter import SegmenterModel, TrainReport, encoded_training_frame, train

# fixed values: the search space
SPACE = {
    "n_estimators": list(range(100, 251, 10)),
    "max_depth": list(range(8, 36)),
    "eta": [round(0.01 * k, 2) for k in range(1, 21)],
    "gamma": [round(0.01 * k, 2) for k in range(1, 21)],
    "colsample": [0.6, 0.7, 0.8, 1.0],
    "subsample": [0.6, 0.7, 0.8, 0.9, 1.0],
}
#: distinct labelled contexts that a search learns from
MAX_CONTEXTS = 500
BINS = 64
#: least sum of second derivatives in a leaf, and what is added to it in a leaf's value
MIN_LEAF = 1.0
RIDGE = 1.0


def draw_candidates(spark: SparkSession, n: int, seed: int = 42) -> DataFrame:
    """``(candidate, *SPACE)``: value number ``md5(seed#candidate#name) mod count`` of each parameter's list."""
    def value(name: str):
        u = md5_u32(F.concat_ws("#", F.lit(str(seed)), F.col("candidate").cast("string"), F.lit(name)))
        return F.element_at(F.array(*map(F.lit, SPACE[name])), (u % len(SPACE[name]) + 1).cast("int")).alias(name)
    return spark.range(n).withColumnRenamed("id", "candidate").select("candidate", *map(value, SPACE))


def stratified_folds(rows: DataFrame, key: list[str], folds: int) -> DataFrame:
    """Add ``fold``: rows of each label, in md5 order of their key, are dealt round; ``rows`` is a bounded sample."""
    order = md5_u32(F.concat_ws("\t", *[F.col(c).cast("string") for c in key]))
    w = Window.partitionBy("label").orderBy(order, *key)
    return rows.withColumn("fold", ((F.row_number().over(w) - 1) % folds).cast("int"))


# -- trees of one task ---------------------------------------------------------

def binned(x: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Columns as bin numbers: of the distinct values if few, else of quantiles."""
    out = np.empty(x.shape, np.int64)
    for j in range(x.shape[1]):
        edges = np.unique(x[:, j])
        if len(edges) > bins:
            edges = np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins)))
        out[:, j] = np.minimum(np.searchsorted(edges, x[:, j]), bins - 1)
    return out


def boosted_scores(x: np.ndarray, y: np.ndarray, weight: np.ndarray, trees: int, depth: int, eta: float, gamma: float,
                   colsample: float, subsample: float, seed: int = 42) -> np.ndarray:
    """Log odds of all rows after boosting on those of positive ``weight``.

    Rows of weight 0 are only routed, so no tree needs to be kept.  A level of a
    tree is two histograms over (node, feature, bin).
    """
    rng = np.random.default_rng(seed)
    n, m = x.shape
    score = np.zeros(n)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        use = weight * (rng.random(n) < subsample)
        g, h = use * (p - y), use * p * (1 - p)
        cols = np.sort(rng.choice(m, max(1, round(colsample * m)), replace=False))
        part = x[:, cols]
        node, active = np.zeros(n, np.int64), np.arange(n)
        for level in range(depth + 1):
            names, at = np.unique(node[active], return_inverse=True)
            k = len(names)
            slot = ((at[:, None] * len(cols) + np.arange(len(cols))) * BINS + part[active]).ravel()
            shape = (k, len(cols), BINS)
            hist = [np.bincount(slot, np.repeat(v[active], len(cols)), k * len(cols) * BINS).reshape(shape).cumsum(axis=2) for v in (g, h)]
            total = [v[:, 0, -1] for v in hist]
            gl, hl = hist
            gr, hr = total[0][:, None, None] - gl, total[1][:, None, None] - hl
            gain = (gl**2 / (hl + RIDGE) + gr**2 / (hr + RIDGE) - (total[0] ** 2 / (total[1] + RIDGE))[:, None, None]) / 2 - gamma
            gain[(hl < MIN_LEAF) | (hr < MIN_LEAF)] = -np.inf
            flat = gain.reshape(k, -1)
            best = flat.argmax(axis=1)
            split = (flat[np.arange(k), best] > 0) & (level < depth)
            leaf = ~split[at]
            score[active[leaf]] -= eta * (total[0] / (total[1] + RIDGE))[at[leaf]]
            active, at = active[~leaf], at[~leaf]
            if not len(active):
                break
            right = part[active, best[at] // BINS] > best[at] % BINS
            node[active] = 2 * at + right
    return score


def weighted_f1(y: np.ndarray, guess: np.ndarray, weight: np.ndarray) -> float:
    hit = float(weight[(y == 1) & guess].sum())
    miss = float(weight[(y == 1) & ~guess].sum()) + float(weight[(y == 0) & guess].sum())
    return 2 * hit / (2 * hit + miss) if hit else 0.0


# -- the search ----------------------------------------------------------------

@dataclass
class Sample:
    """Rows of the bounded labelled sample; ``fold`` is the part that a row is scored in (-1: never)."""
    x: np.ndarray
    y: np.ndarray
    weight: np.ndarray
    fold: np.ndarray


def labelled_sample(rows: DataFrame, key_cols: list[str], cfg: SegConfig, lex_tags: DataFrame, freqs: DataFrame | None,
                    folds: int, validation: DataFrame | None = None, max_contexts: int = MAX_CONTEXTS) -> Sample:
    """Encoded characters of about ``max_contexts`` contexts (twice that with a validation frame), with their folds."""
    frame = encoded_training_frame(rows, key_cols, cfg, lex_tags, freqs, test_prop=0.0, max_contexts=max_contexts)
    cols = frame.cats + frame.nums

    def collected(f) -> pd.DataFrame:  # max_contexts words
        chars = f.enc.select("label", "weight", *cols)
        return (stratified_folds(chars, [*cols, "weight"], folds) if validation is None else chars.withColumn("fold", F.lit(-1))).toPandas()

    data = collected(frame)
    if validation is not None:
        other = encoded_training_frame(validation, key_cols, cfg, lex_tags, freqs, test_prop=0.0, prune=0.0, max_contexts=max_contexts, encoder=frame.encoder)
        data = pd.concat([data, collected(other).assign(fold=0)], ignore_index=True)
    data = data.sort_values([*cols, "label", "weight"]).reset_index(drop=True)
    return Sample(binned(data[cols].to_numpy(np.float64)), data["label"].to_numpy(np.float64), data["weight"].to_numpy(np.float64), data["fold"].to_numpy())


RESULT = "candidate long, fold int, f1 double"


def score_candidates(candidates: DataFrame, sample: Sample) -> DataFrame:
    """``(candidate, fold, f1)`` of every candidate and fold, each fitted in its own task."""
    spark = candidates.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(sample)
    parts = sorted(int(f) for f in np.unique(sample.fold) if f >= 0)
    work = candidates.withColumn("fold", F.explode(F.array(*map(F.lit, parts))))
    n = max(1, candidates.count() * len(parts))
    work = work.repartitionByRange(n, "candidate", "fold")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = held.value
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                out_of = s.fold == r.fold
                log_odds = boosted_scores(s.x, s.y, np.where(out_of, 0.0, s.weight), r.n_estimators, r.max_depth, r.eta, r.gamma, r.colsample, r.subsample)
                out.append((r.candidate, r.fold, weighted_f1(s.y[out_of], log_odds[out_of] > 0, s.weight[out_of])))
            yield pd.DataFrame(out, columns=["candidate", "fold", "f1"])

    return work.mapInPandas(run, RESULT)


def tune(rows: DataFrame, key_cols: list[str], cfg: SegConfig, lex_tags: DataFrame, freqs: DataFrame | None,
         n_candidates: int = 20, folds: int = 3, seed: int = 42, validation: DataFrame | None = None,
         max_contexts: int = MAX_CONTEXTS) -> DataFrame:
    """``(rank, candidate, *SPACE, f1)`` for each drawn candidate, the best first; equal scores go by candidate."""
    spark = rows.sparkSession
    candidates = draw_candidates(spark, n_candidates, seed)
    sample = labelled_sample(rows, key_cols, cfg, lex_tags, freqs, folds, validation, max_contexts)
    mean = score_candidates(candidates, sample).groupBy("candidate").agg(F.avg("f1").alias("f1"))
    rank = F.row_number().over(Window.orderBy(F.desc("f1"), "candidate"))  # one row a candidate
    return candidates.join(mean, "candidate").select(rank.alias("rank"), "candidate", *SPACE, "f1").orderBy("rank")


def as_gbt_params(best) -> GBTParams:
    """A row of ``tune`` as tree parameters of the model; depth is capped at Spark's 30."""
    return GBTParams(max_iter=best["n_estimators"], max_depth=min(best["max_depth"], 30), step_size=best["eta"],
                     min_info_gain=best["gamma"], feature_subset=str(best["colsample"]), subsample=best["subsample"])


def tune_then_train(rows: DataFrame, key_cols: list[str], cfg: SegConfig, lex_tags: DataFrame, freqs: DataFrame | None,
                    search: dict | None = None, **train_options) -> tuple[SegmenterModel, TrainReport, DataFrame]:
    """Search, then fit the model with the best parameters on the rows: (model, report, ranked candidates)."""
    table = tune(rows, key_cols, cfg, lex_tags, freqs, **(search or {})).collect()
    model, report = train(rows, key_cols, cfg, lex_tags, freqs, params=as_gbt_params(table[0]), **train_options)
    ranked = rows.sparkSession.createDataFrame([tuple(r) for r in table], "rank int, candidate long, n_estimators int, max_depth int, "
                                               "eta double, gamma double, colsample double, subsample double, f1 double")
    return model, report, ranked
