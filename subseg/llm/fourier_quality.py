"""Quality classifier: random Fourier features, ridge regression, isotonic calibration.

Document statistics are standardised with sums over all training rows. Fixed
random frequencies and phases (``seed``) turn them into ``cos`` features whose
inner products approximate a Gaussian kernel. Each partition emits the sums
``Z'Z`` and ``Z'y`` of its rows, cut into row blocks; Spark adds the blocks, so what
reaches the driver is one D x D matrix however many rows there are. Ridge
scores are then calibrated: rows are counted in ``bins`` score bins by a
grouped sum, and pool-adjacent-violators runs over the bins.

Defined results: null or empty text has the statistics of an empty document
and a score like any other; without usable labels every score is 0.5; repeated labels of an
id count by their smallest; repeated documents are scored row by row.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from subseg.llm import words as W
from subseg.llm.stats import RATIOS, batch_stats, document_stats
from subseg.llm.store import stored

N_FEATURES = 256
BLOCK = 16


@dataclass
class FourierModel:
    mean: np.ndarray
    scale: np.ndarray
    omega: np.ndarray
    phase: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    values: np.ndarray

    def lift(self, x: np.ndarray) -> np.ndarray:
        return lift((x - self.mean) / self.scale, self.omega, self.phase)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.lift(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.edges, self.values), 0.0, 1.0)


def lift(z: np.ndarray, omega: np.ndarray, phase: np.ndarray) -> np.ndarray:
    z = np.clip(z, -6.0, 6.0)  # one odd statistic must not spin the phases
    out = np.sqrt(2.0 / len(phase)) * np.cos(z @ omega + phase)
    return np.concatenate([out, np.ones((len(z), 1))], axis=1)


def pool_adjacent(value: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Isotonic least squares by pooling adjacent violators."""
    level: list[list[float]] = []
    for v, w in zip(value, weight, strict=True):
        level.append([v, w, 1])
        while len(level) > 1 and level[-2][0] >= level[-1][0]:
            v2, w2, k2 = level.pop()
            v1, w1, k1 = level[-1]
            level[-1] = [(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, k1 + k2]
    return np.concatenate([np.full(int(k), v) for v, _, k in level]) if level else np.zeros(0)


def _matrix(batch: pa.RecordBatch, names: list[str]) -> np.ndarray:
    return np.stack([batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in names], axis=1).astype(np.float64)


def normal_equations(rows: DataFrame, names: list[str], mean, scale, omega, phase) -> tuple[np.ndarray, np.ndarray]:
    """Z'Z and Z'y of all rows, summed by partition and then by Spark, block of rows by block."""
    d = len(phase) + 1

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d + 1))
        for b in batches:
            if b.num_rows:
                z = lift((_matrix(b, names) - mean) / scale, omega, phase)
                y = b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False).astype(np.float64)
                total += z.T @ np.concatenate([z, y[:, None]], axis=1)
        if total.any():
            at = list(range(0, d, BLOCK))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + BLOCK].tobytes() for i in at], pa.binary())], names=["at", "sums"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(b.schema.get_field_index("sums")):
                v = np.frombuffer(x.as_py())
                total = v.copy() if total is None else total + v
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["at", "sums"])

    parts = rows.select(*names, "label").mapInArrow(partial, "at int, sums binary")
    out = np.zeros((d, d + 1))
    for r in parts.groupBy("at").applyInArrow(add, "at int, sums binary").collect():  # d / BLOCK rows
        block = np.frombuffer(r["sums"]).reshape(-1, d + 1)
        out[r["at"] : r["at"] + len(block)] = block
    return out[:, :d], out[:, d]


def fit(rows: DataFrame, names: list[str], n_features: int = N_FEATURES, gamma: float | None = None, ridge: float = 1e-2, bins: int = 2000, seed: int = 7) -> FourierModel:
    """``rows``: the named statistics and ``label`` (0 or 1), any number of rows."""
    sums = rows.agg(F.count("*").alias("n"), F.sum("label").alias("y"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(names)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(names)]).first()
    rng = np.random.default_rng(seed)
    gamma = gamma or 0.5 / len(names)
    omega = rng.normal(0.0, np.sqrt(2.0 * gamma), (len(names), n_features))
    phase = rng.uniform(0.0, 2 * np.pi, n_features)
    none = np.zeros(0)
    if not sums["n"] or not 0 < sums["y"] < sums["n"]:
        return FourierModel(np.zeros(len(names)), np.ones(len(names)), omega, phase, np.zeros(n_features + 1), none, none)
    mean = np.array([sums[f"m{i}"] for i in range(len(names))])
    scale = np.array([sums[f"s{i}"] for i in range(len(names))])
    scale[scale < 1e-9] = 1.0
    zz, zy = normal_equations(rows, names, mean, scale, omega, phase)
    weights = np.linalg.solve(zz + ridge * np.eye(len(zy)), zy)
    model = FourierModel(mean, scale, omega, phase, weights, none, none)

    def binned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, pos = np.zeros(bins + 1, np.int64), np.zeros(bins + 1, np.int64)
        for b in batches:
            if b.num_rows:
                at = np.rint(np.clip(model.raw(_matrix(b, names)) + 0.5, 0, 2) / 2 * bins).astype(int)
                y = b.column(b.schema.get_field_index("label")).to_numpy(zero_copy_only=False)
                n += np.bincount(at, minlength=bins + 1)
                pos += np.bincount(at[y > 0], minlength=bins + 1)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n[at]), pa.array(pos[at])], names=["bin", "n", "pos"])

    table = rows.select(*names, "label").mapInArrow(binned, "bin long, n long, pos long").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).orderBy("bin").collect()  # at most bins + 1 rows
    n = np.array([r["n"] for r in table], float)
    model.edges = np.array([r["bin"] for r in table]) / bins * 2 - 0.5
    # half a row of either class keeps scores of pure ends off 0 and 1
    model.values = pool_adjacent((np.array([r["pos"] for r in table], float)) / n, n)
    return model


def score_documents(docs: DataFrame, labels: DataFrame, train, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", **kw) -> tuple[DataFrame, FourierModel]:
    """(doc_id, held_key, statistics, score of every document, the model). ``train``: condition on doc_id/held_key of rows to learn from."""
    stats = stored(document_stats(docs, id_col, text_col), "quality")
    names = list(RATIOS)
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").cast("double").alias("label"))
    y = y.where("label in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min("label").alias("label"))
    model = fit(stats.where(train).join(y, "doc_id"), names, **kw)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(model.score(_matrix(b, names)) if b.num_rows else np.zeros(0))], names=[*b.schema.names, "score"])

    return stats.mapInArrow(score, T.StructType([*stats.schema.fields, T.StructField("score", T.DoubleType())])), model


def keep_good(docs: DataFrame, labels: DataFrame, train, least: float = 0.7, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", **kw) -> DataFrame:
    """``docs`` whose score is at least ``least``; rows are dropped where they are, texts aren't shuffled. Without labels all stay."""
    _, model = score_documents(docs, labels, train, id_col, text_col, label, **kw)
    if not len(model.values):
        return docs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, text_col):
                part = batch.slice(lo, hi - lo)
                stats = batch_stats(part.column(part.schema.get_field_index(text_col)))
                score = model.score(np.stack([stats[c] for c in RATIOS], axis=1).astype(np.float64))
                yield part.filter(pa.array(score >= least))

    return docs.mapInArrow(run, docs.schema)
