"""Quality rules: a decision list learned by sequential covering, applied as Spark conditional expressions.

Learning looks at labelled rows' statistics only, never at texts. A bounded
sample (about ``max_rows``, by the crc32 of the id, so it is the same
on every run and every partitioning) is split into a growing and a pruning
part. A rule starts empty; the threshold condition with the best FOIL gain is added
until no negative (kept) row is covered, then conditions are dropped from the
end while that doesn't lower ``(p-n)/(p+n)`` on the pruning part. A rule whose
pruned precision is below ``min_precision`` ends the search; covered rows leave
and the next rule is learned. The list becomes ordered ``F.when`` branches, so
scoring all documents is one projection over the statistics.

Defined results: no labelled rows, or only one class, give an empty list (all
kept); null labels are left out; documents without words are kept by the list (their
statistics are 0) and fail the fixed base rule instead; repeated ids score row by row; of conditions
of equal gain the first feature's lowest cut wins; very long texts are counted whole; other columns are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subseg.llm.stats import RATIOS, document_stats
from subseg.llm.store import stored

FEATURES = tuple(c for c in RATIOS if c not in ("log_words",))


@dataclass(frozen=True)
class Condition:
    column: str
    at_least: bool
    value: float

    def mask(self, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
        v = x[:, names.index(self.column)]
        return v >= self.value if self.at_least else v <= self.value

    def column_expr(self) -> Column:
        c = F.col(self.column)
        return c >= self.value if self.at_least else c <= self.value

    def __str__(self) -> str:
        return f"{self.column} {'>=' if self.at_least else '<='} {self.value:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: tuple[str, ...]) -> np.ndarray:
    m = np.ones(len(x), bool)
    for c in rule:
        m &= c.mask(x, names)
    return m


def _best(x: np.ndarray, y: np.ndarray, names: tuple[str, ...], cuts: list[np.ndarray]) -> tuple[float, Condition | None]:
    p0, n0 = y.sum(), (~y).sum()
    base = np.log2(p0 / (p0 + n0))
    best, found = 1e-9, None
    for k, name in enumerate(names):
        v = x[:, k]
        for at_least in (True, False):
            order = np.argsort(v, kind="stable")
            s = v[order] if at_least else -v[order][::-1]
            pos = np.cumsum(np.concatenate([[0], (y[order] if at_least else y[order][::-1])]))
            cut = cuts[k] if at_least else -cuts[k]
            lo = np.searchsorted(s, cut, side="left")
            p = pos[-1] - pos[lo]
            n = (len(v) - lo) - p
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where(p > 0, p * (np.log2(p / (p + n)) - base), 0.0)
            i = int(np.argmax(gain))
            if gain[i] > best:
                best, found = float(gain[i]), Condition(name, at_least, float(cuts[k][i]))
    return best, found


def learn(
    x: np.ndarray, reject: np.ndarray, names: tuple[str, ...],
    n_cuts: int = 64, min_precision: float = 0.9, min_cover: int = 3,
) -> list[Rule]:
    """Ordered rules; a row that a rule covers is rejected. Rows must be in a fixed order.

    Precision and cover alone end the covering: a rule grows while a condition gains and rows to keep are
    left in it, and rules follow while the next one rejects ``min_cover`` rows at ``min_precision``.
    """
    rules: list[Rule] = []
    prune = np.arange(len(x)) % 3 == 2
    left = np.ones(len(x), bool)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, n_cuts))) if len(x) else x[:, k] for k in range(len(names))]
    while True:
        g, v = left & ~prune, left & prune
        xg, yg, xv, yv = x[g], reject[g], x[v], reject[v]
        if yg.sum() < min_cover or yg.all():
            break
        rule: Rule = ()
        m = np.ones(len(xg), bool)
        while (~yg[m]).any() and yg[m].any():
            _, c = _best(xg[m], yg[m], names, cuts)
            if c is None:
                break
            rule += (c,)
            m &= c.mask(xg, names)
        if not rule:
            break

        def worth(r: Rule, xv: np.ndarray = xv, yv: np.ndarray = yv, xg: np.ndarray = xg, yg: np.ndarray = yg) -> float:
            use = (xv, yv) if yv.any() else (xg, yg)
            m = _covers(r, use[0], names)
            p, n = use[1][m].sum(), (~use[1][m]).sum()
            return (p - n) / (p + n) if p + n else -1.0

        while len(rule) > 1 and worth(rule[:-1]) >= worth(rule):
            rule = rule[:-1]
        m = _covers(rule, x, names) & left
        if reject[m].sum() < min_cover or reject[m].mean() < min_precision:
            break
        rules.append(rule)
        left &= ~m
    return rules


def as_column(rules: list[Rule]) -> Column:
    """0-based number of the first rule that covers the row, null if none does."""
    out = F.lit(None).cast("int")
    for i in range(len(rules) - 1, -1, -1):
        cond = F.lit(True)
        for c in rules[i]:
            cond &= c.column_expr()
        out = F.when(cond, F.lit(i)).otherwise(out)
    return out


def sample_labelled(stats: DataFrame, labels: DataFrame, max_rows: int, label: str = "quality") -> DataFrame:
    """About ``max_rows`` labelled statistics at most: ids whose crc32 lies below a bound that the count of labels sets."""
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{label}`").alias("label")).where("label is not null and doc_id is not null")
    y = y.groupBy("doc_id").agg(F.min("label").alias("label"))
    below = min(1 << 32, (1 << 32) * max_rows // max(y.count(), 1))
    y = y.where(F.crc32(F.col("doc_id").cast("string")) < below)
    # a repeated id counts once, by its smallest statistics
    return stats.where(F.col("held_key") < below).join(y, "doc_id").groupBy("doc_id").agg(*[F.min(c).alias(c) for c in ("held_key", *FEATURES, "label")])


def learn_rules(stats: DataFrame, labels: DataFrame, max_rows: int = 20_000, **kw) -> list[Rule]:
    rows = sample_labelled(stats, labels, max_rows).toPandas().sort_values(["held_key", "doc_id"])
    x = rows[list(FEATURES)].to_numpy(np.float64)
    reject = rows["label"].to_numpy() == 0
    return learn(x, reject, FEATURES, **kw) if len(x) else []


def judge(docs: DataFrame, labels: DataFrame, max_rows: int = 20_000, **kw) -> tuple[DataFrame, list[Rule]]:
    """(statistics of every document with ``base_failed``, ``rule`` and ``kept``, the rules)."""
    stats = stored(document_stats(docs), "rules")
    rules = learn_rules(stats, labels, max_rows, **kw)
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = stats.withColumns({"base_failed": base, "rule": as_column(rules)})
    return out.withColumn("kept", ~F.col("base_failed") & F.col("rule").isNull()), rules
