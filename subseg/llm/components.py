"""Connected components of a distributed edge table."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm.store import stored

#: edges up to which one task finds the components (same result, no rounds)
ONE_TASK_EDGES = 20_000


def _in_one_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of a bounded edge table: every node takes the smallest label around it, labels are followed to their ends."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got)
    nodes, ends = np.unique(np.concatenate([t.column(c).to_numpy() for c in ("u", "v")]), return_inverse=True)
    u, v = ends[: len(ends) // 2], ends[len(ends) // 2 :]
    label = np.arange(len(nodes))
    while True:
        least = np.minimum(label[u], label[v])
        new = label.copy()
        np.minimum.at(new, label[u], least)  # the labels themselves, so that whole components join at once
        np.minimum.at(new, label[v], least)
        new = np.minimum(new, new[label])
        while not np.array_equal(new, new[new]):
            new = new[new]
        if np.array_equal(new, label):
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], names=["node", "root"])


def _with_min(pairs: DataFrame) -> DataFrame:
    """Each (u, v) with the smallest of u and all of u's v; counted map-side first, the join back may be split by AQE."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    return pairs.join(least, "u")


def connected_components(edges: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK_EDGES) -> DataFrame:
    """(node, root) for every node of ``edges(a, b)``; root is the smallest node of the component.

    Alternating large-star and small-star: a round links every node to the
    smallest node around it, so the number of rounds grows with the logarithm of the
    longest path. Every round is a written table; nothing is collected but two sums. A table of ``one_task``
    edges at most is done in one task instead.
    """
    e = stored(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if e.count() <= one_task:
        return stored(e.repartition(1).mapInArrow(_in_one_task, "node long, root long"), "roots")
    before = None
    for _ in range(max_rounds):
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.where("v < u")
        small = _with_min(low)
        e = stored(
            small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct(),
            "edges",
        )
        now = tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
