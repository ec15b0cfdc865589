"""Hard-negative mining over an STR-packed R-tree with inner-product bounds.

Rows are sorted by label and coordinates into tiles (Spark's range partitioning, ties split by
id, so that one hot label or vector fills many tiles). Inside a tile a sort-tile-recursive
pass packs rows into leaves and leaves into boxes. A box holds the least and the
largest value of each coordinate and of the label; for an anchor ``a`` each
coordinate gives an interval of ``a_i * x_i``, and their sum bounds every inner product in the box.

Two searches go over the tiles, each a best-first queue of boxes shared by a block of anchors:

1. positives: the first ``k`` rows of the anchor's label. A box goes if its labels exclude the
   anchor's or its upper bound is strictly below the anchor's k-th score so far.
2. negatives: for each positive the first ``k`` rows of other labels whose score lies in the
   positive's window. A box goes if it lies outside all windows, strictly below all k-th
   scores, or holds the anchor's label alone.

A task carries the k-th scores through all its tiles and returns k rows an anchor, which
a window merges. Anchors are the stated query set; they go out in passes of ``ANCHOR_BYTES``
at most, so nothing that is broadcast grows with the table.

Defined results: rows with a null id, label or vector, an empty vector, or a component that is null,
not finite or of magnitude 4,096 and more take no part (below it, inner products of up to 8,192 components are
exact in the floating point of the matrix products). Vectors of different lengths have no score and never meet. Of several rows with one id the one with the smallest
(label, vector) counts; repeated rows count once. Equal scores are ordered by the smaller id.
A positive of negative score has an empty window. Other columns are not looked at.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from subseg.llm.store import stored

LEAF_ROWS = 128
FANOUT = 8
TILE_ROWS = 8192
#: coordinates that the packing of a tile sorts by, those of the largest variance first
STR_COORDINATES = 3
#: anchors searched at once; a queue is shared by so many
ANCHOR_BLOCK = 128
#: bytes of anchors sent to the tasks in one pass
ANCHOR_BYTES = 16 << 20
SCALE = 256
MAX_COMPONENT = 4096.0


def quantised(rows: DataFrame, id_col: str, vec_col: str, label: Column) -> DataFrame:
    """(vec_id, label, vec array<int>), one row an id: the rows that take part, components as floor(256 * x)."""
    vec = F.transform(F.col(f"`{vec_col}`"), lambda x: x.cast("double"))
    sound = lambda x: x.isNotNull() & (F.abs(F.coalesce(x, F.lit(float("nan")))) < MAX_COMPONENT)  # noqa: E731  NaN is larger than all
    x = rows.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), label.cast("long").alias("label"), vec.alias("vec"))
    x = x.where("vec_id is not null and label is not null and vec is not null").where((F.size("vec") > 0) & F.forall("vec", sound))
    x = x.withColumn("vec", F.transform("vec", lambda c: F.floor(c * SCALE).cast("int")))
    return x.groupBy("vec_id").agg(F.min(F.struct("label", "vec")).alias("r")).select("vec_id", "r.label", "r.vec")


def str_order(vec: np.ndarray, label: np.ndarray, leaf: int = LEAF_ROWS) -> np.ndarray:
    """The order of rows that sort-tile-recursive packing gives: by label, then slabs of each chosen coordinate."""
    coords = np.argsort(-vec.astype(np.float64).var(axis=0), kind="stable")[:STR_COORDINATES]
    out = np.lexsort((*(vec[:, c] for c in coords[::-1]), label))
    cut = np.append(0, np.flatnonzero(np.diff(label[out])) + 1)
    parts = list(zip(cut, np.append(cut[1:], len(out)), strict=True))
    for depth, c in enumerate(coords):
        next_parts = []
        for lo, hi in parts:
            out[lo:hi] = out[lo:hi][np.argsort(vec[out[lo:hi], c], kind="stable")]
            slabs = int(np.ceil((-(-(hi - lo) // leaf)) ** (1 / (len(coords) - depth))))
            step = -(-(-(-(hi - lo) // slabs)) // leaf) * leaf
            next_parts += [(at, min(at + step, hi)) for at in range(lo, hi, step)]
        parts = next_parts
    return out


class Tile:
    """One tile's R-tree: rows in packed order, and for each level the boxes of ``FANOUT`` boxes below (leaves: rows)."""

    def __init__(self, ids: np.ndarray, label: np.ndarray, vec: np.ndarray):
        order = str_order(vec, label)
        self.ids, self.label, self.vec = ids[order], label[order], vec[order].astype(np.float64)
        at = np.arange(0, len(ids), LEAF_ROWS)
        box = [f.reduceat(x, at, axis=0) for x in (self.vec, self.label) for f in (np.minimum, np.maximum)]
        self.levels = [box]
        while len(box[0]) > 1:
            at = np.arange(0, len(box[0]), FANOUT)
            box = [f.reduceat(x, at, axis=0) for x, f in zip(box, (np.minimum, np.maximum) * 2, strict=True)]
            self.levels.append(box)

    def bounds(self, level: int, lo: int, hi: int, plus: np.ndarray, minus: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(lower, upper) bounds of the inner products of anchors (rows; their positive and negative parts) with boxes."""
        least, most = self.levels[level][0][lo:hi].T, self.levels[level][1][lo:hi].T
        return plus @ least + minus @ most, plus @ most + minus @ least


class Best:
    """The first k (score descending, id ascending) of each slot; ``kth`` is the score that a further row must reach."""

    def __init__(self, slots: int, k: int):
        self.k = k
        self.score = np.full((slots, k), -np.inf)
        self.ids = np.full((slots, k), np.iinfo(np.int64).max)

    @property
    def kth(self) -> np.ndarray:
        return self.score[:, -1]

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        hit = np.unique(slot)
        slot = np.concatenate([slot, np.repeat(hit, self.k)])
        score = np.concatenate([score, self.score[hit].ravel()])
        ids = np.concatenate([ids, self.ids[hit].ravel()])
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.searchsorted(slot, hit)
        take = order[first[:, None] + np.arange(self.k)]
        self.score[hit], self.ids[hit] = score[take], ids[take]


def search(tile: Tile, vec: np.ndarray, keep_boxes, take_rows, anchors: np.ndarray) -> None:
    """Best-first over the tile for a block of anchors. ``keep_boxes(anchors, level box columns, lower, upper)`` says which
    (anchor, box) pairs may still matter, ``take_rows(anchors, scores, row range)`` uses a leaf's scores."""
    plus, minus = np.maximum(vec, 0), np.minimum(vec, 0)
    top = len(tile.levels) - 1
    queue: list[tuple] = []

    def push(level: int, lo: int, hi: int, rows: np.ndarray) -> None:
        lower, upper = tile.bounds(level, lo, hi, plus[rows], minus[rows])
        ok = keep_boxes(anchors[rows], tile.levels[level][2][lo:hi], tile.levels[level][3][lo:hi], lower, upper)
        for b in np.flatnonzero(ok.any(axis=0)):
            alive = ok[:, b]
            heapq.heappush(queue, (-float(upper[alive, b].max()), level, lo + int(b), rows[alive], lower[alive, b], upper[alive, b]))

    push(top, 0, 1, np.arange(len(vec)))
    while queue:
        _, level, b, rows, lower, upper = heapq.heappop(queue)
        # k-th scores may have risen since the box was queued
        ok = keep_boxes(anchors[rows], tile.levels[level][2][b : b + 1], tile.levels[level][3][b : b + 1], lower[:, None], upper[:, None])[:, 0]
        rows = rows[ok]
        if not len(rows):
            continue
        if level:
            push(level - 1, b * FANOUT, min((b + 1) * FANOUT, len(tile.levels[level - 1][0])), rows)
        else:
            lo, hi = b * LEAF_ROWS, min((b + 1) * LEAF_ROWS, len(tile.ids))
            take_rows(anchors[rows], vec[rows] @ tile.vec[lo:hi].T, slice(lo, hi))


TILE_SCHEMA = "dim int, n int, ids binary, labels binary, vectors binary"


def tiles(rows: DataFrame) -> DataFrame:
    """Rows dealt by (length, label, first coordinates, id) into tiles of ``TILE_ROWS`` at most, a packed row each."""
    spark = rows.sparkSession
    n = rows.count()
    parts = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // TILE_ROWS)), n // (16 * TILE_ROWS))
    keyed = rows.withColumn("dim", F.size("vec")).withColumns({f"c{i}": F.get("vec", i) for i in range(2)})
    keyed = keyed.repartitionByRange(parts, "dim", "label", "c0", "c1", "vec_id").sortWithinPartitions("dim", "label", "c0", "c1", "vec_id")

    def tile(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows).combine_chunks()
        vec = t.column("vec").chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int32)
        cols = [t.column(c).to_numpy().astype(np.int64).tobytes() for c in ("vec_id", "label")]
        return pa.RecordBatch.from_arrays(
            [pa.array([t.column("dim")[0].as_py()], pa.int32()), pa.array([t.num_rows], pa.int32()), *[pa.array([c], pa.binary()) for c in (*cols, vec.tobytes())]],
            names=["dim", "n", "ids", "labels", "vectors"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wait: list[pa.RecordBatch] = []
        held, dim = 0, None
        for batch in batches:
            dims = batch.column(2).to_numpy()
            cut = [0, *(np.flatnonzero(np.diff(dims)) + 1), len(dims)]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                while lo < hi:
                    if wait and (held == TILE_ROWS or dims[lo] != dim):
                        yield tile(wait)
                        wait, held = [], 0
                    take = min(hi - lo, TILE_ROWS - held)
                    wait.append(batch.slice(lo, take))
                    held, dim, lo = held + take, dims[lo], lo + take
        if wait:
            yield tile(wait)

    return stored(keyed.select("vec_id", "label", "dim", "vec").mapInArrow(run, TILE_SCHEMA), "tiles")


def _tile_of(batch: pa.RecordBatch, r: int) -> tuple[int, Tile]:
    col = lambda c, t: np.frombuffer(batch.column(batch.schema.get_field_index(c))[r].as_py(), t)
    dim = batch.column(0)[r].as_py()
    return dim, Tile(col("ids", np.int64), col("labels", np.int64), col("vectors", np.int32).reshape(-1, dim))


def _blocks(anchors: dict[int, tuple], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(anchor numbers, vectors) of the anchors of this length, a block each."""
    number, vec = anchors.get(dim, (np.zeros(0, np.int64), None))
    for lo in range(0, len(number), ANCHOR_BLOCK):
        yield number[lo : lo + ANCHOR_BLOCK], vec[lo : lo + ANCHOR_BLOCK]


def _by_length(number: np.ndarray, vecs: list) -> dict[int, tuple]:
    size = np.array([len(v) for v in vecs], np.int64)
    return {int(d): (number[size == d], np.array([v for v, s in zip(vecs, size, strict=True) if s == d], np.float64)) for d in np.unique(size)}


FOUND = "anchor_id long, slot int, found_id long, score long"


def _emit(best: Best, anchor_ids: np.ndarray, slots: int) -> Iterator[pa.RecordBatch]:
    row, col = np.nonzero(best.score > -np.inf)
    if len(row):
        cols = [pa.array(anchor_ids[row // slots]), pa.array((row % slots).astype(np.int32)), pa.array(best.ids[row, col]), pa.array(best.score[row, col].astype(np.int64))]
        yield pa.RecordBatch.from_arrays(cols, names=["anchor_id", "slot", "found_id", "score"])


def _first(found: DataFrame, keys: list[str], k: int) -> DataFrame:
    """The first k of what the tasks found, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def positives(packed: DataFrame, anchor_rows: list, k: int) -> DataFrame:
    """(anchor_id, slot, found_id, score): the first k other rows of each anchor's label; slot 0."""
    spark = packed.sparkSession
    ids = np.array([r["vec_id"] for r in anchor_rows], np.int64)
    label = np.array([r["label"] for r in anchor_rows], np.int64)
    held = spark.sparkContext.broadcast((ids, label, _by_length(np.arange(len(ids)), [r["vec"] for r in anchor_rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, by_dim = held.value
        best = Best(len(ids), k)

        def boxes(a, low_label, high_label, lower, upper):
            return (low_label <= label[a, None]) & (high_label >= label[a, None]) & (upper >= best.kth[a, None])

        for batch in batches:
            for r in range(batch.num_rows):
                dim, tile = _tile_of(batch, r)

                def rows(a, score, span, tile=tile):
                    ok = (tile.label[span] == label[a, None]) & (tile.ids[span] != ids[a, None]) & (score >= best.kth[a, None])
                    i, j = np.nonzero(ok)
                    best.add(a[i], score[i, j], tile.ids[span][j])

                for number, vec in _blocks(by_dim, dim):
                    search(tile, vec, boxes, rows, number)
        yield from _emit(best, ids, 1)

    return packed.mapInArrow(run, FOUND)


def negatives(packed: DataFrame, anchor_rows: list, scores: np.ndarray, k: int, low: int, high: int) -> DataFrame:
    """(anchor_id, slot, found_id, score): for each positive (slot) the first k rows of other labels inside its window.

    ``scores`` has each anchor's positives' scores (NaN where there are fewer); a window is
    ``low * positive <= 100 * negative <= high * positive``."""
    spark = packed.sparkSession
    ids = np.array([r["vec_id"] for r in anchor_rows], np.int64)
    label = np.array([r["label"] for r in anchor_rows], np.int64)
    held = spark.sparkContext.broadcast((ids, label, scores, _by_length(np.arange(len(ids)), [r["vec"] for r in anchor_rows])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, label, scores, by_dim = held.value
        slots = scores.shape[1]
        # whole numbers, so that a window's ends are exact; an absent positive has an empty one
        floor, roof = np.ceil(low * scores / 100), np.floor(high * scores / 100)
        floor, roof = np.where(np.isnan(scores), np.inf, floor), np.where(np.isnan(scores), -np.inf, roof)
        best = Best(len(ids) * slots, k)

        def boxes(a, low_label, high_label, lower, upper):
            kth = best.kth.reshape(-1, slots)[a]
            ok = np.zeros(upper.shape, bool)
            for s in range(slots):
                ok |= (upper >= np.maximum(floor[a, s], kth[:, s])[:, None]) & (lower <= roof[a, s, None]) & (floor[a, s] <= roof[a, s])[:, None]
            return ok & ~((low_label == label[a, None]) & (high_label == label[a, None]))

        for batch in batches:
            for r in range(batch.num_rows):
                dim, tile = _tile_of(batch, r)

                def rows(a, score, span, tile=tile):
                    other = tile.label[span] != label[a, None]
                    kth = best.kth.reshape(-1, slots)[a]
                    for s in range(slots):
                        ok = other & (score >= np.maximum(floor[a, s], kth[:, s])[:, None]) & (score <= roof[a, s, None])
                        i, j = np.nonzero(ok)
                        best.add(a[i] * slots + s, score[i, j], tile.ids[span][j])

                for number, vec in _blocks(by_dim, dim):
                    search(tile, vec, boxes, rows, number)
        yield from _emit(best, ids, slots)

    return packed.mapInArrow(run, FOUND)


RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def mine(
    rows: DataFrame, is_anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label: Column | None = None,
    n_positives: int = 5, n_negatives: int = 5, low: int = 80, high: int = 100, anchor_bytes: int = ANCHOR_BYTES,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score); ``is_anchor`` is a condition on vec_id."""
    spark = rows.sparkSession
    clean = stored(quantised(rows, id_col, vec_col, F.col("label") if label is None else label), "vectors")
    packed = tiles(clean)
    anchors = clean.where(is_anchor)
    total = anchors.agg(F.sum(4 * F.size("vec") + 16)).first()[0]
    out = None
    passes = -(-(total or 0) // anchor_bytes)
    for p in range(passes):
        own = anchors.where(F.pmod(F.xxhash64("vec_id"), F.lit(passes)) == p).orderBy("vec_id").collect()  # anchor_bytes at most, but for chance
        if not own:
            continue
        first = stored(_first(positives(packed, own, n_positives), ["anchor_id"], n_positives).select("anchor_id", "rank", "found_id", "score"), "positives")
        place = {r["vec_id"]: i for i, r in enumerate(own)}
        scores = np.full((len(own), n_positives), np.nan)
        for r in first.collect():  # n_positives rows for each anchor of the pass
            scores[place[r["anchor_id"]], r["rank"] - 1] = r["score"]
        found = _first(negatives(packed, own, scores, n_negatives, low, high), ["anchor_id", "slot"], n_negatives)
        pos = first.select("anchor_id", (F.col("rank") - 1).alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
        both = found.join(pos, ["anchor_id", "slot"]).select(
            "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
        )
        both = stored(both, "negatives") if passes > 1 else both
        out = both if out is None else out.unionByName(both)
    return out if out is not None else spark.createDataFrame([], RESULT)
