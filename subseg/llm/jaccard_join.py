"""Exact n-gram Jaccard self-join by prefix index lists with set-relation skipping.

A document's set is its distinct 5-word shingles (64-bit hashes). Steps:

1. One scan gives each document its set's size and identity (equal sets are one
   node from here on) and adds its shingles to a count sketch of fixed size.
   The merged sketch, one byte a bucket, orders shingles: rare levels first,
   then by hash. Any global order is valid; this one keeps shared passages out of prefixes.
2. A second scan writes each set's prefix (two sets that reach the threshold
   share a shingle there) into index lists, dealt by shingle hash. Lists are
   ordered by set size. For a set, blocks of a list are skipped when the block's sizes
   or its best remaining overlap (size minus position) can't reach the threshold.
3. A set's counts by hash bucket (as many buckets as shingles, a byte each) bound
   the difference of two sets from below: pairs whose counts differ too much are dropped, surely unlinked.
4. Short lists yield their candidate pairs, which are verified on full sets.
5. Long lists are never paired. First every set goes, with its items, to its longest list that still
   holds different components; blocks of such a list are compared inside a task, and a set found similar to one
   set takes over that set's component, so that its other partners need no look. What lists hold different
   components after that is compared exhaustively, block against block, sizes permitting, a task each; lists that
   share sets are compared as one where that moves fewer sets. Tasks
   return only links that join two components, so a list of n sets makes n rows, not pairs.

Nothing is capped: every candidate pair is excluded by a bound, verified, or joins two sets
that are already in one component.

Defined results: null or empty text, or a text without words, has an empty set
(0 shingles), is linked to nothing and is its own component; 1 to 4 words make one
shingle; repeated rows are linked through their equal sets; a null id
never names a component of others. Other input columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W
from subseg.llm.components import connected_components
from subseg.llm.store import stored

SHINGLE = 5
#: the threshold 0.75 as a fraction; 7 * overlap >= 3 * (sizes) says the same
NUM, DEN = 3, 4
#: the sketch has a bucket for every eight words, 2**MAX_SKETCH_BITS at most; its levels, a byte each, are broadcast
MAX_SKETCH_BITS = 26
SKETCH_CHUNK = 1 << 16
#: index lists up to this length yield all their pairs at once
SHORT_LIST = 16
#: entries of a list that are skipped or compared together
BLOCK = 64
#: sets of a long list that a task holds on each side
LIST_BLOCK = 512
#: rounds in which a set is compared within one list only, before what is left is compared exhaustively
VOTES = 1
#: ids up to which candidate documents are found by a broadcast; beyond, by a shuffled join
BROADCAST_IDS = 2_000_000
ENTRIES_PER_SHARD = 1_000_000
FLUSH = 400_000

U = np.uint64


def shingle_sets(col: pa.Array, n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, sorted distinct shingle hashes) of each row."""
    w = W.words_of(col, lower=True)
    docs = len(w.woff) - 1
    at, doc = W.window_docs(w.woff, n)
    grams = W.ngram_hashes(w.hash, n)[at] if len(at) else w.hash[:0]
    lengths = np.diff(w.woff)
    short = np.flatnonzero((lengths > 0) & (lengths < n))
    if len(short):
        whole = np.empty(len(short), np.uint64)
        for k in range(1, n):
            pick = lengths[short] == k
            if pick.any():
                whole[pick] = W.ngram_hashes(w.hash, k)[w.woff[short[pick]]]
        grams, doc = np.concatenate([grams, whole]), np.concatenate([doc, short])
        order = np.argsort(doc, kind="stable")
        grams, doc = grams[order], doc[order]
    bound = np.searchsorted(doc, np.arange(docs + 1))
    grams = grams.copy()
    for d in range(docs):
        grams[bound[d] : bound[d + 1]].sort()
    first = np.ones(len(grams), bool)
    first[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    total = np.concatenate([[0], np.cumsum(first)])
    return total[bound], grams[first]


def set_ids(off: np.ndarray, items: np.ndarray) -> np.ndarray:
    """A 64-bit identity of each set, independent of order; 0 for the empty set."""
    size = np.diff(off)
    out = np.zeros(len(size), np.uint64)
    full = size > 0
    if full.any():
        at = off[:-1][full]
        a = np.add.reduceat(W.mix(items), at)
        b = np.bitwise_xor.reduceat(W.mix(items ^ U(0x5851F42D4C957F2D)), at)
        out[full] = W.mix(a ^ W.mix(b + size[full].astype(np.uint64))) | U(1)
    return out


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


SUMMARY = "doc_id long, n_shingles long, set_id long, chunk int, counts binary"


def _summary(docs: DataFrame, bits: int) -> DataFrame:
    """A row per document, and each task's sketch counts in compressed chunks."""

    def tally(counts: np.ndarray, wait: list[np.ndarray]) -> None:
        bucket, n = np.unique(np.concatenate(wait), return_counts=True)
        counts[bucket] += n.astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wait, waiting = np.zeros(1 << bits, np.uint32), [], 0
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                off, items = shingle_sets(part.column(1))
                wait.append((items >> U(64 - bits)).astype(np.int32))
                waiting += len(items)
                if waiting > FLUSH:
                    tally(counts, wait)
                    wait, waiting = [], 0
                n = hi - lo
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(np.diff(off)), pa.array(set_ids(off, items).view(np.int64)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "chunk", "counts"],
                )
        if wait:
            tally(counts, wait)
        size = min(SKETCH_CHUNK, 1 << bits)
        for c in range((1 << bits) // size):
            part = counts[c * size : (c + 1) * size]
            if part.any():
                # byte planes: the high ones are almost all zero, and compress to nothing
                planes = zstandard.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([c], pa.int32()), pa.array([planes], pa.binary())],
                    names=["doc_id", "n_shingles", "set_id", "chunk", "counts"],
                )

    return docs.mapInArrow(run, SUMMARY)


def _levels(parts: DataFrame, bits: int, total: int) -> np.ndarray:
    """One byte a bucket: 0 within four standard deviations of the mean count, then a level each doubling."""
    mean = total / (1 << bits)
    step = 4 * np.sqrt(mean) + 1

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")):
                raw = np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(4, -1)
                part = np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)
                counts = part if counts is None else counts + part
        level = np.clip(np.floor(np.log2(np.maximum((counts - mean) / step, 0.5))) + 1, 0, 15).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()], pa.binary())], names=["chunk", "level"])

    out = np.zeros(1 << bits, np.uint8)  # buckets without a count stay at level 0
    size = min(SKETCH_CHUNK, 1 << bits)
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, level binary").collect():  # 2**bits bytes at most
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["level"], np.uint8)
    return out


ENTRY_BLOB = "shard int, sets binary, per_set binary, tokens binary, positions binary"


def _prefix_entries(docs: DataFrame, levels, bits: int, shards: int) -> DataFrame:
    """Index entries of each set's prefix, as one row a shard and flush; equal sets of a task enter once."""

    def flush(buf: list[tuple]) -> Iterator[pa.RecordBatch]:
        tok, pos, sid, size = (np.concatenate(x) for x in zip(*buf, strict=True))
        shard = (tok >> U(32)) % U(shards)
        order = np.argsort(shard, kind="stable")
        tok, pos, sid, size, shard = tok[order], pos[order], sid[order], size[order], shard[order]
        cut = np.flatnonzero(np.diff(shard)) + 1
        rows: list[tuple] = []
        for lo, hi in zip(np.append(0, cut), np.append(cut, len(tok)), strict=True):
            s = sid[lo:hi]
            new = np.append(0, np.flatnonzero(s[1:] != s[:-1]) + 1)
            sets = np.stack([s[new], size[lo:hi][new]], axis=1)
            rows.append((int(shard[lo]), sets.tobytes(), np.diff(np.append(new, hi - lo)).astype(np.uint32).tobytes(), tok[lo:hi].astype(np.uint32).tobytes(), pos[lo:hi].tobytes()))
        cols = list(zip(*rows, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *[pa.array(c, pa.binary()) for c in cols[1:]]], names=["shard", "sets", "per_set", "tokens", "positions"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = levels.value
        seen: set[int] = set()
        buf: list[tuple] = []
        held = 0
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                off, items = shingle_sets(batch.column(1).slice(lo, hi - lo))
                ids, size = set_ids(off, items), np.diff(off)
                order_key = (items >> U(4)) | (level[(items >> U(64 - bits)).astype(np.int64)].astype(np.uint64) << U(60))
                for d in np.flatnonzero(size):
                    if (sid := int(ids[d])) in seen:
                        continue
                    seen.add(sid)
                    n = int(size[d])
                    p = n - -(-NUM * n // DEN) + 1
                    key = order_key[off[d] : off[d + 1]]
                    key = np.sort(np.partition(key, p - 1)[:p]) if p < n else np.sort(key)
                    buf.append((W.mix(key), np.arange(p, dtype=np.uint32), np.full(p, sid, np.uint64), np.full(p, n, np.uint64)))
                    held += p
                if held >= FLUSH:
                    yield from flush(buf)
                    buf, held = [], 0
        if buf:
            yield from flush(buf)

    return docs.mapInArrow(run, ENTRY_BLOB)


def _reach(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """May two sets that first meet at these positions reach the threshold?"""
    return (DEN * np.minimum(n1, n2) >= NUM * np.maximum(n1, n2)) & ((NUM + DEN) * np.minimum(n1 - p1, n2 - p2) >= NUM * (n1 + n2))


def links_between(sid: np.ndarray, n: np.ndarray, p: np.ndarray, root: np.ndarray, off: np.ndarray, items: np.ndarray, side: np.ndarray) -> list[tuple[int, int]]:
    """Links that join components among the sets of a list: sets i (``items[off[i]:off[i + 1]]``, sorted) of different
    components that reach the threshold. With two sides (0 and 1) only sets of different sides are compared."""
    order = np.lexsort((sid, n))
    sid, n, p, side = sid[order], n[order], p[order], side[order]
    starts, sizes = off[:-1][order], np.diff(off)[order]
    _, label = np.unique(root[order], return_inverse=True)
    up = np.arange(label.max() + 1)  # forest of components

    def find(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    both = side.any() and not side.all()
    rest = n - p
    out: list[tuple[int, int]] = []

    def values(lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
        size = sizes[lo:hi]
        at = np.arange(int(size.sum())) + np.repeat(starts[lo:hi] - (np.cumsum(size) - size), size)
        return items[at], np.repeat(np.arange(hi - lo), size)

    for lo in range(0, len(n), BLOCK):
        hi = min(lo + BLOCK, len(n))
        known = rows = None
        # sizes beyond the largest that this block's sets can match end the scan
        stop = int(np.searchsorted(n, n[hi - 1] * DEN // NUM, side="right"))
        for at in range(lo, stop, BLOCK):
            to = min(at + BLOCK, stop)
            if (NUM + DEN) * min(rest[lo:hi].max(), rest[at:to].max()) < NUM * (n[lo] + n[at]):
                continue
            ok = _reach(n[lo:hi, None], p[lo:hi, None], n[None, at:to], p[None, at:to]) & (label[lo:hi, None] != label[None, at:to])
            if at == lo:
                ok &= np.arange(lo, hi)[:, None] < np.arange(at, to)[None, :]
            if both:
                ok &= side[lo:hi, None] != side[None, at:to]
            if not ok.any():
                continue
            if known is None:
                v, of = values(lo, hi)
                known, col = np.unique(v, return_inverse=True)
                rows = np.zeros((hi - lo, len(known)), np.float32)
                rows[of, col] = 1
            v, of = values(at, to)
            col = np.minimum(np.searchsorted(known, v), len(known) - 1)
            hit = known[col] == v
            other = np.zeros((to - at, len(known)), np.float32)
            other[of[hit], col[hit]] = 1
            overlap = (rows @ other.T).astype(np.int64)
            ok &= (NUM + DEN) * overlap >= NUM * (n[lo:hi, None] + n[None, at:to])
            before = len(out)
            for x, y in zip(*(z.tolist() for z in np.nonzero(ok)), strict=True):
                a, b = find(label[lo + x]), find(label[at + y])
                if a != b:
                    up[max(a, b)] = min(a, b)
                    out.append((int(sid[lo + x]), int(sid[at + y])))
            if len(out) > before:
                while not np.array_equal(up, up[up]):
                    up = up[up]
                label = up[label]
    return out


LISTS = "a long, b long, list long, n long, pos long"


def _index_lists(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A shard's lists: candidate pairs (a, b) of short lists; entries (a, list, n, pos) of long lists."""
    shard = key[0].as_py()
    parts: list[tuple] = []
    for batch in batches:
        for r in range(batch.num_rows):
            sets, per, tok, pos = (np.frombuffer(batch.column(batch.schema.get_field_index(c))[r].as_py(), t) for c, t in (("sets", np.uint64), ("per_set", np.uint32), ("tokens", np.uint32), ("positions", np.uint32)))
            sets = sets.reshape(-1, 2)
            parts.append((tok, np.repeat(sets[:, 0], per).view(np.int64), np.repeat(sets[:, 1], per).astype(np.int64), pos.astype(np.int64)))
    tok, sid, n, pos = (np.concatenate(x) for x in zip(*parts, strict=True))
    # shingles of one entry say nothing; drop them before the full sort
    order = np.argsort(tok, kind="stable")
    s = tok[order]
    same = s[1:] == s[:-1]
    keep = np.zeros(len(s), bool)
    keep[1:] |= same
    keep[:-1] |= same
    order = order[keep]
    tok, sid, n, pos = tok[order], sid[order], n[order], pos[order]
    order = np.lexsort((pos, sid, n, tok))
    tok, sid, n, pos = tok[order], sid[order], n[order], pos[order]
    new = np.ones(len(tok), bool)
    new[1:] = (tok[1:] != tok[:-1]) | (sid[1:] != sid[:-1])
    tok, sid, n, pos = tok[new], sid[new], n[new], pos[new]
    if not len(tok):
        return
    start = np.flatnonzero(np.append(True, tok[1:] != tok[:-1]))
    length = np.diff(np.append(start, len(tok)))
    size_of = np.repeat(length, length)
    found: list[np.ndarray] = []
    for step in range(1, SHORT_LIST):
        i = np.arange(len(tok) - step)
        i = i[(tok[i] == tok[i + step]) & (size_of[i] <= SHORT_LIST)]
        if not len(i):
            break
        i = i[_reach(n[i], pos[i], n[i + step], pos[i + step])]
        found.append(np.stack([sid[i], sid[i + step]], axis=1))
    long = size_of > SHORT_LIST
    found.append(np.zeros((0, 2), np.int64))
    pair = np.concatenate(found)
    pair.sort(axis=1)
    pair = np.unique(pair, axis=0)
    m = len(pair)
    if m:
        yield pa.RecordBatch.from_arrays([pa.array(pair[:, 0]), pa.array(pair[:, 1]), *[pa.nulls(m, pa.int64())] * 3], names=["a", "b", "list", "n", "pos"])
    i = np.flatnonzero(long)
    for lo in range(0, len(i), 100_000):
        j = i[lo : lo + 100_000]
        yield pa.RecordBatch.from_arrays(
            [pa.array(sid[j]), pa.nulls(len(j), pa.int64()), pa.array((shard << 32) + tok[j].astype(np.int64)), pa.array(n[j]), pa.array(pos[j])], names=["a", "b", "list", "n", "pos"]
        )


def _task_links(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links that join components of one task's sets (a, n, pos, root, side, items)."""
    t = pa.Table.from_batches(list(batches)).combine_chunks()
    col = lambda c: t.column(c).to_numpy()
    lists = t.column("items").chunk(0)
    off = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy())])
    items = lists.flatten().to_numpy().view(np.uint64)
    links = links_between(col("a"), col("n"), col("pos"), col("root"), off, items, col("side"))
    yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], names=["a", "b"])


def _compared(sides: DataFrame, keys: list[str], full: DataFrame) -> DataFrame:
    """Links of rows (a, n, pos, root, side, *keys), a task for each key."""
    both = sides.join(full.withColumnRenamed("set_id", "a"), "a")
    return stored(both.groupBy(*keys).applyInArrow(_task_links, "a long, b long"), "links")


def _voted(entries: DataFrame, full: DataFrame, turn: int) -> DataFrame:
    """Links found when every set looks at its longest open list alone, in blocks that each turn deals anew."""
    best = entries.groupBy("a").agg(F.max(F.struct("size", "list", "n", "pos", "root")).alias("e")).select("a", "e.*")
    voters = best.groupBy("list").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"))
    dealt = best.join(voters, "list").withColumn("block", F.pmod(F.xxhash64("a", F.lit(turn)), F.col("blocks")))
    return _compared(dealt.select("a", "n", "pos", "root", F.lit(0).alias("side"), "list", "block"), ["list", "block"], full)


def _merged(entries: DataFrame) -> DataFrame:
    """Entries (list, a, n, pos, root) with lists that share sets made one where that moves fewer sets: the same few
    sets often stand in thousands of lists. A merged list has no positions (0 excludes nothing)."""
    heads = entries.groupBy("list").agg(F.min("a").alias("b"), (F.count("*") * F.ceil(F.count("*") / LIST_BLOCK)).alias("moved"))
    edges = entries.select("list", "a").join(heads.select("list", "b"), "list").where("a <> b").select("a", "b").distinct()
    cluster = connected_components(edges).select(F.col("node").alias("a"), F.col("root").alias("cluster"))
    lists = heads.join(cluster.withColumnRenamed("a", "b"), "b").select("list", "cluster", "moved")
    once = entries.groupBy("a").agg(F.first("n").alias("n"), F.first("root").alias("root")).join(cluster, "a")  # both are the set's own
    cost = once.groupBy("cluster").agg((F.count("*") * F.ceil(F.count("*") / LIST_BLOCK)).alias("whole"))
    cost = cost.join(lists.groupBy("cluster").agg(F.sum("moved").alias("moved")), "cluster").select("cluster", (F.col("whole") <= F.col("moved")).alias("one"))
    merged = once.join(cost.where("one"), "cluster").select(F.col("cluster").alias("list"), "a", "n", F.lit(0).cast("long").alias("pos"), "root", F.lit(1).alias("kind"))
    apart = lists.join(cost.where("not one"), "cluster").select("list")
    return merged.union(entries.join(apart, "list").select("list", "a", "n", "pos", "root", F.lit(0).alias("kind")))


def _exhausted(entries: DataFrame, full: DataFrame) -> DataFrame:
    """Links among all sets of each open list: blocks of similar sizes against each other, a task for each two blocks."""
    entries = stored(_merged(entries), "merged")
    band = F.floor(F.log(F.col("n")) / float(np.log(DEN / NUM)) + 1e-9).cast("long")  # sets that link are at most one band apart
    banded = entries.withColumn("band", band)
    blocks = banded.groupBy("kind", "list", "band").agg(F.ceil(F.count("*") / LIST_BLOCK).alias("blocks"))
    near = lambda d, name: blocks.select("kind", "list", (F.col("band") + d).alias("band"), F.col("blocks").alias(name))
    place = ["kind", "list", "band"]
    sizes = blocks.join(near(1, "below"), place, "left").join(near(-1, "above"), place, "left")
    x = banded.join(sizes, place).withColumn("own", F.pmod(F.xxhash64("a"), F.col("blocks")))

    def against(count: str, b1, i1, b2, i2, side) -> Column:
        there = F.when(F.col(count) > 0, F.sequence(F.lit(0).cast("long"), F.col(count) - 1)).otherwise(F.array().cast("array<long>"))
        return F.transform(there, lambda j: F.struct(b1.alias("b1"), i1(j).alias("i1"), b2.alias("b2"), i2(j).alias("i2"), side(j).alias("side")))

    b, own = F.col("band"), F.col("own")
    same = against("blocks", b, lambda j: F.least(own, j), b, lambda j: F.greatest(own, j), lambda j: (own > j).cast("int"))
    up = against("above", b, lambda j: own, b + 1, lambda j: j, lambda j: F.lit(0))
    down = against("below", b - 1, lambda j: j, b, lambda j: own, lambda j: F.lit(1))
    pairs = x.select("a", "n", "pos", "root", "kind", "list", F.explode(F.concat(same, up, down)).alias("t")).select("a", "n", "pos", "root", "kind", "list", "t.*")
    return _compared(pairs, ["kind", "list", "b1", "i1", "b2", "i2"], full)


def _long_lists(narrow: DataFrame, sets: DataFrame, long_lists: DataFrame, links: DataFrame, roots: DataFrame) -> DataFrame:
    """Components after every long list is settled."""
    full = None
    for turn in range(VOTES + 1):
        rooted = long_lists.join(roots.withColumnRenamed("node", "a"), "a", "left").withColumn("root", F.coalesce("root", "a"))
        mixed = rooted.groupBy("list").agg(F.min("root").alias("r1"), F.max("root").alias("r2"), F.count("*").alias("size")).where("r1 <> r2")
        entries = stored(rooted.join(mixed.select("list", "size"), "list"), "open")
        if not entries.head(1):
            return roots
        if full is None:
            full = _full_sets(narrow, sets.join(_named(entries.select("a")), "set_id"))
        more = _voted(entries, full, turn) if turn < VOTES else _exhausted(entries, full)
        found = bool(more.head(1))
        if found:
            links = links.union(more)
            roots = connected_components(links)
        elif turn < VOTES:  # nothing more by votes
            more = _exhausted(entries, full)
            return connected_components(links.union(more)) if more.head(1) else roots
    return roots


def bucket_counts(items: np.ndarray) -> np.ndarray:
    """Counts of a set's hashes by their first bits, 255 at most, in at least as many buckets as there are items."""
    bits = max(len(items) - 1, 1).bit_length()
    return np.minimum(np.bincount((items >> U(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8)


def _near(x: np.ndarray, nx: int, y: np.ndarray, ny: int) -> bool:
    """False only if the sets differ in too many items: counts differ by no more than the sets do, also after neighbouring buckets are joined."""
    x, y = x.astype(np.int32), y.astype(np.int32)
    if len(x) > len(y):
        x = x.reshape(len(y), -1).sum(axis=1)
    elif len(y) > len(x):
        y = y.reshape(len(x), -1).sum(axis=1)
    return (NUM + DEN) * int(np.abs(x - y).sum()) <= (DEN - NUM) * int(nx + ny)


def _near_pairs(pairs: DataFrame, tallies: DataFrame) -> DataFrame:
    """The pairs (a, b) that their sets' bucket counts don't exclude."""
    one = tallies.select(F.col("set_id").alias("a"), F.col("n").alias("na"), F.col("tally").alias("ta"))
    two = tallies.select(F.col("set_id").alias("b"), F.col("n").alias("nb"), F.col("tally").alias("tb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("ta", "na", "tb", "nb")), strict=True)
            ok = [_near(np.frombuffer(x, np.uint8), nx, np.frombuffer(y, np.uint8), ny) for x, nx, y, ny in rows]
            yield batch.select(["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.join(one, "a").join(two, "b").select("a", "b", "na", "ta", "nb", "tb").mapInArrow(run, "a long, b long")


def _tallies(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, n, tally) of the wanted (set_id, doc_id): their documents are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                off, items = shingle_sets(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(off, items).view(np.int64)), pa.array(np.diff(off)), pa.array([bucket_counts(items[off[d] : off[d + 1]]).tobytes() for d in range(hi - lo)], pa.binary())],
                    names=["set_id", "n", "tally"],
                )

    found = _documents_of(docs, wanted).mapInArrow(run, "set_id long, n long, tally binary")
    return stored(found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "tallies")


def _documents_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    ids = wanted.select("doc_id").distinct()
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return docs.where("doc_id is not null").join(ids, "doc_id", "left_semi")


def _named(*pairs: DataFrame) -> DataFrame:
    """The sets that pairs (a, b), or entries (a), name."""
    out = None
    for p in pairs:
        for c in [x for x in ("a", "b") if x in p.columns]:
            one = p.select(F.col(c).alias("set_id"))
            out = one if out is None else out.union(one)
    return out.distinct()


def _full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(set_id, items) of the wanted (set_id, doc_id): their documents are read again."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                off, items = shingle_sets(batch.column(1).slice(lo, hi - lo))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(set_ids(off, items).view(np.int64)), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(items.view(np.int64)))], names=["set_id", "items"]
                )

    found = _documents_of(docs, wanted).mapInArrow(run, "set_id long, items array<bigint>")
    return stored(found.join(wanted.select("set_id"), "set_id", "left_semi").dropDuplicates(["set_id"]), "sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the threshold, by full overlap; only sets that a pair names are moved."""
    pairs = stored(pairs.select("a", "b"), "candidates")
    named = _named(pairs)
    n = named.count()
    if not n:
        return pairs
    needed = sets.join(F.broadcast(named) if n <= BROADCAST_IDS else named, "set_id", "left_semi")
    one = needed.select(F.col("set_id").alias("a"), F.col("items").alias("x"))
    two = needed.select(F.col("set_id").alias("b"), F.col("items").alias("y"))
    both = pairs.join(one, "a").join(two, "b")
    return stored(both.where((NUM + DEN) * F.size(F.array_intersect("x", "y")) >= NUM * (F.size("x") + F.size("y"))).select("a", "b"), "links")


def _components_of(per_doc: DataFrame, sets: DataFrame, roots: DataFrame) -> DataFrame:
    """Each document's component, named by the smallest id among all documents of its sets."""
    found = sets.join(roots.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("root", F.coalesce("root", "set_id"))
    named = found.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    by_set = found.join(named, "root").select("set_id", "component_id")
    out = per_doc.join(by_set, "set_id", "left")
    return out.select("doc_id", "n_shingles", "set_id", F.coalesce("component_id", "doc_id").alias("component_id"))


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sketch_bits: int | None = None) -> DataFrame:
    """(doc_id, n_shingles, set_id, component_id) for every row of ``docs``."""
    spark = docs.sparkSession
    narrow = _narrow(docs, id_col, text_col)
    if sketch_bits is None:
        size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        sketch_bits = min(max((size // 48).bit_length(), 10), MAX_SKETCH_BITS)
    summary = stored(_summary(narrow, sketch_bits), "summary")
    per_doc = summary.where("chunk is null").select("doc_id", "n_shingles", "set_id")
    total = per_doc.agg(F.sum("n_shingles")).first()[0] or 0
    sets = stored(per_doc.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id")), "nodes")
    if not total:
        return per_doc.withColumn("component_id", F.col("doc_id"))
    levels = spark.sparkContext.broadcast(_levels(summary.where("chunk is not null").select("chunk", "counts"), sketch_bits, total))
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // (DEN * ENTRIES_PER_SHARD))
    entries = _prefix_entries(narrow, levels, sketch_bits, shards)
    lists = stored(entries.groupBy("shard").applyInArrow(_index_lists, LISTS), "lists")
    pairs = lists.where("b is not null").select("a", "b").distinct()
    long_lists = lists.where("list is not null")
    if not lists.head(1):
        # no two different sets meet; equal sets are one component all the same
        return _components_of(per_doc, sets, sets.select(F.col("set_id").alias("node"), F.col("set_id").alias("root")))

    tallies = _tallies(narrow, sets.join(_named(pairs), "set_id"))
    pairs = stored(_near_pairs(pairs, tallies), "pairs")
    full = _full_sets(narrow, sets.join(_named(pairs), "set_id"))
    links = _verified(pairs, full)
    roots = connected_components(links)
    roots = _long_lists(narrow, sets, long_lists, links, roots)

    return _components_of(per_doc, sets, roots)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component, that of the smallest id. Rows without an id stay."""
    found = stored(jaccard_components(docs, id_col, text_col).select("doc_id", "component_id"), "components")
    key = F.col(f"`{id_col}`").cast("long")
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("__gone")).distinct()
    gone = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
    kept = docs.join(gone, key == F.col("__gone"), "left_anti")
    repeated = found.groupBy("doc_id").count().where("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__again"))
    if not repeated.head(1):
        return kept
    # an id that stands in several rows: one of its rows
    rest = kept.join(repeated, key == F.col("__again"), "left_anti")
    return rest.unionByName(kept.join(repeated, key == F.col("__again"), "left_semi").dropDuplicates([id_col]))
