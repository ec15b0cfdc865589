"""Prefix trie of conversations by the Euler-tour technique.

A node is a distinct sequence of first turns (role, text); its members are the conversations that start with it.

1. Turns are numbered per conversation over range partitions. A prefix is named by a
   polynomial hash modulo 2**127 - 1 of its turns' digests, carried along the turns of a conversation; where a conversation
   crosses range partitions, each part is hashed alone and the carry is multiplied in afterwards.
2. Nodes are counts by (depth, hash), reduced before the shuffle. A node's own name is
   (smallest member, depth), which is unique. Siblings are ordered by smallest member;
   the next sibling is the next row number.
3. Each node has an enter and an exit arc. The tour goes from enter to the first child's enter (or the own exit), from
   exit to the next sibling's enter (or the parent's exit).
4. The tour is ranked as a list: a task links the arcs of its range of (smallest member, depth) into chains by pointer
   doubling; the list of chains, far shorter, is ranked by pointer jumping, in rounds of joins, or in one
   task if it has ``ONE_TASK_CHAINS`` rows at most (same result).
5. Leaves and savings of a subtree are differences of the prefix sums at its two arcs.

Members that end at a node are hashed as a stream of sorted chunks of ids.

Defined results: rows with a null id take no part; a null role or text is empty; a null turn comes first; turns of equal number are ordered by
the digest of role and text, repeated rows are repeated turns. Very long texts and conversations count whole. No
conversation gives no node. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm.store import stored
from subseg.operators.numbering import number_in_groups, number_rows

PRIME = (1 << 127) - 1
BASE = 0x1F3D5B79A2C4E6081B2D3F5A7C9E0F13
ROOT_HASH = 1
LOW = (1 << 64) - 1
#: chains up to which the contracted list is ranked in one task
ONE_TASK_CHAINS = 20_000
#: bytes of ids in a chunk
CHUNK_BYTES = 1 << 16


def _keep(name: str):
    return lambda df: stored(df, name)


def turn_table(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, pos, digest, chars): each conversation's turns numbered from 0; texts stay behind as 128-bit digests."""
    role, text = F.coalesce(F.col(f"`{role_col}`"), F.lit("")), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    digest = F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary"))
    t = rows.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").alias("turn"), digest.alias("digest"), F.char_length(text).cast("long").alias("chars"))
    t = t.where("conv_id is not null")
    return number_in_groups(t, ["conv_id"], [F.col("turn").asc_nulls_first(), "digest"], "pos", _keep("turns")).select("conv_id", "pos", "digest", "chars")


def lengths(turns: DataFrame) -> DataFrame:
    return turns.groupBy("conv_id").agg(F.count("*").alias("len"))


def grafted(turns: DataFrame, block: int = 100, most: int = 6) -> tuple[DataFrame, DataFrame]:
    """Every conversation c with the first h turns of conversation c - c % block in place of its own first h, h = crc32(c) % most.

    Returns (conv_id, len) and (conv_id, pos, digest, chars)."""
    convs = lengths(turns).withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).withColumn("base", F.col("conv_id") - F.col("conv_id") % block)
    heads = convs.select(F.col("conv_id").alias("base"), F.col("len").alias("base_len"))
    convs = convs.join(heads, "base", "left").withColumn("head", F.least("h", F.coalesce("base_len", F.lit(0))))
    convs = stored(convs.withColumn("new_len", F.col("head") + F.greatest(F.col("len") - F.col("h"), F.lit(0))), "conversations")
    given = turns.where(F.col("pos") < most).withColumnRenamed("conv_id", "base")  # most turns of each base, for block conversations
    head = convs.select("conv_id", "base", "head").join(given, "base").where("pos < head").select("conv_id", "pos", "digest", "chars")
    own = turns.join(convs.select("conv_id", "h", "head"), "conv_id").where("pos >= h")
    tail = own.select("conv_id", (F.col("head") + F.col("pos") - F.col("h")).alias("pos"), "digest", "chars")
    return convs.select("conv_id", F.col("new_len").alias("len")), head.union(tail)


# ---- prefix hashes

HASHED = "conv_id long, depth long, chars long, hi long, lo long, phi long, plo long, steps long, task long, last boolean"


def _halves(values: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([v >> 64 for v in values], np.int64), np.array([v & LOW for v in values], np.uint64).view(np.int64)


def _joined(hi: np.ndarray, lo: np.ndarray) -> list[int]:
    return [(h << 64) | x for h, x in zip(hi.tolist(), lo.view(np.uint64).tolist(), strict=True)]


def prefix_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, chars, hi, lo, phi, plo): the hash of each conversation's first ``depth`` turns and that of one turn less."""
    spark = turns.sparkSession
    dealt = turns.repartitionByRange("conv_id", "pos").sortWithinPartitions("conv_id", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        conv = value = steps = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out, before, n = [], [], []
            for c, p, d in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("conv_id", "pos", "digest")), strict=True):
                if c != conv:
                    # a conversation that begins in another task: its carry comes later, times BASE**steps
                    conv, value, steps = c, (0 if p else ROOT_HASH), (0 if p else None)
                before.append(value)
                value = (value * BASE + int(d, 16) + 1) % PRIME
                steps = None if steps is None else steps + 1
                out.append(value)
                n.append(steps)
            last = np.zeros(batch.num_rows, bool)
            cols = [batch.column(batch.schema.get_field_index("conv_id")), pc.add(batch.column(batch.schema.get_field_index("pos")), 1), batch.column(batch.schema.get_field_index("chars"))]
            cols += [pa.array(x) for v in (out, before) for x in _halves(v)]
            cols += [pa.array(n, pa.int64()), pa.array(np.full(batch.num_rows, task, np.int64)), pa.array(last)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "chars", "hi", "lo", "phi", "plo", "steps", "task", "last"])
        if conv is not None:  # what the next task may need: its last conversation so far
            hi, lo = _halves([value])
            none = pa.nulls(1, pa.int64())
            cols = [pa.array([conv]), none, none, pa.array(hi), pa.array(lo), none, none, pa.array([steps], pa.int64()), pa.array([task], pa.int64()), pa.array([True])]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "chars", "hi", "lo", "phi", "plo", "steps", "task", "last"])

    table = stored(dealt.mapInArrow(run, HASHED), "prefixes")
    carry: dict[int, int] = {}
    full, of = 0, None
    for r in sorted(table.where("last").select("task", "conv_id", "hi", "lo", "steps").collect()):  # one row a task
        value = _joined(np.array([r["hi"]]), np.array([r["lo"]]))[0]
        if of is not None:
            carry[r["task"]] = full
        full = (full * pow(BASE, r["steps"], PRIME) + value) % PRIME if r["steps"] is not None else value
        of = r["conv_id"]
    known = spark.sparkContext.broadcast(carry)

    def mend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = lambda c, b=batch: b.column(b.schema.get_field_index(c)).to_numpy()
            steps, more = col("steps"), [known.value[t] for t in col("task").tolist()]
            cols = [batch.column(i) for i in range(3)]
            for h, x, less in (("hi", "lo", 0), ("phi", "plo", 1)):
                v = [(m * pow(BASE, s - less, PRIME) + y) % PRIME for m, s, y in zip(more, steps.tolist(), _joined(col(h), col(x)), strict=True)]
                cols += [pa.array(z) for z in _halves(v)]
            yield pa.RecordBatch.from_arrays(cols, names=["conv_id", "depth", "chars", "hi", "lo", "phi", "plo"])

    names = ["conv_id", "depth", "chars", "hi", "lo", "phi", "plo"]
    whole = table.where("not last and steps is null").select(names)
    parts = table.where("not last and steps is not null").select(*names, "steps", "task")
    return whole.union(parts.mapInArrow(mend, "conv_id long, depth long, chars long, hi long, lo long, phi long, plo long"))


# ---- nodes

def trie_nodes(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(conv_id, depth, hi, lo, parent_conv_id, n_convs, chars, n_children, first_child, next_sibling), the root at depth 0."""
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).where("n_convs > 0")
    zero = F.lit(0).cast("long")
    root = root.select("conv_id", zero.alias("depth"), zero.alias("hi"), F.lit(ROOT_HASH).cast("long").alias("lo"), zero.alias("phi"), zero.alias("plo"), "n_convs", zero.alias("chars"))
    found = prefixes.groupBy("depth", "hi", "lo").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), *[F.min(c).alias(c) for c in ("phi", "plo", "chars")])
    bare = stored(found.select(root.columns).union(root), "nodes")
    above = bare.select((F.col("depth") + 1).alias("depth"), F.col("hi").alias("phi"), F.col("lo").alias("plo"), F.col("conv_id").alias("parent_conv_id"))
    nodes = bare.join(above, ["depth", "phi", "plo"], "left").select("conv_id", "depth", "hi", "lo", "parent_conv_id", "n_convs", "chars")
    nodes = number_rows(nodes, ["depth", "parent_conv_id", "conv_id"], "row_no", _keep("siblings"))
    child = nodes.where("depth > 0").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"))
    child = child.agg(F.count("*").alias("n_children"), F.min("conv_id").alias("first_child"))
    after = nodes.select((F.col("row_no") - 1).alias("row_no"), F.col("depth").alias("d2"), F.col("parent_conv_id").alias("p2"), F.col("conv_id").alias("c2"))
    sibling = F.when((F.col("d2") == F.col("depth")) & (F.col("p2") == F.col("parent_conv_id")), F.col("c2"))
    return nodes.join(after, "row_no", "left").withColumn("next_sibling", sibling).drop("row_no", "d2", "p2", "c2").join(child, ["conv_id", "depth"], "left").withColumn("n_children", F.coalesce("n_children", zero))


# ---- the tour

ARCS = "conv_id long, depth long, enter_chain long, enter_leaves long, enter_saved long, exit_chain long, exit_leaves long, exit_saved long, next_conv long, next_depth long, next_exit boolean, head_exit boolean"
NONE = -(1 << 62)


def double_up(succ: np.ndarray, weights: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """For lists given by successors (-1: none): each element's head, and the sums of weights from the head to it."""
    pred = np.full(len(succ), -1)
    has = np.flatnonzero(succ >= 0)
    pred[succ[has]] = has
    head = np.where(pred >= 0, pred, np.arange(len(succ)))
    sums = [w.copy() for w in weights]
    while (go := np.flatnonzero(pred >= 0)).size:
        for s in sums:
            s[go] += s[pred[go]]
        pred[go] = pred[pred[go]]
        head = head[head]
    return head, sums


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A range of nodes: each node's arcs with their chain and the sums along it; a row for each chain (enter_chain null)."""
    got = list(batches)
    if not sum(b.num_rows for b in got):
        return
    t = pa.Table.from_batches(got)
    col = lambda c: t.column(c).fill_null(NONE).to_numpy()
    conv, depth, parent, first, sibling = (col(c) for c in ("conv_id", "depth", "parent_conv_id", "first_child", "next_sibling"))
    n = len(conv)
    saved = (col("n_convs") - 1) * col("chars")
    leaf = (first == NONE).astype(np.int64)
    me = np.arange(n)
    # arc 2i enters node i, 2i + 1 leaves it
    to_conv, to_depth, to_exit = np.empty((3, 2 * n), np.int64)
    inner = first != NONE
    to_conv[0::2], to_depth[0::2], to_exit[0::2] = np.where(inner, first, conv), np.where(inner, depth + 1, depth), ~inner
    more = sibling != NONE
    to_conv[1::2], to_depth[1::2], to_exit[1::2] = np.where(more, sibling, parent), np.where(more, depth, depth - 1), ~more
    end = np.zeros(2 * n, bool)
    end[1::2] = depth == 0
    # a conversation names nodes of consecutive depths
    at = np.minimum(np.searchsorted(conv, to_conv), n - 1)
    at = at + to_depth - depth[at]
    here = (at >= 0) & (at < n) & ~end
    at = np.where(here, at, 0)
    here &= (conv[at] == to_conv) & (depth[at] == to_depth)
    succ = np.where(here, 2 * at + to_exit, -1)
    weights = [np.zeros(2 * n, np.int64), np.zeros(2 * n, np.int64)]
    weights[0][0::2], weights[1][0::2] = leaf, saved
    head, (leaves, total) = double_up(succ, weights)
    chain = (np.int64(TaskContext.get().partitionId()) << 33) + head
    null = lambda k, kind=pa.int64(): pa.nulls(k, kind)
    e, x = 2 * me, 2 * me + 1
    names = [f.split()[0] for f in ARCS.split(", ")]
    yield pa.RecordBatch.from_arrays(
        [pa.array(a) for a in (conv, depth, chain[e], leaves[e], total[e], chain[x], leaves[x], total[x])] + [null(n), null(n), null(n, pa.bool_()), null(n, pa.bool_())], names=names
    )
    tail = np.flatnonzero(succ < 0)
    h = head[tail]
    m = len(tail)
    last = end[tail]
    cols = [pa.array(conv[h // 2]), pa.array(depth[h // 2]), null(m), null(m), null(m), pa.array(chain[tail]), pa.array(leaves[tail]), pa.array(total[tail])]
    cols += [pa.array(to_conv[tail], mask=last), pa.array(to_depth[tail], mask=last), pa.array(to_exit[tail].astype(bool), mask=last), pa.array(h % 2 == 1)]
    yield pa.RecordBatch.from_arrays(cols, names=names)


def ranked(chains: DataFrame, one_task: int = ONE_TASK_CHAINS) -> DataFrame:
    """(chain, leaves, saved) summed from each chain to the list's end, of ``chains(chain, next, leaves, saved)``."""
    chains = stored(chains, "chains")
    if chains.count() <= one_task:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = list(batches)
            if not sum(b.num_rows for b in got):
                return
            t = pa.Table.from_batches(got).sort_by("chain")
            name, nxt = t.column("chain").to_numpy(), t.column("next").fill_null(-1).to_numpy()
            pred = np.where(nxt >= 0, np.searchsorted(name, nxt), -1)
            # sums to the end are sums from the head of the reversed list
            back = np.full(len(name), -1)
            has = np.flatnonzero(pred >= 0)
            back[pred[has]] = has
            _, sums = double_up(back, [t.column(c).to_numpy().copy() for c in ("leaves", "saved")])
            yield pa.RecordBatch.from_arrays([pa.array(name), *[pa.array(s) for s in sums]], names=["chain", "leaves", "saved"])

        return chains.repartition(1).mapInArrow(run, "chain long, leaves long, saved long")
    while chains.where("next is not null").head(1):
        b = chains.select(F.col("chain").alias("next"), F.col("next").alias("n2"), F.col("leaves").alias("l2"), F.col("saved").alias("s2"))
        both = chains.join(b, "next", "left")
        add = lambda x, y: F.col(x) + F.coalesce(F.col(y), F.lit(0))
        chains = stored(both.select("chain", F.col("n2").alias("next"), add("leaves", "l2").alias("leaves"), add("saved", "s2").alias("saved")), "chains")
    return chains.select("chain", "leaves", "saved")


def subtree_sums(nodes: DataFrame, one_task: int = ONE_TASK_CHAINS) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens) of each node's subtree."""
    cols = ["conv_id", "depth", "parent_conv_id", "first_child", "next_sibling", "n_convs", "chars"]
    dealt = nodes.select(cols).repartitionByRange("conv_id", "depth").sortWithinPartitions("conv_id", "depth")
    arcs = stored(dealt.mapInArrow(_chains, ARCS), "arcs")
    chains = arcs.where("enter_chain is null").select(
        F.col("exit_chain").alias("chain"), F.col("exit_leaves").alias("leaves"), F.col("exit_saved").alias("saved"),
        "conv_id", "depth", "head_exit", "next_conv", "next_depth", "next_exit",
    )
    heads = chains.select(F.col("chain").alias("next"), F.col("conv_id").alias("next_conv"), F.col("depth").alias("next_depth"), F.col("head_exit").alias("next_exit"))
    linked = chains.drop("conv_id", "depth", "head_exit").join(heads, ["next_conv", "next_depth", "next_exit"], "left").select("chain", "next", "leaves", "saved")
    rest = stored(ranked(linked, one_task), "ranks")
    one = rest.toDF("enter_chain", "el", "es")
    two = rest.toDF("exit_chain", "xl", "xs")
    own = arcs.where("enter_chain is not null").join(one, "enter_chain").join(two, "exit_chain")
    # an arc's prefix sum is the total less what follows from its chain's head, plus the sum along the chain
    leaves = (F.col("exit_leaves") - F.col("xl")) - (F.col("enter_leaves") - F.col("el"))
    saved = (F.col("exit_saved") - F.col("xs")) - (F.col("enter_saved") - F.col("es"))
    return own.select("conv_id", "depth", leaves.alias("leaves_after"), saved.alias("saved_after"))


# ---- members that end at a node

def end_hashes(ends: DataFrame) -> DataFrame:
    """(depth, hi, lo, ends_sha256): SHA-256 of the ids of ``ends(depth, hi, lo, conv_id)``, ascending, comma-joined."""
    key = ["depth", "hi", "lo"]
    names = [*key, "first", "ids"]

    def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, ids, size, out = None, [], 0, []
        for batch in batches:
            for *k, c in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in (*key, "conv_id")), strict=True):
                if k != node or size > CHUNK_BYTES:
                    if ids:
                        out.append((*node, ids[0], ",".join(map(str, ids))))
                    node, ids, size = k, [], 0
                ids.append(c)
                size += 12
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)
                out = []
        if ids:
            out.append((*node, ids[0], ",".join(map(str, ids))))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=names)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state, out = None, None, []
        for batch in batches:
            for *k, ids in zip(*(batch.column(batch.schema.get_field_index(x)).to_pylist() for x in (*key, "ids")), strict=True):
                if k != node:
                    if node is not None:
                        out.append((*node, state.hexdigest()))
                    node, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if len(out) > 1000:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*key, "ends_sha256"])
                out = []
        if node is not None:
            out.append((*node, state.hexdigest()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], names=[*key, "ends_sha256"])

    order = [*key, "conv_id"]
    parts = ends.select(order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(chunks, "depth long, hi long, lo long, first long, ids string")
    return parts.repartition(*key).sortWithinPartitions(*key, "first").mapInArrow(digest, "depth long, hi long, lo long, ends_sha256 string")


def prefix_trie(convs: DataFrame, turns: DataFrame, one_task: int = ONE_TASK_CHAINS) -> DataFrame:
    """A row per node of the trie of ``convs(conv_id, len)`` and their ``turns(conv_id, pos, digest, chars)``, len turns each.

    Returns (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    prefixes = stored(prefix_hashes(turns), "hashes")
    nodes = stored(trie_nodes(convs, prefixes), "trie")
    sums = subtree_sums(nodes, one_task)
    last = prefixes.join(convs.withColumnRenamed("len", "depth"), ["conv_id", "depth"]).select("depth", "hi", "lo", "conv_id")
    turnless = convs.where("len = 0").select(F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(ROOT_HASH).cast("long"), "conv_id")
    ends = end_hashes(last.union(turnless))
    out = nodes.join(sums, ["conv_id", "depth"]).join(ends, ["depth", "hi", "lo"], "left")
    own_leaf = (F.col("n_children") == 0).cast("long")
    return out.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children",
        (F.col("leaves_after") + own_leaf).alias("n_leaves"),
        (F.col("saved_after") + (F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"),
    )
