"""Removal of repeated 20-word windows by super-k-mer partitioning.

A window is ``span`` consecutive words of one document. A word goes if it is covered by a window
whose word sequence also starts earlier (smaller id, or earlier in the same document).

1. A count sketch of all 2-word grams ranks grams: ordinary ones first, then by doublings of
   their count. A window's minimiser is its least gram by (rank, hash), so the grams of a frequent line or
   passage are chosen only where a window holds nothing rarer.
2. Consecutive windows that share a minimiser travel as one packed string to the bucket of
   that minimiser. Documents go in flushes of ``FLUSH_BYTES``; equal strings of a flush are
   sent once, with their earliest place, so that a hot group is reduced before the shuffle.
3. A bucket expands its strings into windows, sorts them by hash and place, compares the
   words of equal ones, and answers each flush with a bit for every window: is its earliest place here?
4. A flush, which has travelled beside its strings, applies the answers to its documents.

Nothing is sampled or capped, and nothing grows on the driver but the sketch's ranks (``MAX_SKETCH_BITS``).
``docs`` should be a scan or a written table: a task that is run again must see the same rows in the same order.

Defined results: a null text has no words; a text of fewer than ``span`` words stays whole; a very long text is one
row and is handled whole. A null id counts as the largest. Rows of one id are one document
if their words are equal (each gets the same result), else they are ordered by a hash of their words. Case and
punctuation count. Other input columns are not looked at, so their names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W

SPAN = 20
GRAM = 2
FLUSH_BYTES = 8 << 20
#: packed strings that a bucket should hold
BUCKET_BYTES = 16 << 20
MAX_SKETCH_BITS = 24
SKETCH_CHUNK = 1 << 16
TALLY = 400_000

U = np.uint64
_B = U(0x9E3779B97F4A7C15)


def gram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words, joined from runs of powers of two."""
    have, size, power = None, 0, h
    step = 1
    while True:
        if n & step:
            if have is None:
                have, size = power, step
            else:
                m = max(len(h) - size - step + 1, 0)
                have, size = W.mix(have[:m] * _B + power[size : size + m]), size + step
        if size == n:
            return have
        m = max(len(h) - 2 * step + 1, 0)
        power, step = W.mix(power[:m] * _B + power[step : step + m]), 2 * step


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of spans of ``data``, one after the other."""
    if not len(starts):
        return data[:0]
    first = np.cumsum(sizes) - sizes
    return data[np.arange(int(sizes.sum())) + np.repeat(starts - first, sizes)]


def pack(*arrays: np.ndarray) -> bytes:
    head = ",".join(f"{a.dtype.str}{len(a)}" for a in arrays).encode()
    return zstandard.compress(b"\0".join([head, b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)]), 3)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = zstandard.decompress(blob)
    cut = raw.index(b"\0")
    out, at = [], cut + 1
    for part in raw[:cut].decode().split(","):
        kind, n = np.dtype(part[:3]), int(part[3:])
        out.append(np.frombuffer(raw, kind, n, at))
        at += n * kind.itemsize
    return out


# ---- frequent grams


def _sketch(docs: DataFrame, bits: int, gram: int) -> DataFrame:
    """Each task's gram counts by the first bits of their hash, in compressed chunks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, wait, waiting = np.zeros(1 << bits, np.uint32), [], 0

        def tally() -> None:
            bucket, n = np.unique(np.concatenate(wait), return_counts=True)
            counts[bucket] += n.astype(np.uint32)

        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                w = W.words_of(batch.column(1).slice(lo, hi - lo))
                at, _ = W.window_docs(w.woff, gram)
                wait.append((gram_hashes(w.hash, gram)[at] >> U(64 - bits)).astype(np.int32))
                waiting += len(at)
                if waiting > TALLY:
                    tally()
                    wait, waiting = [], 0
        if wait:
            tally()
        size = min(SKETCH_CHUNK, 1 << bits)
        for c in range((1 << bits) // size):
            part = counts[c * size : (c + 1) * size]
            if part.any():  # byte planes: the high ones are almost all zero
                blob = zstandard.compress(part.view(np.uint8).reshape(-1, 4).T.tobytes(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([c], pa.int32()), pa.array([blob], pa.binary())], names=["chunk", "counts"])

    return docs.mapInArrow(run, "chunk int, counts binary")


def _ranks(parts: DataFrame, bits: int) -> np.ndarray:
    """One byte a bucket: 0 up to four times the mean count, then one more each doubling; at most 15."""

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = None
        for b in batches:
            for x in b.column(b.schema.get_field_index("counts")):
                raw = np.frombuffer(zstandard.decompress(x.as_py()), np.uint8).reshape(4, -1)
                part = np.ascontiguousarray(raw.T).view(np.uint32).ravel().astype(np.int64)
                counts = part if counts is None else counts + part
        usual = 4 * float(counts.mean()) + 16
        rank = np.clip(np.floor(np.log2(np.maximum(counts / usual, 0.5))) + 1, 0, 15).astype(np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([rank.tobytes()], pa.binary())], names=["chunk", "rank"])

    out = np.zeros(1 << bits, np.uint8)
    size = min(SKETCH_CHUNK, 1 << bits)
    for r in parts.groupBy("chunk").applyInArrow(add, "chunk int, rank binary").collect():  # 2**bits bytes at most
        out[r["chunk"] * size : (r["chunk"] + 1) * size] = np.frombuffer(r["rank"], np.uint8)
    return out


# ---- super-k-mers of a slice


def least_at(key: np.ndarray, width: int) -> np.ndarray:
    """For each start, the place of the leftmost least key among ``width`` consecutive ones."""
    n = max(len(key) - width + 1, 0)
    at, have = np.arange(len(key)), 1
    while have < width:
        step = min(have, width - have)
        m = len(at) - step
        left, right = at[:m], at[step : step + m]
        at, have = np.where(key[right] < key[left], right, left), have + step
    return at[:n]


def super_kmers(w: W.Words, ranks: np.ndarray, bits: int, span: int, gram: int) -> tuple[np.ndarray, ...]:
    """(first word, windows, document, minimiser key, identity) of each maximal run of windows that share a minimiser."""
    start, doc = W.window_docs(w.woff, span)
    if not len(start):
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    g = gram_hashes(w.hash, gram)
    key = (g >> U(4)) | (ranks[(g >> U(64 - bits)).astype(np.int64)].astype(np.uint64) << U(60))
    least = least_at(key, span - gram + 1)[start]
    new = np.ones(len(start), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (least[1:] != least[:-1])
    run = np.flatnonzero(new)
    n = np.diff(np.append(run, len(start)))
    window = gram_hashes(w.hash, span)
    # a run has at most span - gram + 1 windows, so its first and last window hold all its words
    same = W.mix(window[start[run]] ^ W.mix(window[start[run + n - 1]] + n.astype(np.uint64)))
    return start[run], n, doc[run], W.mix(key[least[run]]), same


def packed_words(w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all words, each followed by one space; where each word starts, and the end)."""
    size = w.ends - w.starts + 1
    at = np.concatenate([[0], np.cumsum(size)])
    out = gather(np.append(w.data, np.uint8(0x20)), w.starts, size)
    out[at[1:] - 1] = 0x20
    return out, at


def _order_keys(ids: pa.Array, w: W.Words) -> tuple[np.ndarray, np.ndarray]:
    """A document's place in the order: its id (none: the largest), then a hash of its words."""
    low = np.array(ids.fill_null(np.iinfo(np.int64).max).to_numpy(zero_copy_only=False), np.int64)
    n = np.diff(w.woff)
    place = np.arange(len(w.hash)) - np.repeat(w.woff[:-1], n)
    total = np.concatenate([[U(0)], np.cumsum(W.mix(w.hash + place.astype(np.uint64) * _B), dtype=np.uint64)])
    return low, (W.mix(total[w.woff[1:]] - total[w.woff[:-1]]) >> U(32)).astype(np.uint32)


SHIPPED = "bucket int, flush long, part int, blob binary"


def _ship(docs: DataFrame, ranks, bits: int, buckets: int, span: int, gram: int) -> DataFrame:
    """Strings of a flush by bucket (part = bucket), and the flush itself (part = -1)."""

    def flush(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        cols = [np.concatenate(x) for x in zip(*[h[:9] for h in held], strict=True)]
        first, n, doc, bucket, same, ids, order, n_words, nulls = cols
        text = np.concatenate([h[9] for h in held])
        at = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(h[10]) for h in held]))])
        woff = np.concatenate([[0], np.cumsum(n_words)])
        pos = first - woff[doc]
        # documents of one key are one document
        by = np.lexsort((order, ids))
        step = np.ones(len(by), np.int64)
        step[1:] = (ids[by][1:] != ids[by][:-1]) | (order[by][1:] != order[by][:-1])
        place = np.empty(len(by), np.int64)
        place[by] = np.cumsum(step)
        code = (place[doc] << 32) + pos
        o = np.lexsort((code, same, bucket))
        lead = np.ones(len(o), bool)
        lead[1:] = same[o][1:] != same[o][:-1]
        entry = np.empty(len(o), np.int64)
        entry[o] = np.cumsum(lead) - 1
        e = o[lead]  # the earliest place of each distinct string
        earliest = code == code[e][entry]
        # within a bucket strings go by place: their ids ascend and are sent as differences
        to = np.lexsort((code[e], bucket[e]))
        back = np.empty(len(e), np.int64)
        back[to] = np.arange(len(e))
        e, entry = e[to], back[entry]
        if len(e):
            cut = np.append(0, np.flatnonzero(np.diff(bucket[e])) + 1)
            rows: list[tuple] = []
            for lo, hi in zip(cut, np.append(cut[1:], len(e)), strict=True):
                x = e[lo:hi]
                lo_byte, size = at[first[x]], at[first[x] + n[x] + span - 1] - at[first[x]]
                rows.append((int(bucket[x[0]]), pack(n[x].astype(np.uint8), np.diff(ids[doc[x]], prepend=0), order[doc[x]], pos[x].astype(np.uint32), gather(text, lo_byte, size))))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.int32()), pa.array([number] * len(rows)), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())],
                names=["bucket", "flush", "part", "blob"],
            )
        own = pack(ids, nulls, n_words, text, entry.astype(np.uint32), n.astype(np.uint8), earliest.astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([number % buckets], pa.int32()), pa.array([number]), pa.array([-1], pa.int32()), pa.array([own], pa.binary())], names=["bucket", "flush", "part", "blob"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        rank = ranks.value
        held: list[tuple] = []
        words = rows = size = count = 0
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                w = W.words_of(part.column(1))
                first, n, doc, key, same = super_kmers(w, rank, bits, span, gram)
                ids, order = _order_keys(part.column(0), w)
                text, at = packed_words(w)
                nulls = np.array(part.column(0).is_null().to_numpy(zero_copy_only=False), np.uint8)
                held.append((first + words, n, doc + rows, (key % U(buckets)).astype(np.int64), same, ids, order, np.diff(w.woff), nulls, text, at))
                words, rows, size = words + len(w.starts), rows + hi - lo, size + len(text)
                if size >= FLUSH_BYTES:
                    yield from flush((task << 32) + count, held)
                    held, words, rows, size, count = [], 0, 0, 0, count + 1
        if held:
            yield from flush((task << 32) + count, held)

    return docs.mapInArrow(run, SHIPPED)


# ---- buckets


def equal_spans(data: np.ndarray, s1: np.ndarray, e1: np.ndarray, s2: np.ndarray, e2: np.ndarray) -> np.ndarray:
    """Do the two spans of each row hold the same bytes?"""
    ok = (e1 - s1) == (e2 - s2)
    at = np.flatnonzero(ok)
    for lo in range(0, len(at), 100_000):
        i = at[lo : lo + 100_000]
        size = e1[i] - s1[i]
        differ = gather(data, s1[i], size) != gather(data, s2[i], size)
        ok[i] = ~np.logical_or.reduceat(differ, np.cumsum(size) - size)
    return ok


def fresh_windows(data: np.ndarray, n: np.ndarray, place: np.ndarray, span: int) -> np.ndarray:
    """For the windows of packed strings (``n`` each, strings at these ranks of order): does no equal window start earlier?"""
    starts, ends = W.word_spans(data, np.array([0, len(data)]))
    first = np.cumsum(n + span - 1) - (n + span - 1)
    entry = np.repeat(np.arange(len(n)), n)
    off = np.arange(len(entry)) - np.repeat(np.cumsum(n) - n, n)
    word = first[entry] + off
    h = gram_hashes(W.span_hashes(data, starts, ends), span)[word]
    code = place[entry] * 64 + off
    sub = np.zeros(len(h), np.int64)
    while True:
        order = np.lexsort((code, sub, h))
        new = np.ones(len(order), bool)
        new[1:] = (h[order][1:] != h[order][:-1]) | (sub[order][1:] != sub[order][:-1])
        lead = np.empty(len(order), np.int64)
        lead[order] = order[np.flatnonzero(new)][np.cumsum(new) - 1]
        # equal hashes are compared word by word: the last word alone where the windows before were compared too
        again = np.flatnonzero(lead != np.arange(len(lead)))
        before = (off[again] > 0) & (off[lead[again]] > 0)
        before &= lead[again - 1] == lead[again] - 1
        a, b = word[again], word[lead[again]]
        from_word = np.where(before, span - 1, 0)
        ok = equal_spans(data, starts[a + from_word], ends[a + span - 1], starts[b + from_word], ends[b + span - 1])
        if ok.all():
            return code == code[lead]
        # a shared hash: number the different texts of its windows
        seen: dict[bytes, int] = {}
        for i in np.flatnonzero(np.isin(h, h[again[~ok]])).tolist():
            sub[i] = seen.setdefault(data[starts[word[i]] : ends[word[i] + span - 1]].tobytes(), len(seen))


def _bucket(span: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        col = lambda b, c: b.column(b.schema.get_field_index(c))
        flushes, parts = [], []
        bucket = key[0].as_py()
        names = ["flush", "part", "blob"]
        for batch in batches:
            own = pc.less(col(batch, "part"), 0)
            if pc.any(own).as_py():
                yield batch.select(names).filter(own)
            rest = batch.filter(pc.invert(own))
            flushes += col(rest, "flush").to_pylist()
            parts += [unpack(x.as_py()) for x in col(rest, "blob")]
        if not parts:
            return
        n, ids, order, pos, text = (np.concatenate(x) for x in zip(*[(p[0], np.cumsum(p[1]), *p[2:]) for p in parts], strict=True))
        n, pos = n.astype(np.int64), pos.astype(np.int64)
        o = np.lexsort((pos, order, ids))
        step = np.ones(len(o), np.int64)
        step[1:] = (ids[o][1:] != ids[o][:-1]) | (order[o][1:] != order[o][:-1]) | (pos[o][1:] != pos[o][:-1])
        place = np.empty(len(o), np.int64)
        place[o] = np.cumsum(step)
        counts = [len(p[0]) for p in parts]
        del parts
        fresh = fresh_windows(text, n, place, span)
        off = np.arange(len(fresh)) - np.repeat(np.cumsum(n) - n, n)
        bits = np.add.reduceat(fresh.astype(np.int64) << off, np.cumsum(n) - n)
        cut = np.cumsum([0, *counts])
        blobs = [pack(bits[lo:hi]) for lo, hi in zip(cut[:-1], cut[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(flushes, pa.int64()), pa.array([bucket] * len(blobs), pa.int32()), pa.array(blobs, pa.binary())], names=names)

    return run


# ---- documents

RESULT = "doc_id long, n_words long, n_removed long, text string, removed array<struct<start:long,end:long>>"


def _finish(span: int):
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, answers = None, []
        for batch in batches:
            part, blob = (batch.column(batch.schema.get_field_index(c)) for c in ("part", "blob"))
            for p, x in zip(part.to_pylist(), blob, strict=True):
                if p < 0:
                    own = unpack(x.as_py())
                else:
                    answers.append((p, unpack(x.as_py())[0]))
        ids, nulls, n_words, text, entry, n, earliest = own
        answers.sort(key=lambda a: a[0])
        n, entry = n.astype(np.int64), entry.astype(np.int64)
        bits = np.concatenate([a[1] for a in answers])[entry] if answers else np.zeros(0, np.int64)
        bits = np.where(earliest, bits, 0)
        off = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        repeat = (np.repeat(bits, n) >> off) & 1 == 0
        docs = len(n_words)
        woff = np.concatenate([[0], np.cumsum(n_words)])
        start, _ = W.window_docs(woff, span)
        edge = np.zeros(int(woff[-1]) + span + 1, np.int64)
        edge[start[repeat]] += 1
        edge[start[repeat] + span] -= 1
        gone = np.cumsum(edge)[: woff[-1]] > 0
        doc = np.repeat(np.arange(docs), n_words)
        # kept words and the space after each, but for a document's last
        at = np.concatenate([[0], np.flatnonzero(text == 0x20) + 1])
        keep = np.repeat(~gone, np.diff(at))
        last = np.full(docs, -1)
        np.maximum.at(last, doc[~gone], np.flatnonzero(~gone))
        keep[at[last[last >= 0] + 1] - 1] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        offsets = kept[at[woff]]
        # maximal runs of removed words
        change = np.flatnonzero(gone & np.concatenate([[True], ~gone[:-1] | (doc[1:] != doc[:-1])])) if len(gone) else np.zeros(0, np.int64)
        ends = np.flatnonzero(gone & np.concatenate([~gone[1:] | (doc[1:] != doc[:-1]), [True]])) + 1 if len(gone) else change
        spans = pa.StructArray.from_arrays([pa.array(change - woff[doc[change]]), pa.array(ends - woff[doc[change]])], names=["start", "end"])
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, mask=nulls.astype(bool)),
                pa.array(n_words.astype(np.int64)),
                pa.array(W.count_by(doc[gone], docs)),
                pa.StringArray.from_buffers(docs, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(text[keep])),
                pa.ListArray.from_arrays(pa.array(np.searchsorted(doc[change], np.arange(docs + 1)), pa.int32()), spans),
            ],
            names=["doc_id", "n_words", "n_removed", "text", "removed"],
        )

    return run


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, gram: int = GRAM, sketch_bits: int | None = None, buckets: int | None = None) -> DataFrame:
    """(doc_id, n_words, n_removed, text, removed) for every row: the words left, joined by one space, and the word spans that went.

    ``span`` is 63 + ``gram`` at most. The result is the same for any ``gram``, ``sketch_bits`` and ``buckets``.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = sketch_bits or min(max((size // 256).bit_length(), 10), MAX_SKETCH_BITS)
    buckets = buckets or max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * size // BUCKET_BYTES)
    ranks = spark.sparkContext.broadcast(_ranks(_sketch(narrow, bits, gram), bits))
    shipped = _ship(narrow, ranks, bits, buckets, span, gram)
    answered = shipped.groupBy("bucket").applyInArrow(_bucket(span), "flush long, part int, blob binary")
    return answered.groupBy("flush").applyInArrow(_finish(span), RESULT)
