"""LM scoring: a sharded Elias-Fano trigram trie learned from all training documents scores all documents.

The model is never whole in one place. Words and trigrams go to shards whose
number follows the corpus; a block of documents sends its distinct words and
trigrams (packed columns, one row a block and shard) and gets sums back:

1. *blocks*: a scan turns documents into token blocks (a written table) and word requests;
2. *words*: each word shard adds up training counts, numbers its words (frequent first) and answers every block;
3. *requests*: a block, now knowing ids and counts, computes the add-one unigram
   score and sends its trigrams (a, b, c), with the documents they stand in, to trigram shards;
4. *shards*: a shard adds up training counts of its trigrams, builds the trie and looks all
   its requests up; a document's log10 probabilities go back as one sum for each block;
5. *scores*: a block adds its shards' sums.

A shard holds all trigrams with the same middle word b, so context totals and
successor lists are complete there. A b that stands more than ``class_tokens`` times in training is split by
classes of c (the first bits of a hash of the word; powers of two, so that a class holds about ``class_tokens`` tokens
at most): the model is then P(c | a b) = Q(class | b) * P(c | a b, class) with
Q(class | b) = (n(b, class) + Q(class)) / (n(b) + 1), Q(class) the class's unigram share. That is a proper
distribution, needs no total from other shards (n(b) is the word's count), and keeps hot words from making a
hot task. Classes follow from the training tokens alone: neither partitions, blocks nor the number of shards change a score.

Tokens are words of the text with A-Z in lower case, then one end. Probability: interpolated
absolute discounting with continuation counts for pairs, down to the add-one unigram; stored 16-bit codes.

Defined results: null or empty text is one end token; no training document at
all gives N = 0 and the model is the unigram alone; repeated rows count and
are scored each; extra columns are not read.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W
from subseg.llm.elias_fano import NgramTrie, dequantise, quantise
from subseg.llm.store import stored

#: tokens of a block; its arrays are what a task holds at once
BLOCK_TOKENS = 800_000
#: tokens for each shard, on average
SHARD_TOKENS = 1_500_000
#: training tokens of a middle word beyond which it is split by classes of the next word
CLASS_TOKENS = 1_000_000
CLASS_BITS = 16
START = np.uint32(0xFFFFFFFF)
END = W.mix(np.array([0x656E64], np.uint64))[0]
QUERY_STEP = 1 << 18
U = np.uint64


def pack(*arrays: np.ndarray) -> bytes:
    """Integer or float arrays as byte planes, compressed."""
    out = io.BytesIO()
    out.write(np.array([len(arrays)], np.int64).tobytes())
    for x in arrays:
        x = np.ascontiguousarray(x)
        out.write(x.dtype.str.encode().ljust(8))
        out.write(np.array([len(x)], np.int64).tobytes())
        out.write(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes() if len(x) else b"")
    return zstandard.ZstdCompressor(level=3).compress(out.getvalue())


def unpack(raw: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(raw)
    at, out = 8, []
    for _ in range(int(np.frombuffer(raw, np.int64, 1)[0])):
        kind = np.dtype(raw[at : at + 8].strip().decode())
        n = int(np.frombuffer(raw, np.int64, 1, at + 8)[0])
        planes = np.frombuffer(raw, np.uint8, n * kind.itemsize, at + 16)
        out.append(np.ascontiguousarray(planes.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += 16 + n * kind.itemsize
    return out


def _rows(schema_names: list[str], kinds: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=schema_names)


BLOCKS = "block long, shard int, tokens binary, words binary"
_BLOCK = (["block", "shard", "tokens", "words"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()])


def token_blocks(docs: DataFrame, shards: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs(doc_id, held_out, text)`` as rows with ``tokens`` (a block's documents) and rows with ``words`` (its request to a word shard)."""

    def emit(block: int, parts: list[tuple]) -> pa.RecordBatch:
        ids, null, held, length = (np.concatenate([p[k] for p in parts]) for k in range(4))
        seq = np.concatenate([p[4] for p in parts])
        hashes, which, count = np.unique(seq, return_inverse=True, return_counts=True)
        order = np.argsort(-count, kind="stable")  # frequent words get small numbers
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        local, hashes = rank[which], hashes[order]
        trained = np.bincount(local[np.repeat(~held, length)], minlength=len(hashes))
        shard = ((hashes >> U(20)) % U(shards)).astype(np.int32)
        rows: list[tuple] = [(block, None, pack(ids, null, held, length, local, shard), None)]
        by = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[by], np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cut)):
            mine = by[cut[s] : cut[s + 1]]
            rows.append((block, int(s), None, pack(hashes[mine], trained[mine])))
        return _rows(*_BLOCK, rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, parts, held_now = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                w = W.words_of(part.column(2), lower=True)
                length = np.diff(w.woff) + 1
                seq = np.insert(w.hash, w.woff[1:], END)
                ids = part.column(0)
                parts.append((ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False), part.column(1).fill_null(False).to_numpy(zero_copy_only=False), length.astype(np.uint32), seq))
                held_now += len(seq)
                if held_now >= block_tokens:
                    yield emit(number, parts)
                    number, parts, held_now = number + 1, [], 0
        if parts:
            yield emit(number, parts)

    return docs.mapInArrow(run, BLOCKS)


def _column(t: pa.Table | pa.RecordBatch, name: str) -> list:
    return t.column(t.schema.get_field_index(name)).to_pylist()


ANSWERS = "block long, shard int, answer binary, total long, known long, classes binary"


def word_answers(requests: DataFrame, shards: int) -> DataFrame:
    """Ids and training counts for every block; one row a shard (block null) with its totals and class sums."""

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = key[0].as_py()
        blocks, asked, counts = [], [], []
        for b in batches:
            for block, words in zip(_column(b, "block"), _column(b, "words"), strict=True):
                h, n = unpack(words)
                blocks.append(block)
                asked.append(h)
                counts.append(n)
        hashes, which = np.unique(np.concatenate(asked), return_inverse=True)
        total = W.count_by(which, len(hashes), np.concatenate(counts))
        order = np.argsort(-total, kind="stable")
        number = np.empty(len(order), np.int64)
        number[order] = np.arange(len(order)) * shards + shard
        known = total > 0
        fine = class_of(hashes)
        mass = np.bincount(fine[known], weights=total[known] + 1.0, minlength=1 << CLASS_BITS)
        rows: list[tuple] = [(None, shard, None, int(total.sum()), int(known.sum()), pack(mass))]
        at = 0
        for block, h in zip(blocks, asked, strict=True):
            mine = which[at : at + len(h)]
            at += len(h)
            rows.append((block, shard, pack(number[mine].astype(np.uint32), total[mine], fine[mine]), None, None, None))
        yield _rows(["block", "shard", "answer", "total", "known", "classes"], [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()], rows)

    return requests.groupBy("shard").applyInArrow(run, ANSWERS)


def class_of(hashes: np.ndarray) -> np.ndarray:
    """The class of a word's hash among 2**CLASS_BITS; its first bits are its class among fewer."""
    return (W.mix(hashes + U(0x2545F4914F6CDD1D)) >> U(64 - CLASS_BITS)).astype(np.uint16)


def class_bits(count: np.ndarray, class_tokens: int) -> np.ndarray:
    """Bits of the classes that a middle word of this training count is split by."""
    return np.clip(np.ceil(np.log2(np.maximum(count / class_tokens, 1.0))), 0, CLASS_BITS).astype(np.int64)


REQUESTS = "block long, shard int, request binary, info binary"


def trigram_requests(blocks: DataFrame, answers: DataFrame, shards: int, total: int, known: int, mass: np.ndarray, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """A row for each block and trigram shard; one more a block with what it knows of its documents (``info``)."""
    norm = float(total + known + 1)
    share = np.concatenate([[0.0], np.cumsum(mass + 1.0 / len(mass))]) / norm  # the unknown word's part is spread evenly

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        rows: list[tuple] = []
        reply = {s: unpack(a) for s, a in zip(_column(right, "shard"), _column(right, "answer"), strict=True)}
        for block, raw in zip(_column(left, "block"), _column(left, "tokens"), strict=True):
            ids, null, held, length, local, shard_of = unpack(raw)
            number, count, fine = (np.zeros(len(shard_of), kind) for kind in (np.uint32, np.int64, np.int64))
            for s, (own, n, own_class) in reply.items():
                at = shard_of == s
                number[at], count[at], fine[at] = own, n, own_class
            if len(reply) != len(np.unique(shard_of)):
                raise RuntimeError("a word shard did not answer")
            log_p1 = np.log10((count + 1) / norm)
            begin = np.cumsum(length.astype(np.int64)) - length
            doc = np.repeat(np.arange(len(length), dtype=np.uint32), length)
            base = np.add.reduceat(log_p1[local], begin)
            n_known = np.add.reduceat((count > 0)[local].astype(np.int64), begin)
            # trigrams (a, b, c); a document begins after two starts
            c = number[local]
            b, a = np.empty_like(c), np.empty_like(c)
            b[1:], a[2:] = c[:-1], c[:-2]
            b[begin], a[begin] = START, START
            a[np.minimum(begin + 1, len(a) - 1)[length > 1]] = START
            # classes of c where b is frequent
            n_b = np.empty(len(c), np.int64)
            n_b[1:] = count[local[:-1]]
            n_b[begin] = count[local[length[0] - 1]]  # as many starts as ends were trained
            bits = class_bits(n_b, class_tokens)
            n_b[bits == 0] = 0
            fine = fine[local]
            coarse = fine >> (CLASS_BITS - bits)
            lo = coarse << (CLASS_BITS - bits)
            log_q = np.where(bits > 0, np.log10(np.maximum(share[lo + (1 << (CLASS_BITS - bits))] - share[lo], 1e-300)), 0.0)
            own_p1, own_q = quantise(log_p1)[local], quantise(log_q)
            # each class of a frequent word is a middle word of its own
            b = b.astype(np.uint64) | (coarse.astype(np.uint64) << U(32))
            shard = ((W.mix(b) >> U(16)) % U(shards)).astype(np.int32)
            del fine, coarse, lo, bits, log_q
            order = np.lexsort(((a.astype(U) << U(32)) | c, b, shard))
            a, b, c, doc, own_p1, own_q, n_b, shard = (x[order] for x in (a, b, c, doc, own_p1, own_q, n_b, shard))
            cut = np.searchsorted(shard, np.arange(shards + 1))
            for s in np.flatnonzero(np.diff(cut)):
                i = slice(cut[s], cut[s + 1])
                new_b = np.append(True, b[i][1:] != b[i][:-1])
                new_a = new_b | np.append(True, a[i][1:] != a[i][:-1])
                new = new_a | np.append(True, c[i][1:] != c[i][:-1])
                words, first, which = np.unique(c[i][new], return_index=True, return_inverse=True)
                runs = lambda outer, inner: np.diff(np.append(np.flatnonzero(outer[inner]), int(inner.sum()))).astype(np.uint32)
                every = np.ones(len(new), bool)
                rows.append((block, int(s), pack(
                    b[i][new_b], runs(new_b, new_a), a[i][new_a], runs(new_a, new), np.diff(words, prepend=words[:1]).astype(np.uint32), words[:1], own_p1[i][new][first], own_q[i][new_b], n_b[i][new_b],
                    which.astype(np.uint32), runs(new, every), doc[i], held,
                ), None))
            rows.append((block, int(block % shards), None, pack(ids, null, held, length, n_known, base)))
        return pa.Table.from_batches([_rows(["block", "shard", "request", "info"], [pa.int64(), pa.int32(), pa.binary(), pa.binary()], rows)])

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, REQUESTS)


def _trie(parts: list[tuple], discount: float) -> tuple[NgramTrie | None, np.ndarray]:
    """The trie of all blocks' trained trigrams (b, a, c, code of c alone, count), and how many tokens stand after each of its words."""
    b, a, c, p1, count = (np.concatenate([p[k] for p in parts]) for k in range(5))
    if not len(b):
        return None, np.zeros(0)
    order = np.argsort((a.astype(U) << U(32)) | c)  # equal rows need no order: their counts are added up
    order = order[np.argsort(b[order], kind="stable")]
    b, a, c, p1, count = b[order], a[order], c[order], p1[order], count[order]
    first = np.flatnonzero(np.append(True, (b[1:] != b[:-1]) | (a[1:] != a[:-1]) | (c[1:] != c[:-1])))
    total = np.add.reduceat(count.astype(np.float64), first)
    own_b = b[first]
    after = np.add.reduceat(total, np.flatnonzero(np.append(True, own_b[1:] != own_b[:-1])))
    return NgramTrie.build(a[first], own_b, c[first], total, dequantise(p1[first]), discount).mapped(), after


def log_class(trie: NgramTrie | None, after: np.ndarray, b: np.ndarray, q: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """log10 Q(class | b) of each class b of a split word (``n_b`` > 0), 0 of other words; ``q``: code of Q(class)."""
    out = np.zeros(len(b))
    split = np.flatnonzero(n_b)
    if len(split):
        seen = np.zeros(len(split))
        if trie:
            at, known = trie.words.find(b[split])
            seen[known] = after[at[known]]
        out[split] = dequantise(quantise(np.log10((seen + 10.0 ** dequantise(q[split])) / (n_b[split] + 1.0))))
    return out


SUMS = "block long, sums binary, info binary"


def shard_sums(requests: DataFrame, discount: float) -> DataFrame:
    """Each shard's trie, asked for all its trigrams: a sum for each document of each block."""

    names, kinds = ["block", "sums", "info"], [pa.int64(), pa.binary(), pa.binary()]

    def rows_of(request: bytes) -> tuple:
        """(b, a, c, code of c alone within its class) of each trigram; how often and in which documents it stands; held-out marks; middle words, their class codes and counts, and which one each trigram has."""
        b, n_a, a, n_c, step, first, p1, q, n_b, which, n_docs, doc, held = unpack(request)
        a_of = np.repeat(np.arange(len(a)), n_c)
        b_of = np.repeat(np.arange(len(b)), n_a)[a_of]
        words = (np.cumsum(step.astype(np.int64)) + first[0]).astype(np.uint32)
        code = np.maximum(p1[which].astype(np.int32) - q[b_of], 0).astype(np.uint16)
        return (b[b_of], a[a_of], words[which], code), n_docs, doc, held, (b, q, n_b), b_of

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # requests stay packed between the two passes over them
        asked: list[tuple] = []
        trained: list[tuple] = []
        for batch in batches:
            for block, request, info in zip(_column(batch, "block"), _column(batch, "request"), _column(batch, "info"), strict=True):
                if request is None:
                    yield _rows(names, kinds, [(block, None, info)])
                    continue
                asked.append((block, request))
                rows, n_docs, doc, held, *_ = rows_of(request)
                count = np.add.reduceat((~held[doc]).astype(np.uint32), np.cumsum(n_docs, dtype=np.int64) - n_docs)
                seen = count > 0
                trained.append((*(x[seen] for x in rows), count[seen]))
        if not asked:
            return
        trie, after = _trie(trained, discount)
        del trained
        for block, request in asked:
            (b, a, c, p1), n_docs, doc, held, middle, b_of = rows_of(request)
            value = dequantise(p1)
            if trie:
                for lo in range(0, len(value), QUERY_STEP):
                    i = slice(lo, lo + QUERY_STEP)
                    value[i] = trie.log_prob(a[i], b[i], c[i], value[i])
            if middle[2].any():
                value += log_class(trie, after, *middle)[b_of]
            yield _rows(names, kinds, [(block, pack(np.bincount(doc, weights=np.repeat(value, n_docs), minlength=len(held))), None)])

    return requests.groupBy("shard").applyInArrow(run, SUMS)


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def block_scores(sums: DataFrame, total: int) -> DataFrame:
    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score, info = 0.0, None
        for batch in batches:
            for s, i in zip(_column(batch, "sums"), _column(batch, "info"), strict=True):
                if i is not None:
                    info = unpack(i)
                else:
                    score = score + unpack(s)[0]
        ids, null, held, length, n_known, base = info
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, mask=null), pa.array(held), pa.array(length.astype(np.int64)), pa.array(n_known), pa.array(np.full(len(ids), total)), pa.array(base), pa.array(score)],
            names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    return sums.groupBy("block").applyInArrow(run, SCORES)


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", discount: float = 0.75, block_tokens: int = BLOCK_TOKENS, shard_tokens: int = SHARD_TOKENS, class_tokens: int = CLASS_TOKENS) -> DataFrame:
    """Scores of every document under the model of those that are not ``held_out``; see the module's text."""
    spark = docs.sparkSession
    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), held_out.cast("boolean").alias("held_out"), text.alias("text"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # words shards come first, before the tokens are counted: bytes say how many there may be
    size = narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(least, size // (6 * shard_tokens))
    blocks = stored(token_blocks(narrow, shards, block_tokens), "blocks")
    answers = stored(word_answers(blocks.where("words is not null").select("block", "shard", "words"), shards), "words")
    total = known = 0
    mass = np.zeros(1 << CLASS_BITS)
    for r in answers.where("block is null").select("total", "known", "classes").toLocalIterator():  # a row a shard
        total, known = total + r["total"], known + r["known"]
        mass += unpack(r["classes"])[0]
    requests = trigram_requests(blocks.where("tokens is not null").select("block", "tokens"), answers.where("block is not null").select("block", "shard", "answer"), shards, total, known, mass, class_tokens)
    return block_scores(shard_sums(requests, discount), total)
