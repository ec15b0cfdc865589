"""Benchmark decontamination: BM25 inverted index of test items, block-max WAND, overlap check.

The items (blocks of at most ``items_per_index``, so that what is broadcast
has a bound; more items mean more scans) become an inverted index with BM25
impacts, each divided by its item's score against itself: 1 is a full quotation,
and one threshold serves short and long items. Document counts and the average length
come from all items, and a block holds items of one length class (up to 64 words, 128, 256, ...),
so no score depends on which items share a block. Every document is cut into passages of
two strides, a stride at a time, so any item of up to a stride of words lies
whole in some passage; the stride is the class's longest length. Each passage is a query:

* *pivot*: terms are taken from common to rare while no item can reach the
  threshold with them alone. The rest are essential: a passage whose essential
  upper bounds plus the common part's maximum stay below the threshold is skipped;
* *block max*: of the others, blocks of items whose summed term maxima stay
  below the threshold are skipped;
* items of the remaining blocks are scored exactly, all at or above the threshold are kept;
* *verify*: a kept pair counts when the passage holds at least ``overlap`` of the item's
  question 3-grams and of its answer 3-grams (the answer is the item's last sentence).

Items and texts are compared in one case and composed alike (full Unicode case folding, then NFC).

The index is small beside the text, so a document never leaves its task: no shuffle.

Defined results: null or empty texts have no passage; null or wordless items
match nothing; repeated items and rows each give their own result; items shorter
than three words are compared by their whole word sequence; clashing columns don't matter (only the id and the text are read).
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W

U = np.uint64
#: words are runs of ASCII letters, digits and all bytes of other characters: marks around a word don't hide it
SEPARATOR = np.ones(256, bool)
SEPARATOR[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
GRAM = 3
FILTER_BITS = 20
#: words of the longest items of the first length class; each further class goes to twice as many
MIN_STRIDE = 64


def split_item(text: str) -> tuple[str, str]:
    """(question, answer): the answer is the last sentence; a single sentence is both."""
    parts = [p for p in re.split(r"(?<=[.?!])\s+", text.strip()) if p]
    return (" ".join(parts[:-1]), parts[-1]) if len(parts) > 1 else (text, text)


def folded_words(col: pa.Array) -> W.Words:
    """Words of each row, without regard to case and composition; a slice of ASCII is lowered as it is hashed."""
    data, offs = W.text_buffers(col)
    if len(data) and data.max() > 127:
        raw, at = data.tobytes(), offs.tolist()
        col = pa.array([unicodedata.normalize("NFC", raw[a:b].decode(errors="replace").casefold()) for a, b in zip(at[:-1], at[1:], strict=True)], pa.large_string())
    return W.words_of(col, lower=True, space=SEPARATOR)


def _grams(h: np.ndarray) -> np.ndarray:
    return np.unique(W.ngram_hashes(h, min(GRAM, len(h)))) if len(h) else h


@dataclass
class ItemIndex:
    """CSR postings by term; ``block_*`` are the largest impacts by block of items."""

    ids: list
    terms: np.ndarray
    ptr: np.ndarray
    item: np.ndarray
    impact: np.ndarray
    block_ptr: np.ndarray
    block: np.ndarray
    block_max: np.ndarray
    block_size: int
    most: np.ndarray
    essential: np.ndarray
    common_most: float
    threshold: float
    stride: int
    question: list[np.ndarray]
    answer: list[np.ndarray]
    bitmap: np.ndarray


@dataclass
class Counts:
    """Of all items: how many, their average length, and how many hold each term (sorted hashes)."""

    n: int
    average: float
    terms: np.ndarray
    df: np.ndarray


def _item_terms(woff: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(terms, number of items that hold each)."""
    doc = np.repeat(np.arange(len(woff) - 1, dtype=np.uint64), np.diff(woff))
    order = np.lexsort((doc, h))
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return np.unique(h[new], return_counts=True)


def item_counts(sized: DataFrame, text_col: str = "text") -> Counts:
    """Counts over all items, by Spark; what comes back has a row for each distinct word of the items."""
    n, words = sized.agg(F.count(F.lit(1)), F.sum("words")).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, text_col):
                w = folded_words(batch.column(batch.schema.get_field_index(text_col)).slice(lo, hi - lo))
                terms, df = _item_terms(w.woff, w.hash)
                yield pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(df.astype(np.int64))], names=["term", "df"])

    found = sized.select(text_col).mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df")).toArrow()
    terms, df = (found.column(c).to_numpy() for c in ("term", "df"))
    terms = terms.astype(np.int64).view(np.uint64)
    order = np.argsort(terms)
    return Counts(n, (words or 0) / max(n, 1), terms[order], df[order])


def build_index(items: list[tuple], threshold: float = 0.5, k1: float = 1.2, b: float = 0.75, block_size: int = 8, min_stride: int = MIN_STRIDE, counts: Counts | None = None) -> ItemIndex:
    """``items``: (id, text). Scores are BM25 with each term of the passage counted once; ``counts`` is of all items if these are a part."""
    texts = [t or "" for _, t in items]
    w = folded_words(pa.array(texts, pa.string()))
    n, length = len(items), np.diff(w.woff)
    stride = min_stride << length_class(int(length.max(initial=0)), min_stride)
    all_n, avg = (counts.n, counts.average) if counts else (n, length.mean() if n else 1.0)
    avg = max(avg, 1.0)
    doc = w.doc
    key = np.stack([w.hash, doc.astype(np.uint64)], axis=1)
    pairs, tf = np.unique(key, axis=0, return_counts=True) if len(key) else (key, np.zeros(0, int))
    terms, at, df = np.unique(pairs[:, 0], return_index=True, return_counts=True)
    item = pairs[:, 1].astype(np.int64)
    all_df = counts.df[np.searchsorted(counts.terms, terms)] if counts else df
    idf = np.log1p((all_n - all_df + 0.5) / (all_df + 0.5))
    impact = np.repeat(idf, df) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * length[item] / avg))
    own = np.bincount(item, weights=impact, minlength=n)
    impact = impact / np.maximum(own[item], 1e-12)
    ptr = np.append(at, len(item))
    # the same by blocks of items
    blocks = item // block_size
    term_no = np.repeat(np.arange(len(terms)), df)
    new = np.flatnonzero(np.append(True, (term_no[1:] != term_no[:-1]) | (blocks[1:] != blocks[:-1]))) if len(item) else np.zeros(0, int)
    block_max = np.maximum.reduceat(impact, new) if len(new) else impact
    block_ptr = np.searchsorted(term_no[new], np.arange(len(terms) + 1))
    most = np.maximum.reduceat(impact, at) if len(at) else impact
    # common terms, as long as no item reaches the threshold with them alone
    reached, essential, common_most = np.zeros(n), np.ones(len(terms), bool), 0.0
    for t in np.argsort(-df, kind="stable"):
        mine = item[ptr[t] : ptr[t + 1]]
        now = reached[mine] + impact[ptr[t] : ptr[t + 1]]
        if now.max() >= 0.9 * threshold:
            break
        reached[mine] = now
        essential[t] = False
        common_most = max(common_most, float(now.max()))
    parts = [split_item(t) for t in texts]
    grams = [[_grams(folded_words(pa.array([p[k]], pa.string())).hash) for p in parts] for k in (0, 1)]
    bitmap = np.zeros(1 << FILTER_BITS, bool)
    bitmap[(terms >> U(64 - FILTER_BITS)).astype(np.int64)] = True
    return ItemIndex([i for i, _ in items], terms, ptr, item, impact, block_ptr, blocks[new], block_max, block_size, most, essential, common_most, threshold, stride, grams[0], grams[1], bitmap)


def _ranges(ptr: np.ndarray, terms: np.ndarray) -> np.ndarray:
    lo, size = ptr[terms], ptr[terms + 1] - ptr[terms]
    return np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)


def search(index: ItemIndex, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(items, scores) at or above the threshold for one passage of distinct terms."""
    none = np.zeros(0, np.int64), np.zeros(0)
    at = _ranges(index.block_ptr, terms)
    bound = np.bincount(index.block[at], weights=index.block_max[at])
    alive = bound >= index.threshold - 1e-9
    if not alive.any():
        return none
    at = _ranges(index.ptr, terms)
    at = at[alive[index.item[at] // index.block_size]]
    score = np.bincount(index.item[at], weights=index.impact[at])
    hit = np.flatnonzero(score >= index.threshold - 1e-9)
    return hit, score[hit]


def scan_slice(index: ItemIndex, col: pa.Array, overlap: float) -> list[tuple]:
    """(row, item, score, question share, answer share, first word of the passage), the best passage of each pair."""
    w = folded_words(col)
    if not len(index.terms) or not len(w.hash):
        return []
    hit = np.flatnonzero(index.bitmap[(w.hash >> U(64 - FILTER_BITS)).astype(np.int64)])
    term = np.searchsorted(index.terms, w.hash[hit])
    ok = index.terms[np.minimum(term, len(index.terms) - 1)] == w.hash[hit]
    hit, term = hit[ok], term[ok]
    # half passages: each document has as many strides as its words need
    halves = -(-np.diff(w.woff) // index.stride)
    first = np.cumsum(halves) - halves
    doc = np.searchsorted(w.woff, hit, side="right") - 1
    half = first[doc] + (hit - w.woff[doc]) // index.stride
    bound = np.bincount(half, weights=np.where(index.essential[term], index.most[term], 0.0), minlength=int(halves.sum()) + 1)
    pair = bound[:-1] + bound[1:]
    doc_of = np.repeat(np.arange(len(halves)), halves)
    last = np.append(doc_of[1:] != doc_of[:-1], True)
    pair[last] = bound[:-1][last]
    # a document of one stride has one passage; the last half of a longer one lies in the passage before
    only = last & (halves[doc_of] > 1)
    found: dict[tuple, tuple] = {}
    for h in np.flatnonzero((pair >= index.threshold - index.common_most - 1e-9) & ~only):
        d = int(doc_of[h])
        begin = int(w.woff[d] + (h - first[d]) * index.stride)
        end = int(min(begin + 2 * index.stride, w.woff[d + 1]))
        lo, hi = np.searchsorted(hit, [begin, end])
        items, score = search(index, np.unique(term[lo:hi]))
        if not len(items):
            continue
        inside = np.concatenate([W.ngram_hashes(w.hash[begin:end], k) for k in range(1, GRAM + 1)])
        for i, s in zip(items, score, strict=True):
            q, a = (float(np.isin(g, inside).mean()) for g in (index.question[i], index.answer[i]))
            if min(q, a) >= overlap and ((d, int(i)) not in found or s > found[d, int(i)][0]):
                found[d, int(i)] = (float(s), q, a, begin - int(w.woff[d]))
    return [(d, i, *v) for (d, i), v in sorted(found.items())]


def length_class(words: int, first: int = MIN_STRIDE) -> int:
    """0 for up to ``first`` words, then one more for each doubling."""
    return max(-(-words // first) - 1, 0).bit_length()


def item_indexes(items: DataFrame, id_col: str, text_col: str, items_per_index: int, threshold: float) -> Iterator[ItemIndex]:
    """The stated query set, block by block; a block's items are of one length class."""
    plain = items.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = [np.diff(folded_words(batch.column(1).slice(lo, hi - lo)).woff) for lo, hi in W.slices(batch, "text")]
            words = np.concatenate(words) if words else np.zeros(0, np.int64)
            sort = [length_class(n) for n in words.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(sort, pa.int32())], names=["id", "text", "words", "sort"])

    sized = plain.mapInArrow(run, "id long, text string, words long, sort int")
    counts = item_counts(sized)
    block: list[tuple] = []
    sort = None
    for r in sized.orderBy("sort", "id", "text").toLocalIterator():
        if block and (r["sort"] != sort or len(block) == items_per_index):
            yield build_index(block, threshold, counts=counts)
            block = []
        sort = r["sort"]
        block.append((r["id"], r["text"]))
    if block:
        yield build_index(block, threshold, counts=counts)


def find_leaks(
    docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text",
    threshold: float = 0.5, overlap: float = 0.5, items_per_index: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, score, question_overlap, answer_overlap, first_word): every contaminated pair, its best passage."""
    spark = docs.sparkSession
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    schema = "doc_id long, item_id long, score double, question_overlap double, answer_overlap double, first_word long"
    out = None
    for index in item_indexes(items, item_id, item_text, items_per_index, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for batch in batches:
                for lo, hi in W.slices(batch, "text"):
                    part = batch.slice(lo, hi - lo)
                    rows = scan_slice(index, part.column(1), overlap)
                    if rows:
                        d, i, *rest = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays(
                            [part.column(0).take(pa.array(d)), pa.array([index.ids[k] for k in i], pa.int64()), *[pa.array(c, pa.float64()) for c in rest[:3]], pa.array(rest[3], pa.int64())],
                            names=["doc_id", "item_id", "score", "question_overlap", "answer_overlap", "first_word"],
                        )

        found = narrow.mapInArrow(run, schema)
        out = found if out is None else out.union(found)
    return out if out is not None else spark.createDataFrame([], schema)


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", threshold: float = 0.5, overlap: float = 0.5, items_per_index: int = 20_000) -> DataFrame:
    """``docs`` without the rows that quote an item; rows are dropped where they are, nothing is shuffled."""
    spark = docs.sparkSession
    for index in item_indexes(items, item_id, item_text, items_per_index, threshold):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for lo, hi in W.slices(batch, text_col):
                    part = batch.slice(lo, hi - lo)
                    leaky = {r[0] for r in scan_slice(shared.value, part.column(part.schema.get_field_index(text_col)), overlap)}
                    yield part.filter(pa.array([i not in leaky for i in range(part.num_rows)], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs
