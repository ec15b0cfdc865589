"""Words, word hashes and document statistics straight from Arrow string buffers.

Everything here is vectorised over the UTF-8 bytes of a slice of documents, so
that no Python object is made for a word. A word is a maximal run of bytes
outside ``[\\x20\\x09-\\x0D]``; UTF-8 never holds those bytes inside a longer
character, so byte words are the words of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: bytes of text handled at once; a longer document makes a slice of its own
SLICE_BYTES = 1 << 20
#: bytes hashed at once, so that a very long document needs no wide array of its length
HASH_BYTES = 1 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

U = np.uint64
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_BYTE[SPACE] = 0
_BASE = U(0x9E3779B97F4A7C15)
_STEP = U(0xD6E8FEB86659FD93)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> U(30)
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_POWERS = np.ones(1, np.uint64)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 2 * len(_POWERS), 1024)
        p = np.full(size, _BASE, np.uint64)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets of each row's bytes); a null row is empty."""
    col = pc.fill_null(col, "")
    wide = pa.types.is_large_string(col.type)
    raw = col.buffers()
    offs = np.frombuffer(raw[1], np.int64 if wide else np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8)[offs[0] : offs[-1]] if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def slices(batch: pa.RecordBatch, text_col: str, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of a batch that hold at most ``limit`` bytes of text each (or one row)."""
    if not batch.num_rows:
        return
    _, offs = text_buffers(batch.column(batch.schema.get_field_index(text_col)))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), batch.num_rows)
        yield lo, hi
        lo = hi


@dataclass
class Words:
    """The words of some documents: bytes ``data[starts[i]:ends[i]]``; document d has words ``woff[d]:woff[d+1]``."""

    data: np.ndarray
    offs: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    woff: np.ndarray
    hash: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.woff) - 1), np.diff(self.woff))

    def word(self, i: int) -> bytes:
        return self.data[self.starts[i] : self.ends[i]].tobytes()


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of maximal runs outside ``space``; a run never crosses a document."""
    sp = space[data]
    first, last = ~sp, ~sp
    first[1:] &= sp[:-1]
    last[:-1] &= sp[1:]
    edge = np.unique(offs[(offs < len(data))])
    first[edge] = ~sp[edge]
    edge = edge[edge > 0] - 1
    last[edge] = ~sp[edge]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, weight: np.ndarray = _BYTE) -> np.ndarray:
    """A 64-bit hash of each span; bytes of weight 0 after a span's end don't count."""
    out = np.empty(len(starts), np.uint64)
    i = 0
    while i < len(starts):
        j = max(int(np.searchsorted(ends, starts[i] + HASH_BYTES, side="right")), i + 1)
        lo, hi = int(starts[i]), int(ends[j - 1])
        at = starts[i:j] - lo
        size = ends[i:j] - starts[i:j]
        part = weight[data[lo:hi]]
        width = np.diff(np.append(at, hi - lo))
        pos = np.arange(hi - lo) - np.repeat(at, width)
        longest = int(size.max())
        part *= _powers(longest + 1)[np.minimum(pos, longest)]
        out[i:j] = mix(np.add.reduceat(part, at) ^ (size.astype(np.uint64) * _STEP))
        i = j
    return out


def words_of(col: pa.Array, lower: bool = False, space: np.ndarray = SPACE) -> Words:
    """Words of each row; ``space`` marks the bytes that separate them."""
    data, offs = text_buffers(col)
    if lower:
        data = LOWER[data]
    starts, ends = word_spans(data, offs, space)
    weight = _BYTE if space is SPACE else np.where(space, U(0), _BYTE)
    return Words(data, offs, starts, ends, np.searchsorted(starts, offs), span_hashes(data, starts, ends, weight))


def ngram_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every run of ``n`` words (crossing documents too; callers mask those)."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    m = len(h) - n + 1
    acc = h[:m].copy()
    for k in range(1, n):
        acc = acc * _BASE + h[k : k + m]
    return mix(acc ^ U(n * int(_STEP) % 2**64))


def window_docs(woff: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(window starts, documents) of all n-word windows that lie in one document."""
    count = np.maximum(np.diff(woff) - n + 1, 0)
    doc = np.repeat(np.arange(len(count)), count)
    first = np.cumsum(count) - count
    return np.arange(int(count.sum())) - np.repeat(first, count) + np.repeat(woff[:-1], count), doc


def count_by(doc: np.ndarray, n: int, weights: np.ndarray | None = None) -> np.ndarray:
    out = np.bincount(doc, weights=weights, minlength=n)
    return out.astype(np.int64) if weights is None or weights.dtype.kind in "iub" else out


def bytes_per_doc(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """How many bytes of each document are marked."""
    total = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return total[offs[1:]] - total[offs[:-1]]


def in_doc_key(doc: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one document (of a slice)."""
    return mix(h ^ mix((doc.astype(np.uint64) + U(1)) * _BASE))


def repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(is the key found twice or more, is an equal key found earlier) for each entry."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    later = np.zeros(len(key), bool)
    later[order[1:]] = same
    twice = later.copy()
    twice[order[:-1]] |= same
    return twice, later


#: weights for hashing whole lines: a space counts there, a line feed ends the line
_LINE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * U(2) + U(1)
_LINE[0x0A] = 0
_NEWLINE = np.zeros(256, bool)
_NEWLINE[0x0A] = True


@dataclass
class Lines:
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hash: np.ndarray


def lines_of(w: Words) -> Lines:
    """The ``\\n``-split lines that hold a word, in order."""
    starts, ends = word_spans(w.data, w.offs, _NEWLINE)
    if len(w.starts) and len(starts):
        at = np.searchsorted(w.starts, starts)
        has = (at < len(w.starts)) & (w.starts[np.minimum(at, len(w.starts) - 1)] < ends)
        starts, ends = starts[has], ends[has]
    else:
        starts, ends = starts[:0], ends[:0]
    doc = np.searchsorted(w.offs, starts, side="right") - 1
    return Lines(starts, ends, doc, span_hashes(w.data, starts, ends, _LINE))
