"""Elias-Fano sequences and an n-gram trie in compact, memory-mappable levels."""

from __future__ import annotations

import mmap
from dataclasses import dataclass
from functools import cached_property

import numpy as np

U = np.uint64
#: codes per unit of log10; a probability is off by half a step at most
STEP = 1024.0


def quantise(log10_p: np.ndarray) -> np.ndarray:
    """log10 probabilities (0 to -63) as 16-bit codes."""
    return np.clip(np.rint(-log10_p * STEP), 0, 65535).astype(np.uint16)


def dequantise(codes: np.ndarray) -> np.ndarray:
    return codes.astype(np.float64) / -STEP


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Values of ``width`` bits, little end first, back to back; 8 spare bytes follow."""
    if not width or not len(values):
        return np.zeros(8, np.uint8)
    out = np.zeros((len(values) * width + 7) // 8 + 8, np.uint8)
    step = 1 << 16  # a multiple of 8, so every chunk ends on a byte
    for lo in range(0, len(values), step):
        part = values[lo : lo + step]
        bits = (part[:, None] >> np.arange(width, dtype=np.uint64)) & U(1)
        packed = np.packbits(bits.astype(np.uint8).ravel(), bitorder="little")
        out[lo * width // 8 : lo * width // 8 + len(packed)] = packed
    return out


def _unpack_at(packed: np.ndarray, width: int, i: np.ndarray) -> np.ndarray:
    if not width:
        return np.zeros(len(i), np.uint64)
    bit = i.astype(np.int64) * width
    at, shift = bit >> 3, (bit & 7).astype(np.uint64)
    word = packed[at].astype(np.uint64)
    for k in range(1, (width + 14) // 8):
        word |= packed[at + k].astype(np.uint64) << U(8 * k)
    return (word >> shift) & U((1 << width) - 1)


class EliasFano:
    """A monotone sequence: low bits packed, high bits in unary; ``find`` is a successor search: bisection in the bucket of the high bits."""

    def __init__(self, n: int, width: int, low: np.ndarray, upper: np.ndarray):
        self.n, self.width, self.low, self.upper = n, width, low, upper

    @cached_property
    def start(self) -> np.ndarray:
        """Directory, made when first asked: where each bucket of high bits begins; two ends follow."""
        zeros = np.flatnonzero(np.unpackbits(self.upper, bitorder="little") == 0)
        zeros -= np.arange(len(zeros))
        kind = np.int32 if self.n < 1 << 31 else np.int64
        return np.concatenate([np.zeros(1, kind), np.minimum(zeros, self.n).astype(kind), np.full(1, self.n, kind)])

    @cached_property
    def values(self) -> np.ndarray:
        """All elements, decoded once; for short sequences that are read at random."""
        return self.access(np.arange(self.n))

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        values = values.astype(np.uint64)
        n = len(values)
        universe = int(values[-1]) + 1 if n else 1
        width = max(0, (universe // max(n, 1)).bit_length() - 1)
        high = (values >> U(width)).astype(np.int64)
        bits = np.zeros(n + (int(high[-1]) if n else 0) + 1, np.uint8)
        bits[high + np.arange(n)] = 1
        return cls(n, width, _pack(values & U((1 << width) - 1), width), np.packbits(bits, bitorder="little"))

    @property
    def nbytes(self) -> int:
        return self.low.nbytes + self.upper.nbytes

    def access(self, i: np.ndarray) -> np.ndarray:
        high = np.searchsorted(self.start, i, side="right") - 1
        return (high.astype(np.uint64) << U(self.width)) | _unpack_at(self.low, self.width, i)

    def find(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the first element at or above each value, is it equal)."""
        values = values.astype(np.uint64, copy=False)
        h = np.minimum(values >> U(self.width), U(len(self.start) - 2)).astype(np.int64)
        lo, end = self.start[h].astype(np.int64), self.start[h + 1].astype(np.int64)
        target = values & U((1 << self.width) - 1)
        hi = end.copy()
        live = np.flatnonzero(lo < hi)
        while len(live):
            mid = (lo[live] + hi[live]) >> 1
            less = _unpack_at(self.low, self.width, mid) < target[live]
            lo[live[less]] = mid[less] + 1
            hi[live[~less]] = mid[~less]
            live = live[lo[live] < hi[live]]
        equal = lo < end
        equal[equal] = _unpack_at(self.low, self.width, lo[equal]) == target[equal]
        return lo, equal


class Ranges:
    """Sorted integer lists one after another as one monotone sequence: each list is shifted past the one before."""

    def __init__(self, pointers: EliasFano, shift: EliasFano, items: EliasFano):
        self.pointers, self.shift, self.items = pointers, shift, items

    @classmethod
    def encode(cls, begin: np.ndarray, values: np.ndarray) -> Ranges:
        """``begin``: n_lists + 1 positions in ``values``; no list is empty."""
        last = values[begin[1:] - 1].astype(np.uint64) + U(1)
        shift = np.concatenate([np.zeros(1, np.uint64), np.cumsum(last)])
        size = np.diff(begin)
        return cls(EliasFano.encode(begin), EliasFano.encode(shift), EliasFano.encode(values.astype(np.uint64) + np.repeat(shift[:-1], size)))

    @property
    def nbytes(self) -> int:
        return self.pointers.nbytes + self.shift.nbytes + self.items.nbytes

    def find(self, which: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, found) of ``value`` in list ``which``."""
        base, after = self.shift.values[which], self.shift.values[which + 1]
        shifted = base + value.astype(np.uint64)
        inside = shifted < after
        at, equal = self.items.find(np.where(inside, shifted, U(0)))
        return at, equal & inside

    def begin(self, which: np.ndarray) -> np.ndarray:
        return self.pointers.values[which].astype(np.int64)


@dataclass
class NgramTrie:
    """Trigram model (a, b, c): log10 P(c | a b), interpolated absolute discounting, stored with back-off weights.

    Levels: words b; successors c of b (probability c | b); contexts a of b (back-off
    weight of a b); successors c of (a, b), each as its rank among the successors of b, not as a
    word id (context-relative), with probability c | a b.
    """

    words: EliasFano
    word_backoff: np.ndarray
    successors: Ranges
    successor_prob: np.ndarray
    contexts: Ranges
    context_backoff: np.ndarray
    trigrams: Ranges
    trigram_prob: np.ndarray

    @classmethod
    def build(cls, a: np.ndarray, b: np.ndarray, c: np.ndarray, count: np.ndarray, log_p1: np.ndarray, discount: float = 0.75) -> NgramTrie | None:
        """From distinct trigrams sorted by (b, a, c), their counts and the log10 probability of c alone."""
        if not len(a):
            return None
        b_new = np.append(True, b[1:] != b[:-1])
        ba_new = b_new | np.append(True, a[1:] != a[:-1])
        b_no, ba_no = np.cumsum(b_new) - 1, np.cumsum(ba_new) - 1
        # successors of b: how many different words stand before (b, c)
        order = np.argsort((b_no.astype(np.uint64) << U(32)) | c.astype(np.uint64))  # word ids have 32 bits; equal pairs need no order
        sb, sc = b_no[order], c[order]
        s_new = np.append(True, (sb[1:] != sb[:-1]) | (sc[1:] != sc[:-1]))
        s_no = np.empty(len(a), np.int64)
        s_no[order] = np.cumsum(s_new) - 1
        s_first = np.flatnonzero(s_new)
        s_b, s_c, before = sb[s_first], sc[s_first], np.bincount(s_no).astype(float)
        s_ptr = np.searchsorted(s_b, np.arange(b_no[-1] + 2))
        total_b = np.bincount(s_b, weights=before)
        weight_b = discount * np.diff(s_ptr) / total_b
        p1 = np.empty(len(s_first))
        p1[s_no] = 10.0**log_p1
        p2 = (before - discount) / total_b[s_b] + weight_b[s_b] * p1
        # contexts (a, b)
        total = np.bincount(ba_no, weights=count)
        ctx = np.flatnonzero(ba_new)
        t_ptr = np.append(ctx, len(a))
        weight = discount * np.diff(t_ptr) / total
        p3 = (count - discount) / total[ba_no] + weight[ba_no] * p2[s_no]
        return cls(
            EliasFano.encode(b[b_new]), quantise(np.log10(weight_b)),
            Ranges.encode(s_ptr, s_c), quantise(np.log10(p2)),
            Ranges.encode(np.searchsorted(b_no[ctx], np.arange(b_no[-1] + 2)), a[ctx]), quantise(np.log10(weight)),
            Ranges.encode(t_ptr, s_no - s_ptr[b_no]), quantise(np.log10(p3)),
        )

    def log_prob(self, a: np.ndarray, b: np.ndarray, c: np.ndarray, log_p1: np.ndarray) -> np.ndarray:
        """log10 P(c | a b) of each query; ``log_p1`` is what the model falls back to. Neighbouring queries of one b look it up once."""
        out = log_p1.astype(np.float64).copy()
        new = np.append(True, b[1:] != b[:-1]) if len(b) else np.zeros(0, bool)
        run = np.cumsum(new) - 1
        found, known = self.words.find(b[new])
        q = np.flatnonzero(known[run])
        ib = found[run[q]]
        s_at, s_ok = self.successors.find(ib, c[q])
        p2 = dequantise(self.word_backoff[ib]) + log_p1[q]
        p2[s_ok] = dequantise(self.successor_prob[s_at[s_ok]])
        out[q] = p2
        same = np.append(True, (a[q][1:] != a[q][:-1]) | (ib[1:] != ib[:-1])) if len(q) else np.zeros(0, bool)
        run = np.cumsum(same) - 1
        x_at, x_ok = (x[run] for x in self.contexts.find(ib[same], a[q][same]))
        backed = np.flatnonzero(x_ok)
        out[q[backed]] += dequantise(self.context_backoff[x_at[backed]])
        # only a successor of b can be a successor of (a, b): its rank among them is looked up
        both = np.flatnonzero(x_ok & s_ok)
        rank = s_at[both] - self.successors.begin(ib[both])
        t_at, t_ok = self.trigrams.find(x_at[both], rank.astype(np.uint64))
        out[q[both[t_ok]]] = dequantise(self.trigram_prob[t_at[t_ok]])
        return out

    # one flat image of all levels, which a file or an anonymous map can hold

    def _parts(self) -> list[np.ndarray]:
        out: list[np.ndarray] = []
        for s in (self.words, *(e for r in (self.successors, self.contexts, self.trigrams) for e in (r.pointers, r.shift, r.items))):
            out += [np.array([s.n, s.width], np.int64), s.low, s.upper]
        return out + [self.word_backoff, self.successor_prob, self.context_backoff, self.trigram_prob]

    @property
    def nbytes(self) -> int:
        return sum(p.nbytes for p in self._parts())

    def write_image(self, out) -> None:
        parts = self._parts()
        out.write(np.array([len(parts)] + [p.nbytes for p in parts], np.int64).tobytes())
        for p in parts:
            out.write(p.tobytes())
            out.write(b"\0" * (-p.nbytes % 8))

    @classmethod
    def open_image(cls, raw: np.ndarray) -> NgramTrie:
        """Views on an image (a memory map or bytes); nothing but the bucket directories is copied."""
        n = int(raw[:8].view(np.int64)[0])
        sizes = raw[8 : 8 + 8 * n].view(np.int64)
        at, parts = 8 + 8 * n, []
        for s in sizes.tolist():
            parts.append(raw[at : at + s])
            at += s + -s % 8
        seq = [EliasFano(*map(int, parts[3 * k].view(np.int64)), parts[3 * k + 1], parts[3 * k + 2]) for k in range(10)]
        codes = [p.view(np.uint16) for p in parts[30:]]
        r = [Ranges(*seq[1 + 3 * k : 4 + 3 * k]) for k in range(3)]
        return cls(seq[0], codes[0], r[0], codes[1], r[1], codes[2], r[2], codes[3])

    def mapped(self) -> NgramTrie:
        """The same trie read through an anonymous memory map of its image: no file on any machine is left behind."""
        size = 8 + sum(8 + p.nbytes + -p.nbytes % 8 for p in self._parts())
        area = mmap.mmap(-1, size)
        self.write_image(area)
        return NgramTrie.open_image(np.frombuffer(area, np.uint8))
