"""Token counts: how many pieces a unigram tokenizer makes of a text, without making them.

Text is normalised as the tokenizer does: white space ``[\\x20\\x09-\\x0D]+``
separates, every word gets the mark in front (a text's first word only if it has none) and is cut again before each mark inside
it. An Aho-Corasick automaton over the vocabulary yields, for every end
position, all pieces that end there, longest first. Dynamic programming keeps
the best score and the piece count of every prefix. Ties go as in the tokenizer: scores
are added in double precision from left to right, a candidate replaces another only if strictly
better, and candidates come in order of their start, so the longest piece wins a tie.
A character without a piece of its own may also be unknown, at ten below the lowest score;
unknown characters cost their UTF-8 bytes (byte fallback), or together one token where they are neighbours.

Distinct words of a slice are scored once; a word's count is the same everywhere.

Defined results: null, empty and white-space texts have 0 tokens; repeated rows are counted each; other columns don't matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W

MARK = "▁"
UNKNOWN_PENALTY = 10.0
SLICE = 4 << 20
#: word counts kept between slices of a task
KEEP = 1 << 19
_MARK_BYTES = MARK.encode()
_PARTS = re.compile(f"{MARK}[^{MARK}]*")


class CountOnlyViterbi:
    def __init__(self, vocab: list[tuple[str, float]], byte_fallback: bool = True):
        self.unknown = min(s for _, s in vocab) - UNKNOWN_PENALTY
        self.byte_fallback = byte_fallback
        self.auto = ahocorasick.Automaton()
        for piece, score in vocab:
            if piece:
                self.auto.add_word(piece, (len(piece), score))
        self.auto.make_automaton()

    def count(self, s: str) -> int:
        """Pieces of one pre-token."""
        n = len(s)
        best = [float("-inf")] * (n + 1)
        pieces = [0] * (n + 1)
        fused = [False] * (n + 1)  # does the best path end in an unknown character?
        best[0] = 0.0
        at, single = 0, True
        for end, (size, score) in self.auto.iter(s):
            to = end + 1
            if to != at:
                if not single:
                    self._unknown(s, at, best, pieces, fused)
                for k in range(at + 1, to):
                    self._unknown(s, k, best, pieces, fused)
                at, single = to, False
            total = score + best[to - size]
            if total > best[to]:
                best[to], pieces[to], fused[to] = total, pieces[to - size] + 1, False
            single |= size == 1
        if not single:
            self._unknown(s, at, best, pieces, fused)
        for k in range(at + 1, n + 1):
            self._unknown(s, k, best, pieces, fused)
        return pieces[n]

    def _unknown(self, s: str, to: int, best: list[float], pieces: list[int], fused: list[bool]) -> None:
        """The last candidate for an end: its last character as unknown."""
        total = self.unknown + best[to - 1]
        if total > best[to]:
            if self.byte_fallback:
                more = len(s[to - 1].encode("utf-8"))
            else:
                more = 0 if fused[to - 1] else 1
            best[to], pieces[to], fused[to] = total, pieces[to - 1] + more, True

    def word(self, word: str) -> int:
        """Pieces of a word between white space."""
        s = MARK + word
        if MARK not in word:
            return self.count(s)
        return sum(map(self.count, _PARTS.findall(s)))


def load_vocab(model_path: str) -> list[tuple[str, float]]:
    """Normal and user-defined pieces of a sentencepiece file with their scores, in the order of ids.

    Control, unknown, unused and byte pieces are never matched in a text: ``</s>`` in it is four characters.
    """
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model_path)
    never = (sp.is_control, sp.is_unknown, sp.is_unused, sp.is_byte)
    return [(sp.id_to_piece(i), sp.get_score(i)) for i in range(sp.get_piece_size()) if not any(f(i) for f in never)]


@lru_cache(2)
def _load(model_path: str, byte_fallback: bool) -> CountOnlyViterbi:
    """One automaton for each worker process, not for each task."""
    return CountOnlyViterbi(load_vocab(model_path), byte_fallback)


class DocumentCounter:
    """Counts of whole texts, by distinct words."""

    def __init__(self, viterbi: CountOnlyViterbi):
        self.viterbi = viterbi
        self.known: dict[int, int] = {}

    def counts(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(words, tokens) of each row."""
        w = W.words_of(col)
        n = len(w.woff) - 1
        keys, first, which = np.unique(w.hash, return_index=True, return_inverse=True)
        if len(self.known) > KEEP:
            self.known.clear()
        raw, known, word = w.data.tobytes(), self.known, self.viterbi.word
        size = np.empty(len(keys), np.int64)
        for k, (key, a, b) in enumerate(zip(keys.tolist(), w.starts[first].tolist(), w.ends[first].tolist(), strict=True)):
            c = known.get(key)
            if c is None:
                c = known[key] = word(raw[a:b].decode())
            size[k] = c
        n_words = np.diff(w.woff)
        if not len(keys):
            return n_words, np.zeros(n, np.int64)
        total = W.count_by(w.doc, n, size[which])
        # a text that begins with a mark gets no second one in front
        full = np.flatnonzero(n_words)
        begin = w.starts[w.woff[full]]
        for d in full[[raw.startswith(_MARK_BYTES, at) for at in begin.tolist()]]:
            own = w.word(w.woff[d]).decode()
            total[d] += word(own[1:]) - word(own)
        return n_words, total


def token_counts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", byte_fallback: bool = True) -> DataFrame:
    """(doc_id, n_words, n_tokens) for every row."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = DocumentCounter(_load(model_path, byte_fallback))
        for batch in batches:
            for lo, hi in W.slices(batch, "text", SLICE):
                part = batch.slice(lo, hi - lo)
                n_words, n_tokens = counter.counts(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n_words), pa.array(n_tokens)], names=["doc_id", "n_words", "n_tokens"])

    return narrow.mapInArrow(run, "doc_id long, n_words long, n_tokens long")
