"""Per-document statistics that the quality operators learn from (one narrow row per document)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from subseg.llm import words as W

#: exact counts
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: shares and means, all finite; 0 for a text without words
RATIOS = (
    "log_words", "mean_word", "symbol_share", "symbol_word_share", "dup_line_share", "repeat_share", "upper_share",
    "digit_share", "punct_share", "pipe_word_share", "bang_word_share", "stop_share", "type_share", "mean_line",
    "short_line_share", "nonascii_share", "long_word_share",
)
#: frequent function words of the languages in use (fixed values)
STOP = (
    "the of and to in a is that it for as with was on be by are this from at or an "
    "de la el que y en los se del las un por con no una su para es al lo como "
    "le les des et une du dans pour qui sur pas plus par au est ce il "
    "der die und den von zu das mit sich auf für ist im dem nicht ein eine als auch"
).split()


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_SYMBOL = _table(b"#*$%&|<>")
_UPPER = _table(bytes(range(65, 91)))
_ALPHA = _table(bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)))
_DIGIT = _table(b"0123456789")
_PUNCT = _table(b".,;:!?\"'()-")
_LEAD = np.ones(256, bool)
_LEAD[0x80:0xC0] = False


def _stop_hashes() -> np.ndarray:
    return np.sort(W.words_of(pa.array([" ".join(STOP)]), lower=True).hash)


def batch_stats(col: pa.Array) -> dict[str, np.ndarray]:
    w = W.words_of(col)
    n = len(w.woff) - 1
    doc, n_words = w.doc, np.diff(w.woff)
    per = lambda table: W.bytes_per_doc(table[w.data], w.offs)
    lead = _LEAD[w.data] & ~W.SPACE[w.data]
    chars = W.bytes_per_doc(lead, w.offs)
    total = np.concatenate([[0], np.cumsum(lead, dtype=np.int64)])
    length = total[w.ends] - total[w.starts]

    lines = W.lines_of(w)
    _, later = W.repeated(W.in_doc_key(lines.doc, lines.hash))
    n_lines = W.count_by(lines.doc, n)
    dup = W.count_by(lines.doc[later], n)

    at, wdoc = W.window_docs(w.woff, 3)
    twice, _ = W.repeated(W.in_doc_key(wdoc, W.ngram_hashes(w.hash, 3)[at] if len(at) else w.hash[:0]))
    mark = np.zeros(len(w.hash) + 2, bool)
    for k in range(3):
        mark[at[twice] + k] = True
    repeat = W.count_by(doc[mark[: len(doc)]], n)

    _, again = W.repeated(W.in_doc_key(doc, w.hash))
    types = n_words - W.count_by(doc[again], n)
    low = W.LOWER[w.data]
    is_stop = np.isin(W.span_hashes(low, w.starts, w.ends), _stop_hashes()) if len(w.starts) else mark[:0]
    first, last = w.data[w.starts], w.data[w.ends - 1]
    symbol_total = np.concatenate([[0], np.cumsum(_SYMBOL[w.data], dtype=np.int64)])
    with_symbol = symbol_total[w.ends] > symbol_total[w.starts]
    line_words = np.searchsorted(w.starts, lines.ends) - np.searchsorted(w.starts, lines.starts)

    nw, nc, nl = np.maximum(n_words, 1), np.maximum(chars, 1), np.maximum(n_lines, 1)
    letters = np.maximum(per(_ALPHA & _LEAD), 1)
    symbols = per(_SYMBOL)
    return {
        "n_words": n_words, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat,
        "log_words": np.log1p(n_words), "mean_word": chars / nw, "symbol_share": symbols / nc,
        "symbol_word_share": W.count_by(doc[with_symbol], n) / nw, "dup_line_share": dup / nl, "repeat_share": repeat / nw,
        "upper_share": per(_UPPER) / letters, "digit_share": per(_DIGIT) / nc, "punct_share": per(_PUNCT) / nc,
        "pipe_word_share": W.count_by(doc[(first == 124) & (w.ends - w.starts == 1)], n) / nw,
        "bang_word_share": W.count_by(doc[last == 33], n) / nw, "stop_share": W.count_by(doc[is_stop], n) / nw,
        "type_share": types / nw, "mean_line": np.log1p(n_words / nl),
        "short_line_share": W.count_by(lines.doc[line_words < 4], n) / nl,
        "nonascii_share": per(_LEAD & (np.arange(256) >= 0xC0)) / nc, "long_word_share": W.count_by(doc[length > 20], n) / nw,
    }


SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("held_key", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTS]
    + [T.StructField(c, T.DoubleType()) for c in RATIOS]
)


def document_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, crc32 of the id's text, exact counts and shares: one row per input row; null text is empty, null ids stay null."""
    from pyspark.sql import functions as F

    narrow = docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.crc32(F.col(f"`{id_col}`").cast("string")).alias("held_key"),
        F.col(f"`{text_col}`").alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi in W.slices(batch, "text"):
                part = batch.slice(lo, hi - lo)
                stats = batch_stats(part.column(2))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1)]
                    + [pa.array(stats[c].astype(np.int64)) for c in COUNTS]
                    + [pa.array(stats[c].astype(np.float64)) for c in RATIOS],
                    names=SCHEMA.names,
                )

    return narrow.mapInArrow(run, SCHEMA)
