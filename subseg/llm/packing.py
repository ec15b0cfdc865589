"""Packing: documents become token pieces, pieces become sequences by best-fit decreasing.

1. One scan tokenises every document whole, appends the end id and cuts it into
   full windows of ``size`` ids and one rest. Tokenising works on distinct
   words of a slice: the tokenizer never looks across white space, so a word's
   ids are the same wherever it stands.
2. Full windows are sequences as they are. Rests are dealt at random (by hash) to groups of
   about ``group`` pieces; the number of groups follows the count of rests. In a group,
   rests go in from long to short, each into the open window with the least
   capacity that holds it, which a segment tree over remaining capacities finds.

Ids of sequences carry their group, so groups need no common counter.

Defined results: null text is empty and has the end id alone; repeated rows
are packed each; an empty table has no piece; a document's pieces cover its ids once and in order.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from subseg.llm import words as W
from subseg.llm.store import stored

SIZE = 2048
GROUP = 50_000
SLICE = 4 << 20
#: words of a generation, and twice the pieces, whose ids a task keeps between slices
KEEP = 1 << 18
#: words of printable ASCII and Latin letters that a composing normalizer leaves alone
_SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")

# fixed values: the settings of a tokenizer file under which words can be cut here
_NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"


@lru_cache(2)
def _load(path: str):
    """(tokenizer, how its pre-tokenizer writes each Latin letter), once for each worker process; its file must cut words as we do."""
    from tokenizers import Tokenizer

    with open(path, encoding="utf8") as f:
        said = json.load(f)
    parts = (said["pre_tokenizer"] or {}).get("pretokenizers", [{}, {}])
    same = (
        (said["normalizer"] or {}).get("normalizers") == _NORMALIZERS
        and len(parts) == 2
        and (parts[0].get("type"), (parts[0].get("pattern") or {}).get("Regex"), parts[0].get("behavior"), parts[0].get("invert")) == ("Split", _SPLIT, "Removed", True)
        and (parts[1].get("type"), parts[1].get("add_prefix_space"), parts[1].get("use_regex")) == ("ByteLevel", False, False)
        and all(a["content"].startswith("<|") for a in said["added_tokens"])
    )
    if not same:
        raise ValueError(f"{path}: its normalizer or pre-tokenizer is not one whose words are cut into letters, single digits and other marks")
    tok = Tokenizer.from_file(path)
    letters = {c: tok.pre_tokenizer.pre_tokenize_str(chr(c))[0][0] for c in [*range(0xDF, 0x100)] if c != 0xF7}
    return tok, letters


class WordTokens:
    """Ids of texts through ids of their distinct words.

    ``tokenizer_path``: a ``tokenizers`` file whose normalizer and
    pre-tokenizer look at no more than a word between white space, cut words into letters, single
    digits and other marks, and set letters in lower case; its settings are read, and another
    kind of file is refused. Words of printable ASCII and Latin letters are cut
    here in that way; others (control characters too, which the tokenizer writes as other
    characters) by the tokenizer's own parts. Words with an apostrophe or with the
    beginning of a special token go through the whole tokenizer.

    Ids are kept from slice to slice by the words' bytes; within a slice (4 MB) words are told apart by 64-bit
    hashes and lengths.
    """

    def __init__(self, tokenizer_path: str):
        self.tok, self.letters = _load(tokenizer_path)
        self.pieces: dict[str, bytes] = {}
        # of the words met lately, in two generations: a full one becomes the old one
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= KEEP // 2:
                self.pieces.clear()
            ids = self.pieces[piece] = array("I", [t.id for t in self.tok.model.tokenize(piece)]).tobytes()
        return ids

    def word(self, word: str) -> bytes:
        """Ids of one word, as bytes."""
        if "'" in word or "<|" in word:
            return array("I", self.tok.encode(word, add_special_tokens=False).ids).tobytes()
        if _SIMPLE.fullmatch(word):
            parts = _PARTS.findall(word.lower())
            if not word.isascii():
                parts = [p.translate(self.letters) for p in parts]
            return self.piece(parts[0]) if len(parts) == 1 else b"".join(map(self.piece, parts))
        parts = self.tok.pre_tokenizer.pre_tokenize_str(self.tok.normalizer.normalize_str(word))
        return b"".join([self.piece(p) for p, _ in parts])

    def encode(self, col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(offsets, ids) of each row's whole text."""
        w = W.words_of(col)
        if not len(w.hash):
            return np.zeros(len(w.woff), np.int64), np.zeros(0, np.uint32)
        which, keys = pd.factorize(w.hash)
        first = np.empty(len(keys), np.int64)
        first[which[::-1]] = np.arange(len(which) - 1, -1, -1)
        size = w.ends - w.starts
        if not np.array_equal(size, size[first][which]):
            raise ArithmeticError("two words of a slice share a hash")
        raw, known, found = w.data.tobytes(), self.words, []
        for a, b in zip(w.starts[first].tolist(), w.ends[first].tolist(), strict=True):
            key = raw[a:b]
            ids = known.get(key)
            if ids is None:
                ids = self.old.get(key)
                if ids is None:
                    ids = self.word(key.decode())
                if len(known) >= KEEP:
                    self.old, known = known, {}
                    self.words = known
                known[key] = ids
            found.append(ids)
        own = np.fromiter(map(len, found), np.int64, len(found)) >> 2
        begin = np.cumsum(own) - own
        size = own[which]
        at = np.cumsum(size) - size
        flat = np.frombuffer(b"".join(found), np.uint32)[np.arange(int(size.sum())) - np.repeat(at - begin[which], size)]
        return np.concatenate([[0], np.cumsum(size)])[w.woff], flat


class OpenWindows:
    """Open windows by remaining capacity; a segment tree finds the least capacity of at least a length."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.windows: list[list[int]] = [[] for _ in range(size + 1)]

    def _add(self, capacity: int, by: int) -> None:
        i = self.leaves + capacity
        while i:
            self.count[i] += by
            i >>= 1

    def put(self, capacity: int, window: int) -> None:
        self.windows[capacity].append(window)
        self._add(capacity, 1)

    def take(self, need: int) -> tuple[int, int] | None:
        """(capacity, window) of the tightest window, taken out; None if none fits."""
        i = self.leaves + need
        if not self.count[i]:
            # up to the first right sibling with a window, then down its left side
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        capacity = i - self.leaves
        self._add(capacity, -1)
        return capacity, self.windows[capacity].pop()


def best_fit_decreasing(lengths: np.ndarray, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """(window, offset) of each piece; ties go in the order given."""
    window, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    opened = OpenWindows(size)
    n = 0
    for p in np.argsort(-lengths, kind="stable").tolist():
        need = int(lengths[p])
        got = opened.take(need)
        capacity, at = got if got else (size, n)
        n += got is None
        window[p], offset[p] = at, size - capacity
        if capacity > need:
            opened.put(capacity - need, at)
    return window, offset


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, deal int"


def cut_pieces(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1) -> DataFrame:
    """Full windows and rests of every document; ``deal`` is a hash of the piece's ids and place."""
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = WordTokens(tokenizer_path)
        for batch in batches:
            for lo, hi in W.slices(batch, "text", SLICE):
                part = batch.slice(lo, hi - lo)
                off, ids = tokens.encode(part.column(1))
                row, start, length, crc, total = [], [], [], [], []
                for d in range(hi - lo):
                    own = np.append(ids[off[d] : off[d + 1]], np.uint32(end_id)).astype("<u4")
                    for at in range(0, len(own), size):
                        piece = own[at : at + size]
                        row.append(d)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece))
                        total.append(len(own))
                deal = W.mix(np.array(crc, np.uint64) ^ (np.array(start, np.uint64) << W.U(32))) >> W.U(34)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(row)), *[pa.array(c, pa.int64()) for c in (start, length, crc, total)], pa.array(deal.astype(np.int32))],
                    names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"],
                )

    return narrow.mapInArrow(run, PIECES)


def pack(pieces: DataFrame, size: int = SIZE, group: int = GROUP) -> DataFrame:
    """``pieces`` with sequence_id and offset."""
    kept = stored(pieces, "pieces")
    rests = kept.where(F.col("length") < size)
    n = rests.count()
    groups = max(1, -(-n // group))
    # repeated documents have equal pieces; their id spreads them
    dealt = rests.withColumn("part", F.pmod(F.xxhash64("deal", "doc_id"), F.lit(groups)))

    def run(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(batches))
        t = t.sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending")])
        window, offset = best_fit_decreasing(t.column("length").to_numpy(), size)
        first = (key[0].as_py() + 1) << 32
        t = t.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens"]).append_column("sequence_id", pa.array(window + first)).append_column("offset", pa.array(offset))
        yield from t.combine_chunks().to_batches()

    packed = dealt.groupBy("part").applyInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    # a full window is a sequence by itself: negative ids, from its task and its place there
    full = kept.where(F.col("length") == size).withColumn("sequence_id", -F.monotonically_increasing_id() - 1).withColumn("offset", F.lit(0).cast("long"))
    return packed.union(full.select(packed.columns))


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end_id: int = 1, group: int = GROUP) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset) of every piece."""
    return pack(cut_pieces(docs, tokenizer_path, id_col, text_col, size, end_id), size, group)
