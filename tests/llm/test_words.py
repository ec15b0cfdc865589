"""Vectorised words, lines and counts against plain Python."""
import collections
import re

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from subseg.llm import words as W
from subseg.llm.stats import batch_stats

WORD = r"[^\x20\x09-\x0D]+"
text = st.none() | st.text(alphabet="ab C\n\t.#|é漢 \x0b", max_size=40)


def brute(t):
    t = t or ""
    w = re.findall(WORD, t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(WORD, line):
            dup += line in seen
            seen.add(line)
    grams = collections.Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    again = {k + j for k in range(len(w) - 2) if grams[tuple(w[k : k + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(again)


@settings(max_examples=200, deadline=None)
@given(st.lists(text, max_size=8))
def test_counts(texts):
    s = batch_stats(pa.array(texts, pa.string()))
    got = list(zip(*(s[c].tolist() for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"))))
    assert got == [brute(t) for t in texts]
    assert all(np.isfinite(v).all() for v in s.values())


@settings(max_examples=200, deadline=None)
@given(st.lists(text, max_size=8), st.booleans())
def test_words_and_hashes(texts, lower):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    w = W.words_of(pa.array(texts, pa.string()), lower=lower)
    want = [re.findall(WORD, (t or "").translate(low) if lower else t or "") for t in texts]
    got = [[w.word(i).decode() for i in range(w.woff[d], w.woff[d + 1])] for d in range(len(texts))]
    assert got == want
    flat = [x for t in want for x in t]
    by_hash = dict(zip(w.hash.tolist(), flat))
    assert len(by_hash) == len(set(flat)) and [by_hash[h] for h in w.hash.tolist()] == flat


def test_long_words_and_slices():
    texts = ["a" * 3_000_000 + " b", "x y" * 10, None, "a" * 3_000_000]
    w = W.words_of(pa.array(texts, pa.string()))
    assert w.hash[0] == w.hash[-1] != w.hash[1]
    batch = pa.record_batch([pa.array(texts, pa.string())], names=["t"])
    assert [hi - lo for lo, hi in W.slices(batch, "t", 100)] == [1, 2, 1]
