"""Super-k-mer removal of repeated windows against a walk over all windows in order."""
import random
import re

import numpy as np
import pytest

from llm_helpers import frame, odd_texts
from subseg.llm import substring_dedup as S
from subseg.llm import words as W


def brute(rows, span=20):
    """[(words, removed spans, kept text)] by document; ids are distinct or rows equal."""
    seen, out = {}, {}
    for i, t in sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0)):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = [False] * len(w)
        for k in range(len(w) - span + 1):
            x = tuple(w[k : k + span])
            if x in seen:
                gone[k : k + span] = [True] * span
            seen[x] = 1
        runs = [(m.start(), m.end()) for m in re.finditer("x+", "".join("x" if g else "." for g in gone))]
        out[i] = (len(w), sum(gone), " ".join(a for a, g in zip(w, gone) if not g), runs)
    return out


def found(spark, rows, **kw):
    df = frame(spark, [t for _, t in rows], [i for i, _ in rows], clash=True)
    got = S.drop_repeats(df, **kw).collect()
    assert len(got) == len(rows)
    return [(r.doc_id, (r.n_words, r.n_removed, r.text, [(s.start, s.end) for s in r.removed])) for r in got]


def corpus(seed, n=60):
    """Shared passages, copies, a phrase that most documents hold, runs of one word."""
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(30)] + ["é", "漢字", "a|b", "Ab", "ab"]
    words = lambda k: [rnd.choice(vocab) for _ in range(k)]
    passages = [words(rnd.randint(20, 60)) for _ in range(4)]
    hot = words(12)
    texts = []
    for _ in range(n):
        t = words(rnd.randint(0, 50))
        if rnd.random() < 0.7:
            t += hot + words(rnd.randint(0, 30))
        if rnd.random() < 0.5:
            t += rnd.choice(passages)
        if rnd.random() < 0.2:
            t += ["same"] * rnd.randint(15, 50)
        texts.append(rnd.choice([" ", "\n", " \t "]).join(t))
        if rnd.random() < 0.3:
            texts.append(rnd.choice(texts))
    return texts


@pytest.mark.parametrize("kw", [{}, {"gram": 1, "buckets": 1, "sketch_bits": 4}, {"gram": 7, "buckets": 50}])
def test_equals_walk_over_all_windows(spark, monkeypatch, kw):
    monkeypatch.setattr(S, "FLUSH_BYTES", 2000)
    texts = corpus(7)
    ids = random.Random(1).sample(range(1000), len(texts))
    rows = list(zip(ids, texts))
    want = brute(rows)
    assert sum(w[1] for w in want.values()) > 500
    for i, got in found(spark, rows, **kw):
        assert got == want[i]


def test_odd_rows(spark):
    texts = odd_texts()
    rows = list(zip([*range(len(texts) - 1), None], texts))
    long = rows[7]
    rows += [(100, long[1]), (7, long[1]), (-5, " ".join(long[1].split()[100:200]))]  # a copy, the same row again, an earlier quotation
    want = brute(rows)
    got = found(spark, rows)
    for i, g in got:
        assert g == want[i]
    assert dict(got)[100][1] == 40_000 and dict(got)[7][1] == 100 and dict(got)[-5][1] == 0


def test_rows_of_one_id_with_different_words_are_ordered(spark):
    a = " ".join(f"x{i}" for i in range(30))
    got = found(spark, [(1, a), (1, a + " more")])
    assert sorted(r[1] for _, r in got) == [0, 30]


def test_empty_table(spark):
    got = S.drop_repeats(frame(spark, ["x"]).limit(0))
    assert got.count() == 0 and got.columns == ["doc_id", "n_words", "n_removed", "text", "removed"]


def test_colliding_hashes_are_told_apart(monkeypatch):
    texts = [b"a b c d ", b"a b c e ", b"a b c d ", b"z b c d "]
    data = np.frombuffer(b"".join(texts), np.uint8)
    monkeypatch.setattr(S.W, "span_hashes", lambda d, s, e: np.zeros(len(s), np.uint64))
    assert S.fresh_windows(data, np.array([2, 2, 2, 2]), np.array([3, 1, 2, 4]), 3).tolist() == [False, False, True, True, False, True, True, False]


def test_runs_share_a_minimiser_and_hold_all_windows():
    import pyarrow as pa
    w = W.words_of(pa.array([" ".join(corpus(3, 20)), None, "a b"]))
    start, n, doc, key, same = S.super_kmers(w, np.zeros(16, np.uint8), 4, 20, 4)
    at, _ = W.window_docs(w.woff, 20)
    assert n.sum() == len(at) and n.max() <= 17  # 20 - 4 + 1
    assert (np.concatenate([np.arange(s, s + k) for s, k in zip(start, n)]) == at).all()
    h = S.gram_hashes(w.hash, 4)
    for s, k, m in zip(start, n, key):
        assert all(W.mix((h[i : i + 17] >> np.uint64(4)).min()[None])[0] == m for i in range(s, s + k))
