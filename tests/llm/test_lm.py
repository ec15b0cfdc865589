"""Elias-Fano trie against dictionaries; sharded scores against one model; split classes are a distribution."""
import collections
import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_helpers import make  # noqa: F401
from subseg.llm import lm_scoring as L
from subseg.llm.elias_fano import EliasFano, NgramTrie

D = 0.75


@pytest.mark.parametrize("high", [1, 3, 40, 10**6, 10**12])
def test_elias_fano(high):
    rng = np.random.default_rng(high % 97)
    for n in (0, 1, 2, 1000):
        v = np.sort(rng.integers(0, high, n)).astype(np.uint64)
        e = EliasFano.encode(v)
        if n:
            assert (e.access(np.arange(n)) == v).all()
        q = np.concatenate([v, rng.integers(0, 2 * high, 500).astype(np.uint64)])
        at, equal = e.find(q)
        assert (at == np.searchsorted(v, q)).all() and (equal == np.isin(q, v)).all()


def test_it_is_compact():
    v = np.sort(np.random.default_rng(1).integers(0, 10**9, 10_000))
    assert EliasFano.encode(v).nbytes * 8 < 10_000 * (math.log2(10**5) + 3)


class Brute:
    """The same model in dictionaries, over one list of trigrams with counts."""

    def __init__(self, tri, p1):
        self.tri, self.p1 = tri, p1
        self.cont = collections.Counter((y, z) for _, y, z in tri)
        self.tb, self.nb, self.tab, self.nab = (collections.Counter() for _ in range(4))
        for (y, _), m in self.cont.items():
            self.tb[y] += m
            self.nb[y] += 1
        for (x, y, _), m in tri.items():
            self.tab[x, y] += m
            self.nab[x, y] += 1

    def p(self, x, y, z):
        p = self.p1(z)
        if y in self.tb:
            p = max(self.cont[y, z] - D, 0) / self.tb[y] + D * self.nb[y] / self.tb[y] * p
        if (x, y) in self.tab:
            p = max(self.tri[x, y, z] - D, 0) / self.tab[x, y] + D * self.nab[x, y] / self.tab[x, y] * p
        return p


def test_trie():
    rng = np.random.default_rng(3)
    toks = rng.zipf(1.3, 8000) % 300
    tri = collections.Counter(zip(toks[:-2].tolist(), toks[1:-1].tolist(), toks[2:].tolist()))
    keys = sorted(tri, key=lambda k: (k[1], k[0], k[2]))
    a, b, c = (np.array(x) for x in zip(*keys))
    uni = np.bincount(toks, minlength=300) + 1
    p1 = uni / uni.sum()
    trie = NgramTrie.build(a, b, c, np.array([tri[k] for k in keys], float), np.log10(p1[c])).mapped()
    brute = Brute(tri, lambda z: p1[z])
    ask = keys + [tuple(map(int, q)) for q in np.stack([rng.integers(0, 320, 2000), rng.integers(0, 320, 2000), rng.integers(0, 300, 2000)], axis=1)]
    qa, qb, qc = (np.array(x) for x in zip(*ask))
    got = trie.log_prob(qa, qb, qc, np.log10(p1[qc]))
    assert np.abs(got - [math.log10(brute.p(*q)) for q in ask]).max() < 2e-3
    assert abs(sum(10 ** trie.log_prob(np.full(300, a[50]), np.full(300, b[50]), np.arange(300), np.log10(p1))) - 1) < 0.01


def tokens(t):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low)) + ["\0end"]


def corpus(n=120, seed=5):
    rng = np.random.default_rng(seed)
    vocab = [f"w{i}" for i in range(200)]
    return [None if i % 40 == 7 else " ".join("The" if k % 3 else vocab[k] for k in (rng.zipf(1.2, int(rng.integers(0, 60))) % 200)) for i in range(n)]


def brute_scores(texts, held):
    tok = [tokens(t) for t in texts]
    cnt = collections.Counter(w for t, h in zip(tok, held) if not h for w in t)
    n, v = sum(cnt.values()), len(cnt)
    grams = [list(zip(s[:-2], s[1:-1], s[2:])) for s in (["\0s", "\0s", *t] for t in tok)]
    model = Brute(collections.Counter(g for x, h in zip(grams, held) if not h for g in x), lambda z: (cnt[z] + 1) / (n + v + 1))
    base = [sum(math.log10((cnt[w] + 1) / (n + v + 1)) for w in t) for t in tok]
    return n, [len(t) for t in tok], [sum(cnt[w] > 0 for w in t) for t in tok], base, [sum(math.log10(model.p(*g)) for g in x) for x in grams]


def run(spark, make, texts, partitions, shards, **kw):
    spark.conf.set("spark.sql.shuffle.partitions", shards)
    try:
        docs = make(texts).repartition(partitions)
        return L.score_documents(docs, F.col("doc_id") % 4 == 1, **kw).toPandas().set_index("doc_id").sort_index()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)


def test_scores(spark, make):
    texts = corpus()
    n, n_tokens, n_known, base, score = brute_scores(texts, [i % 4 == 1 for i in range(len(texts))])
    got = run(spark, make, texts, 3, 1, block_tokens=500)  # one shard: no word is split
    assert got.n_tokens.tolist() == n_tokens and got.n_known.tolist() == n_known and set(got.train_tokens) == {n}
    assert got.held_out.tolist() == [i % 4 == 1 for i in range(len(texts))]
    np.testing.assert_allclose(got.base_score, base, rtol=1e-9)
    assert np.abs((got.score - score) / got.n_tokens).max() < 2e-3


def word_class(w):
    h = L.END if w == "\0end" else L.W.words_of(pa.array([w]), lower=True).hash[0]
    return int(L.class_of(np.array([h], np.uint64))[0])


def brute_split_scores(texts, held, class_tokens):
    """The model whose frequent middle words are split by classes of the next word, in dictionaries."""
    tok = [tokens(t) for t in texts]
    cnt = collections.Counter(w for t, h in zip(tok, held) if not h for w in t)
    norm = sum(cnt.values()) + len(cnt) + 1
    cnt["\0s"] = cnt["\0end"]
    cls = {w: word_class(w) for t in tok for w in t}
    bits = {w: min(max(0, math.ceil(math.log2(max(cnt[w] / class_tokens, 1)))), L.CLASS_BITS) for w in ["\0s", *cls]}
    of = lambda y, z: cls[z] >> (L.CLASS_BITS - bits[y])
    share = lambda y, z: 1.0 if not bits[y] else (sum(n + 1 for w, n in cnt.items() if n and w != "\0s" and of(y, w) == of(y, z)) + 2.0 ** -bits[y]) / norm
    shares = {}
    grams = [list(zip(s[:-2], s[1:-1], s[2:])) for s in (["\0s", "\0s", *t] for t in tok)]
    tri, after = collections.Counter(), collections.Counter()
    for x, h in zip(grams, held):
        for a, b, c in [] if h else x:
            tri[a, (b, of(b, c)), c] += 1
            after[b, of(b, c)] += 1
    model = Brute(tri, None)
    out = []
    for x in grams:
        total = 0.0
        for a, b, c in x:
            k = (b, of(b, c))
            q1 = shares[k] = shares.get(k) or share(b, c)
            model.p1 = lambda z, q1=q1: (cnt[z] + 1) / norm / q1
            q = (after[k] + q1) / (cnt[b] + 1) if bits[b] else 1.0
            total += math.log10(q * model.p(a, k, c))
        out.append(total)
    assert any(bits.values())
    return out


def test_split_words(spark, make):
    """Frequent words are split by classes: scores are those of the stated model, whatever the blocks."""
    texts = corpus(200)
    held = [i % 4 == 1 for i in range(len(texts))]
    want = brute_split_scores(texts, held, 40)
    one, two = (run(spark, make, texts, n, 40, block_tokens=size, class_tokens=40) for n, size in ((1, 700), (7, 90)))
    np.testing.assert_array_equal(one.score, two.score)
    assert np.abs((one.score - want) / one.n_tokens).max() < 3e-3


def test_classes_are_a_distribution():
    rng = np.random.default_rng(2)
    share = rng.dirichlet(np.ones(8))
    n = rng.integers(0, 9000, 8).astype(float)
    q = L.log_class(None, np.zeros(0), np.arange(8, dtype=np.uint64), L.quantise(np.log10(share)), np.full(8, 1))
    assert abs((10**q).sum() - 0.5) < 0.01  # nothing seen: the unigram share of what smoothing holds
    key = np.arange(8, dtype=np.uint64)
    trie = L.NgramTrie.build(np.zeros(8, np.uint32), key, np.ones(8, np.uint32), n + 1, np.full(8, -1.0))
    q = L.log_class(trie, n + 1, key, L.quantise(np.log10(share)), np.full(8, int(n.sum()) + 8))
    assert abs((10**q).sum() - 1) < 0.01


def test_scores_do_not_follow_the_partitions(spark, make):
    texts = corpus(150, seed=8)
    got = [run(spark, make, texts, parts, shards, class_tokens=100) for parts, shards in ((1, 1), (3, 8), (8, 200))]
    for other in got[1:]:
        np.testing.assert_array_equal(got[0].score, other.score)


def test_repeated_text_scores_higher(spark, make):
    texts = corpus(60, seed=9)
    texts[1] = texts[2]  # held out, but a copy of a training document
    got = run(spark, make, texts, 2, 16, class_tokens=30)
    assert got.score[1] > got.base_score[1]
    # by how much trigrams help beyond the words alone: far more in the copy than in any unseen text
    gain = (got.score - got.base_score) / got.n_tokens
    unseen = got.held_out & (got.index != 1) & (got.n_tokens > 5)
    print(gain[1], gain[unseen].max())
    assert gain[1] > gain[unseen].max() + 0.2


def test_no_training_document(spark, make):
    got = L.score_documents(make(["a b", ""]), F.lit(True)).toPandas().set_index("doc_id")
    assert got.train_tokens.tolist() == [0, 0] and got.n_known.tolist() == [0, 0] and got.base_score.tolist() == [0.0, 0.0]
