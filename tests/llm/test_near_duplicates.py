"""Jaccard components against brute force; components; the pipeline's stages against what they should keep."""
import collections
import re

import numpy as np
import pytest

import corpus_pipeline
from llm_helpers import SF_SMALL, make  # noqa: F401
from subseg.llm import jaccard_join as J
from subseg.llm.components import connected_components
from subseg.llm.packing import SIZE


def shingles(t):
    low = str.maketrans({chr(i): chr(i + 32) for i in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(texts):
    sets = [shingles(t) for t in texts]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    index = collections.defaultdict(list)
    for i, s in enumerate(sets):
        for j, o in collections.Counter(j for g in s for j in index[g]).items():
            if 100 * o >= 75 * (len(s) + len(sets[j]) - o):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
        for g in s:
            index[g].append(i)
    return [find(i) for i in range(len(sets))], [len(s) for s in sets]


def corpus(seed):
    """Copies, near copies at every distance, families of dozens, shared passages, short texts."""
    rng = np.random.default_rng(seed)
    word = lambda: f"w{rng.integers(0, 3000)}"
    passage = [word() for _ in range(60)]
    texts = [None, "", " \n", "one", "ONE", "one two", "a b c d", "A b c d"]
    for k in range(60):
        base = [word() for _ in range(int(rng.integers(5, 120)))]
        if k % 3 == 0:
            base += passage
        texts.append(" ".join(base))
        for _ in range(int(rng.integers(0, 40 if k % 20 == 0 else 4))):
            near = list(base)
            for _ in range(int(rng.integers(0, max(2, len(base) // 25)))):
                near[int(rng.integers(0, len(near)))] = word()
            if rng.random() < 0.3:
                near = near[int(rng.integers(0, 1 + len(near) // 8)) :]
            texts.append(" ".join(near))
    # chains: each like the next, the ends unlike
    chain = [f"c{i}" for i in range(60)]
    for k in range(12):
        texts.append(" ".join(chain[k * 3 : k * 3 + 40] if k * 3 + 40 <= 60 else chain[-40:]))
    return [texts[i] for i in rng.permutation(len(texts))]


@pytest.mark.parametrize("seed,short,bits", [(1, 16, 22), (2, 2, 10), (3, 4, 4)])
def test_components_match_brute_force(spark, make, monkeypatch, seed, short, bits):
    monkeypatch.setattr(J, "SHORT_LIST", short)
    texts = corpus(seed)
    want, sizes = brute(texts)
    got = J.jaccard_components(make(texts).repartition(5), sketch_bits=bits).toPandas().set_index("doc_id").sort_index()
    assert got.n_shingles.tolist() == sizes
    assert got.component_id.tolist() == want
    assert len(set(want)) < len(texts) - 50
    kept = sorted(r.doc_id for r in J.keep_one(make(texts)).collect()) if seed == 1 else sorted(set(want))
    assert kept == sorted(set(want))


@pytest.mark.parametrize("near", [False, True])
def test_exact_copies_alone(make, near):
    """Unrelated texts with exact copies make no list entry, yet the copies are one component."""
    texts = [" ".join(f"t{k}x{i}" for i in range(20)) for k in range(6)]
    rows = [texts[k] for k in (0, 1, 2, 0, 3, 2, 2, 4, 5)] + ["one two", None, "", "One  two"]
    rows += [" ".join(f"n{i}" for i in range(40)), " ".join(f"n{i}" for i in range(41))] if near else []
    want, sizes = brute(rows)
    got = J.jaccard_components(make(rows).repartition(3)).toPandas().set_index("doc_id").sort_index()
    assert got.n_shingles.tolist() == sizes
    assert got.component_id.tolist() == want
    assert sorted(r.doc_id for r in J.keep_one(make(rows)).collect()) == sorted(set(want))


def test_bucket_counts_exclude_no_link():
    rng = np.random.default_rng(7)
    for _ in range(400):
        n, d = int(rng.integers(1, 400)), int(rng.integers(0, 80))
        x = rng.integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2)
        y = np.concatenate([x[: max(n - d, 0)], rng.integers(0, 2**63, int(rng.integers(0, 60)), dtype=np.uint64)])
        if len(y):
            both = len(set(x.tolist()) & set(y.tolist()))
            near = J._near(J.bucket_counts(x), len(x), J.bucket_counts(y), len(y))
            assert near or 7 * both < 3 * (len(x) + len(y))


def test_links_of_a_list_join_what_all_pairs_would():
    """One side or two, any components known before: the same components as all pairs, and no link too many."""
    rng = np.random.default_rng(5)
    for turn in range(30):
        m = int(rng.integers(2, 220))
        bases = [rng.integers(0, 2**60, int(rng.integers(4, 60)), dtype=np.uint64) for _ in range(6)]
        sets = []
        for _ in range(m):
            b = bases[int(rng.integers(0, 6))]
            keep = b[rng.random(len(b)) > rng.choice([0.0, 0.05, 0.2])]
            sets.append(np.unique(np.concatenate([keep, rng.integers(0, 2**60, int(rng.integers(1, 5)), dtype=np.uint64)])))
        n = np.array([len(x) for x in sets])
        off = np.concatenate([[0], np.cumsum(n)])
        root = rng.integers(0, m, m) if turn % 2 else np.arange(m)
        side = rng.integers(0, 2, m) if turn % 3 == 0 else np.zeros(m, int)
        sid = rng.permutation(10 * m)[:m]
        links = J.links_between(sid, n, np.zeros(m, np.int64), root, off, np.concatenate(sets), side)

        def parts(edges):
            up = {("r", r): ("r", r) for r in root.tolist()}

            def find(x):
                while up[x] != x:
                    x = up[x]
                return x

            at = dict(zip(sid.tolist(), root.tolist()))
            for a, b in edges:
                up[find(("r", at[a]))] = find(("r", at[b]))
            return [find(("r", r)) for r in root.tolist()], len({find(x) for x in up})

        all_pairs = []
        for a in range(m):
            for b in range(a):
                if 7 * len(np.intersect1d(sets[a], sets[b])) >= 3 * (n[a] + n[b]) and (not side.any() or side.all() or side[a] != side[b]):
                    all_pairs.append((int(sid[a]), int(sid[b])))
        assert set(links) <= {x for a, b in all_pairs for x in ((a, b), (b, a))}
        got, want = parts(links), parts(all_pairs)
        assert got[1] == want[1] and len(links) == len(set(root.tolist())) - got[1]
        assert len(set(zip(map(str, got[0]), map(str, want[0])))) == got[1]


def test_long_list_of_unlinked_sets_with_some_near_copies(spark, make, monkeypatch):
    """A passage that all texts hold makes lists of all sets; few sets in them are similar, and tasks hold small blocks."""
    monkeypatch.setattr(J, "LIST_BLOCK", 100)
    rng = np.random.default_rng(11)
    word = lambda: f"v{rng.integers(0, 10**6)}"
    passage = [word() for _ in range(22)]
    texts = []
    for k in range(900):
        base = passage + [word() for _ in range(int(rng.integers(28, 40)))]
        texts.append(" ".join(base))
        if k % 90 == 0:
            texts.append(" ".join(base[:-1] + [word()]))
    want, _ = brute(texts)
    got = J.jaccard_components(make(texts).repartition(4), sketch_bits=4).toPandas().set_index("doc_id").sort_index()
    assert got.component_id.tolist() == want and len(set(want)) == 900


@pytest.mark.parametrize("one_task", [0, 20_000])
def test_connected_components(spark, one_task):
    rng = np.random.default_rng(6)
    edges = [(i, i + 1) for i in range(100, 160)] + [(200, k) for k in range(201, 260)] + [tuple(map(int, rng.integers(300, 500, 2))) for _ in range(90)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long").repartition(4), one_task=one_task).collect()}
    assert got == {x: find(x) for x in root if any(x in e and e[0] != e[1] for e in edges)}


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect()}
    kept, now = [], docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        now = stage(spark, now, SF_SMALL).persist()
        assert now.columns == docs.columns, name
        kept.append({r.doc_id: r.text for r in now.collect()})
    texts = {r.doc_id: r.text for r in docs.collect()}
    good, single, clean, bare = kept
    sure = [i for i, q in labels.items() if q == 1]
    assert sum(i in good for i in sure) >= 0.95 * len(sure)
    assert sum(i in good for i, q in labels.items() if q == 0) <= 0.3 * sum(q == 0 for q in labels.values())
    ids = sorted(good)
    root, _ = brute([good[i] for i in ids])
    assert set(single) == {ids[i] for i in set(root)}
    items = [set(shingles(r.text)) for r in spark.read.parquet(f"{SF_SMALL}/benchmark.parquet").collect()]
    share = lambda t: max(len(s & shingles(t)) / len(s) for s in items)
    assert all(share(t) < 0.9 for t in clean.values()) and all(share(single[i]) > 0.5 for i in set(single) - set(clean))
    assert set(bare) == set(clean) and all("token = " not in t or "[SECRET]" in t for t in bare.values())
    assert all(bare[i] == texts[i] for i in bare if "[SECRET]" not in bare[i])
    packed = corpus_pipeline.STAGES[-1][1](spark, now, SF_SMALL).toPandas()
    assert set(packed.doc_id) == set(bare) and packed.groupby("sequence_id").length.sum().max() <= SIZE
    assert corpus_pipeline.run(spark, SF_SMALL).count() == len(packed)
