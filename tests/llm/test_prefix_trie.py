"""Prefix tries by Euler tour against a trie of dictionaries."""
import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from subseg.llm import prefix_trie as T

SCHEMA = "conv_id long, turn long, role string, text string, pos int, depth string, len double"


def brute(rows):
    own = defaultdict(list)
    digest = lambda r, x: hashlib.md5(f"{len(r)}:{r}{x}".encode()).hexdigest()
    clean = [(c, t, r or "", x or "") for c, t, r, x in rows if c is not None]
    for c, t, r, x in sorted(clean, key=lambda r: (r[0], r[1] is not None, r[1] or 0, digest(r[2], r[3]))):
        own[c].append((r, x))
    members, ends = defaultdict(list), defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 6
        seq = own.get(c - int(np.fmod(c, 100)), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    kids = defaultdict(list)
    for p in members:
        if p:
            kids[p[:-1]].append(p)
    total = {}
    for p in sorted(members, key=len, reverse=True):
        below = [total[k] for k in kids[p]]
        chars = len(p[-1][1]) if p else 0
        total[p] = (sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[p]) - 1) * chars)
    return {
        (members[p][0], len(p), members[p[:-1]][0] if p else None, len(m), len(kids[p]), *total[p], hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, m in members.items()
    }


def trie(spark, rows, **kw):
    df = spark.createDataFrame([(*r, 1, "x", 0.5) for r in rows], SCHEMA)
    got = [tuple(r) for r in T.prefix_trie(*T.grafted(T.turn_table(df)), **kw).collect()]
    assert len(got) == len(set(got))
    return set(got)


def some_rows(seed, n=150):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(420), n) + [0, 100]:
        hot = rnd.random() < 0.3
        for t in range(3 if hot else rnd.randint(1, 9)):
            rows.append((c, t, "user" if t % 2 == 0 else "assistant", "same" if hot or rnd.random() < 0.5 else f"t{rnd.randint(0, 3)}"))
    return rows


@pytest.mark.parametrize("one_task", [T.ONE_TASK_CHAINS, 0])
def test_equals_dictionaries(spark, one_task):
    rows = some_rows(1)
    assert trie(spark, rows, one_task=one_task) == brute(rows)


def test_odd_rows(spark):
    rows = some_rows(2, 30)
    rows += rows[:5]
    rows += [(None, 1, "user", "x"), (7, None, "user", "first"), (7, None, "user", "a tie"), (8, 1, None, None), (9, 1, "", ""), (-5, 0, "user", "é漢\U0001f600"),
             (201, 0, "u", "ser"), (202, 0, "us", "er"), (203, 1, "user", "y" * 100_000)]
    assert trie(spark, rows) == brute(rows)


def test_one_conversation_over_many_tasks(spark):
    """A long conversation is split by range; its prefix hashes and its chains cross the tasks."""
    rows = [(c, t, "u", f"t{t}") for c in (100, 113) for t in range(400)] + [(5, 0, "u", "x")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert trie(spark, rows) == brute(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_many_members_end_in_chunks(spark, monkeypatch):
    monkeypatch.setattr(T, "CHUNK_BYTES", 100)
    rows = [(c, 0, "u", "x") for c in range(300)]
    assert trie(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert trie(spark, []) == set()


def test_doubling_ranks_any_lists():
    rng = np.random.default_rng(4)
    order = rng.permutation(500)
    succ = np.full(500, -1)
    for lo, hi in ((0, 1), (1, 200), (200, 500)):
        succ[order[lo : hi - 1]] = order[lo + 1 : hi]
    w = rng.integers(0, 9, 500)
    head, (sums,) = T.double_up(succ, [w])
    for lo, hi in ((0, 1), (1, 200), (200, 500)):
        assert (head[order[lo:hi]] == order[lo]).all() and (sums[order[lo:hi]] == np.cumsum(w[order[lo:hi]])).all()
