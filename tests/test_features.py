"""Character features against a row-by-row rendering of the documented rules."""
from pyspark.sql import functions as F

from subseg.config import LATIN
from subseg.operators.features import CAT_COLS, NUM_COLS, char_features

LEX = {"re": "P", "read": "V", "ing": "S", "reading": "V|N", "ad": "X", "adi": "Y", "din": "Z", "g": "G",
       "eadi": "W", "readi": "Q", "the": "D", "ea": "E"}
FREQ = {"re": 0.1, "ading": 0.05, "read": 0.2, "ing": 0.3, "reading": 0.01, "r": 0.5, "eading": 0.02}
ROWS = [("reading", "the", "_"), ("the", "_", "reading"), ("a", "", "x"), ("ing", "read", "😀a"), ("😀ea", "_", "_")]


def tag(s):
    return LEX.get(s, "_")


def expected(word, prev, nxt):
    L, vow = len(word), set(LATIN.vowels)
    out = []
    for i in range(L):
        d = {"idx": i, "len_bound_group": L, "group_in_lex": tag(word), "current_letter": word[i],
             "current_vowel": int(word[i] in vow)}
        for k, name in ((1, "prev"), (2, "prev_prev")):
            d[name + "_letter"] = word[i - k] if i >= k else "_"
            d[name + "_vowel"] = int(word[i - k] in vow) if i >= k else -1
        for k, name in ((1, "next"), (2, "next_next")):
            d[name + "_letter"] = word[i + k] if i + k < L else "_"
            d[name + "_vowel"] = int(word[i + k] in vow) if i + k < L else -1
        d["so_far_pos"] = tag(word[:i + 1])
        d["remaining_pos"] = tag(word[i + 1:]) if i + 1 < L else "_"
        d["remaining_pos_mns1"] = tag(word[i:])
        d["remaining_pos_mns2"] = tag(word[max(0, i - 1):])
        for n in (1, 2, 3, 4):
            d[f"mns{n}_coarse"] = tag(word[i - n:i + 1]) if i - n >= 0 else "_"
            d[f"pls{n}_coarse"] = tag(word[i:i + n + 1]) if i + n <= L else "_"
        for nb, name in ((prev, "prev"), (nxt, "next")):
            ok = nb not in ("", "_")
            d[name + "_grp_first"] = nb[0] if ok else "_"
            d[name + "_grp_last"] = nb[-1] if ok else "_"
            d[name + "_grp_len"] = len(nb) if ok else 0
            d[name + "_grp_pos"] = tag(nb) if ok else "_"
        rem = FREQ.get(word[i + 1:], 0.0) if i + 1 < L else 0.0
        d["freq_ratio"] = FREQ.get(word[:i + 1], 0.0) * rem / (FREQ.get(word, 0.0) + 1e-10)
        out.append(d)
    return out


def test_features_match_rowwise(spark):
    rows = spark.createDataFrame([(k, *r) for k, r in enumerate(ROWS)], "pos int, word string, prev_word string, next_word string")
    lex = spark.createDataFrame(list(LEX.items()), "word string, tags string")
    fq = spark.createDataFrame(list(FREQ.items()), "word string, freq double")
    got = char_features(rows, lex, fq, LATIN, keep=("pos",)).collect()
    by_key = {(r.pos, r.idx): r.asDict() for r in got}
    n = 0
    for k, (w, p, nx) in enumerate(ROWS):
        for d in expected(w, p, nx):
            g = by_key[(k, d["idx"])]
            for c in CAT_COLS + NUM_COLS:
                if c == "freq_ratio":
                    assert abs(g[c] - d[c]) <= 1e-12 * max(1.0, abs(d[c])), (w, d["idx"], c)
                else:
                    assert g[c] == d[c], (w, d["idx"], c, g[c], d[c])
            n += 1
    assert n == len(got) == sum(len(w) for w, _, _ in ROWS)


def test_features_partition_invariant(spark):
    from conftest import SF_SMALL
    from subseg.plans import catalog
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    a = sorted(catalog.q_lexicon_feats(spark, SF_SMALL).collect())
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    b = sorted(catalog.q_lexicon_feats(spark, SF_SMALL).collect())
    assert a == b
