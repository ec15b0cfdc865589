"""Decode with positional and regex rules against a direct rendering."""
import re

from pyspark.sql import functions as F

from subseg.config import HEB, LATIN, java_replacement
from subseg.operators.decode import decode_chars, explode_chars, rule_rows, segment_with


def py_decode(word, probs, allowed, sep="|"):
    out, L = "", len(word)
    for i, ch in enumerate(word):
        out += ch
        if probs[i] > 0.5 and i < L - 1:
            if allowed is not None:
                ok = (i in allowed and ch in allowed[i]) or (-(L - i - 1) in allowed and word[i + 1] in allowed[-(L - i - 1)])
                if not ok:
                    continue
            out += sep
    return out


def test_decode_allowed(spark):
    words = [("reading", [0.9, 0.9, 0.1, 0.7, 0.1, 0.2, 0.9]), ("unlikely", [0.6] * 8), ("tion", [0.9] * 4),
             ("ed", [0.99, 0.99])]
    rows = [(k, w, i, p) for k, (w, ps) in enumerate(words) for i, p in enumerate(ps)]
    chars = spark.createDataFrame(rows, "pos int, word string, idx int, p double")
    got = {r.pos: (r.seg, r.min_boundary_p) for r in decode_chars(chars, ["pos"], LATIN).collect()}
    for k, (w, ps) in enumerate(words):
        assert got[k][0] == py_decode(w, ps, LATIN.allowed)
        assert got[k][1] == min(1.0, min(ps))
    none = {r.pos: r.seg for r in decode_chars(chars, ["pos"], LATIN.with_(allowed=None), sep="\n").collect()}
    assert none[0] == py_decode("reading", words[0][1], None, "\n")
    empty = {r.pos: r.seg for r in decode_chars(chars, ["pos"], LATIN.with_(allowed={})).collect()}
    assert all("|" not in s for s in empty.values())


def test_regex_rules_hebrew(spark):
    words = ["abc12", "ב-2020", "וה-10$", "שכ-5", "בtest", "ה", "בית"]
    df = spark.createDataFrame([(k, w) for k, w in enumerate(words)], "pos int, word string")
    got = {r.pos: r.seg for r in rule_rows(df, ["pos"], HEB).collect()}
    for k, w in enumerate(words):
        pats = [(re.compile(p), r) for p, r in HEB.regex_tok]
        if len(w) == 1 or any(p.match(w) for p, _ in pats):
            exp = w
            if len(w) > 1:
                for p, r in pats:
                    exp = p.sub(r, exp)
            assert got[k] == exp, (w, got[k], exp)
        else:
            assert k not in got


def test_java_replacement():
    assert java_replacement(r"\1|\2") == "$1|$2"
    assert java_replacement("a$b") == "a\\$b"


def test_segment_with_unions_rule_and_model_rows(spark):
    df = spark.createDataFrame([(0, "reading,"), (1, "reading"), (2, "x")], "pos int, word string")
    out = {r.pos: r.seg for r in segment_with(df, ["pos"], LATIN, lambda c: c.withColumn(
        "p", F.when(F.col("idx").isin(1, 3), 0.9).otherwise(0.1))).collect()}
    assert out == {0: "reading|,", 1: "re|ad|ing", 2: "x"}


def test_restrict_positions_keeps_full_context(spark):
    from subseg.operators.context import restrict_positions
    from subseg.sources.corpus import words_with_context
    docs = spark.createDataFrame([(1, "a bb ccc dddd")], "doc_id long, text string")
    w = words_with_context(docs, "doc_id")
    pos = spark.createDataFrame([(1, 2)], "doc_id long, pos int")
    r = restrict_positions(w, pos, ["doc_id", "pos"]).collect()
    assert [(x.word, x.prev_word, x.next_word) for x in r] == [("ccc", "bb", "dddd")]


def test_a_frequent_word_is_decoded_once_and_a_rare_one_in_its_row(spark):
    """the same rows whichever words count as frequent; words are neither shuffled nor read once for each kind."""
    from subseg.operators.decode import decode_words, model_rows, pseudo_proba_array, segment_frequent, segment_with
    words = ["reading", "reading", "end.", "x", "12", "", "a|b", "|", "ab" * 40 + "tion", "unlikely", "unlikely", "école", None]
    df = spark.createDataFrame([(k % 9, w) for k, w in enumerate(words)] + [(None, "reading")], "k long, word string").repartition(3, "k")
    plain = decode_words(model_rows(df, LATIN), ["k"], LATIN, pseudo_proba_array(F.col("word")), "#").unionByName(rule_rows(df, ["k"], LATIN, "#"))
    want = sorted(map(str, plain.collect()))
    assert len(want) == len(words)  # all but the null word, and the one of a null key
    for one_in in (0, 8, 2_000_000):
        assert sorted(map(str, segment_frequent(df, ["k"], LATIN, pseudo_proba_array, "#", one_in).collect())) == want
    out = segment_with(df, ["k"], LATIN, sep="#", proba_array_fn=pseudo_proba_array)
    assert out.columns == ["k", "word", "seg", "min_boundary_p"] and sorted(map(str, out.collect())) == want
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.startswith("Project") and "Join LeftOuter" in plan  # no union of two readings of the words
