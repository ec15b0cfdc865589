"""Readers and writers on the shipped reference data files and small temp files."""
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from conftest import ref_dirs
from subseg.config import HEB
from subseg.functions.rules import rare_tag
from subseg.operators import treebank as tb
from subseg.operators.lexicon import lexicon_tags, normalise_freqs
from subseg.sources.corpus import words_from_lines
from subseg.sources.tables import read_freqs, read_lexicon, read_seg_table

DATA = ref_dirs("data")
needs_ref = pytest.mark.skipif(not DATA, reason="reference data not available")


def _files(pattern):
    import glob
    return sorted(f for d in DATA for f in glob.glob(os.path.join(d, pattern)))


@needs_ref
def test_freq_file_duplicates(spark):
    # the frequency file with duplicated words: 14,883 rows, 1,015 words repeated
    found = 0
    for path in _files("*.frq"):
        fr = read_freqs(spark, path)
        if fr.count() != 14883:
            continue
        found += 1
        assert fr.agg(F.sum("cnt")).first()[0] == 69790569
        assert fr.groupBy("word").count().filter("count > 1").count() == 1015
        summed = normalise_freqs(fr)
        assert summed.count() == fr.select("word").distinct().count()
        assert abs(summed.agg(F.sum("freq")).first()[0] - 1.0) < 1e-9
    assert found == 1


@needs_ref
def test_seg_tables_align(spark):
    # every two-column gold table: context from file order, seg spells the word
    for path in [f for f in _files("*.tab") if not f.endswith("_plain.tab")]:
        t = read_seg_table(spark, path)
        mis = t.filter((F.col("word") != "|") & (F.col("word") != F.regexp_replace("seg", r"\|", "")))
        # a few rows in the data spell the segmentation with other letters of equal length
        assert mis.count() <= 0.005 * t.count(), path
        first = t.filter("pos = 0").first()
        assert first.prev_word == "_"
        second = t.filter("pos = 1").first()
        assert second.prev_word == first.word and first.next_word == second.word


def test_lexicon_and_lines_and_conllu(spark):
    d = tempfile.mkdtemp(prefix="subseg-src-")
    lex = os.path.join(d, "x.lex")
    with open(lex, "w", encoding="utf8") as f:
        f.write("ab\tN\tlemma\nab\tV\ncd\tN\nnotab\n")
    tags = {r.word: r.tags for r in lexicon_tags(read_lexicon(spark, lex), HEB).collect()}
    assert tags == {"ab": "N|V", "cd": "N"}
    lines = os.path.join(d, "in.txt")
    with open(lines, "w", encoding="utf8") as f:
        f.write("a\n\nb\n")
    w = words_from_lines(spark, lines).orderBy("pos").collect()
    assert [(r.word, r.prev_word, r.next_word) for r in w] == [("a", "_", "_"), ("", "a", "b"), ("b", "_", "_")]
    cu = os.path.join(d, "t_dev.conllu")
    with open(cu, "w", encoding="utf8") as f:
        f.write("# s1\n1-2\tובית\t_\t_\t_\t_\t_\t_\t_\t_\n1\tו\t_\tCCONJ\tCC\t_\t_\t_\t_\t_\n"
                "2\tבית\t_\tNOUN\tN\t_\t_\t_\t_\t_\n3\tגדול\t_\tADJ\tA\t_\t_\t_\t_\t_\n\n"
                "1\tזה\t_\tPRON\tP\t_\t_\t_\t_\t_\n\n")
    c = tb.read_conllu(spark, cu)
    assert c.count() == 5
    segs = tb.seg_table(c).orderBy("sent_id", "first_line").collect()
    assert [(r.word, r.seg) for r in segs] == [("ובית", "ו|בית"), ("גדול", "גדול"), ("זה", "זה")]
    assert tb.split_by_file(c).select("split").distinct().first()[0] == "dev"


def test_rare_tag(spark):
    df = spark.createDataFrame([("WBB",), ("QQ",)], "t string")
    assert [r[0] for r in df.select(rare_tag(F.col("t"), ["WBB"], "X")).collect()] == ["WBB", "X"]
