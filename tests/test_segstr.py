"""Segmentation-string functions on hand rows and random strings."""
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from subseg.functions.segstr import aligned, bits_to_seg, boundary_bits, malformed, segments


def py_bits(seg: str) -> str:
    if seg == "|":
        return "0"
    out, parts = [], seg.split("|")
    for p in parts:
        out.extend(["0"] * len(p))
        if out:
            out[-1] = "1"
    out[-1] = "0"
    return "".join(out)


CASES = [("abc", "a|bc"), ("abc", "abc"), ("a", "a"), ("|", "|"), ("a😀b", "a😀|b"), ("reading", "re|ad|ing")]


def test_bits_and_back(spark):
    df = spark.createDataFrame(CASES, "word string, seg string")
    rows = df.select("word", "seg", boundary_bits(F.col("seg")).alias("bits")).withColumn(
        "back", bits_to_seg(F.col("word"), F.col("bits"))).collect()
    for r in rows:
        assert r.bits == py_bits(r.seg), r
        assert len(r.bits) == len(r.word)
        assert r.back == r.seg


def test_segments_keep_pipe_word(spark):
    df = spark.createDataFrame([("|",), ("a|b",)], "seg string")
    got = [r[0] for r in df.select(segments(F.col("seg"))).collect()]
    assert got == [["|"], ["a", "b"]]


def test_alignment_and_malformed(spark):
    rows = [("abc", "a|bc", True), ("abc", "ab", False), ("|", "|", True), ("|", "a", False),
            ("ab", "|ab", False), ("ab", "ab|", False), ("abc", "a||bc", False)]
    df = spark.createDataFrame(rows, "word string, seg string, ok boolean")
    for r in df.select("ok", aligned(F.col("word"), F.col("seg")).alias("got"), malformed(F.col("seg")).alias("m")).collect():
        assert r.ok == r.got, r


@settings(max_examples=1, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcé😀"), min_size=1, max_size=4).map("".join), min_size=1, max_size=5))
def test_roundtrip_property(spark, segs):
    seg = "|".join(segs)
    word = seg.replace("|", "")
    r = spark.createDataFrame([(word, seg)], "word string, seg string").select(
        boundary_bits(F.col("seg")).alias("b"), bits_to_seg(F.col("word"), boundary_bits(F.col("seg"))).alias("s")).first()
    assert r.b == py_bits(seg)
    assert r.s == seg
