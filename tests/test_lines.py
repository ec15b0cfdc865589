"""Ordered lines over byte ranges against Python's own reading; text sinks; exact k-th rows."""
import glob
import os
import random
import tempfile

import pytest
from pyspark.sql import functions as F

from subseg.operators.context import holdout_kth
from subseg.operators.numbering import number_in_groups, number_rows
from subseg.sources.corpus import words_from_input, words_from_lines
from subseg.sources.lines import ordered_lines
from subseg.sources.sinks import write_lines, write_segmented
from subseg.sources.tables import read_seg_table


@pytest.fixture
def small_ranges(spark):
    """Ranges of a few bytes: every file is cut many times."""
    conf = {"spark.sql.files.maxPartitionBytes": "64", "spark.sql.files.openCostInBytes": "1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield
    for k in conf:
        spark.conf.unset(k)


def want(text):
    ws = text.replace("\r", "").strip().split("\n")
    return [(k, w, ws[k - 1] if k else None, ws[k + 1] if k + 1 < len(ws) else None) for k, w in enumerate(ws)]


def put(texts):
    d = tempfile.mkdtemp(prefix="subseg-lines-")
    paths = []
    for k, t in enumerate(texts):
        paths.append(os.path.join(d, f"f{k:02d}.txt"))
        with open(paths[-1], "w", encoding="utf8", newline="") as f:
            f.write(t)
    return d, paths


def test_lines_of_cut_files_equal_whole_reading(spark, small_ranges):
    rnd = random.Random(5)
    def line():
        return rnd.choice(["", " ", "é漢", "x" * rnd.randint(1, 200), "a\tb", f" w{rnd.randint(0, 9)} ", "a\rb"])
    texts = [rnd.choice(["\n", "\r\n"]).join(line() for _ in range(rnd.randint(1, 60))) + rnd.choice(["", "\n", "\n\n \n"]) for _ in range(8)]
    texts += ["one", "\n\n\t x\ny \n", "a\n\n\nb", "z\n" * 500]
    d, paths = put([t for t in texts if t.strip()])
    got = {}
    for r in ordered_lines(spark, d).collect():
        got.setdefault(os.path.basename(r.file), []).append((r.pos, r.value, r.prev, r.next))
    for p in paths:
        with open(p, encoding="utf8", newline="") as f:
            assert sorted(got[os.path.basename(p)]) == want(f.read()), p
    assert ordered_lines(spark, paths[-1]).rdd.getNumPartitions() > 5


def test_blank_files_have_no_lines(spark):
    d, _ = put(["", " \n\t\n"])
    assert ordered_lines(spark, d).count() == 0


def test_seg_tables_mixed_layouts_and_bad_rows(spark, small_ranges):
    d, paths = put(["ab\ta|b\ncd\tcd\n" * 20, "_\tcd\tab\ta|b\tmore\nx\t_\tcd\tc|d\n"])
    two = read_seg_table(spark, paths[0]).orderBy("pos").collect()
    assert [tuple(r)[1:] for r in two[:2]] == [(0, "_", "cd", "ab", "a|b"), (1, "ab", "ab", "cd", "cd")] and two[-1].next_word == "_" and len(two) == 40
    four = {r.pos: tuple(r)[2:] for r in read_seg_table(spark, d).filter(F.col("file").endswith("f01.txt")).collect()}
    assert four == {0: ("_", "cd", "ab", "a|b"), 1: ("x", "_", "cd", "c|d")}
    _, bad = put(["ab\ta|b\nnotab\n"])
    with pytest.raises(ValueError, match="1 rows"):
        read_seg_table(spark, bad[0])


def test_text_parts_in_order_are_the_text_and_read_back(spark, small_ranges):
    rnd = random.Random(2)
    rows = [(d, p, rnd.choice(["a", "bb", "ccc"]) + str(p)) for d in range(30) for p in range(rnd.randint(1, 40))]
    shuffled = rows[:]
    rnd.shuffle(shuffled)
    df = spark.createDataFrame(shuffled, "doc_id long, pos int, seg string").repartition(7)
    path = tempfile.mkdtemp(prefix="subseg-sink-") + "/out"
    write_lines(df, path, ["doc_id", "pos"], F.col("seg"))
    parts = sorted(glob.glob(path + "/part-*"))
    assert len(parts) > 1 and "".join(open(p).read() for p in parts).split() == [r[2] for r in rows]
    back = words_from_lines(spark, path, one_document=True).orderBy("pos").collect()
    assert [r.word for r in back] == [r[2] for r in rows]
    assert [r.prev_word for r in back][1:] == [r[2] for r in rows][:-1] and back[-1].next_word == "_"
    by = tempfile.mkdtemp(prefix="subseg-sink-") + "/out"
    write_segmented(df.withColumn("half", F.col("doc_id") % 2), by, ["doc_id", "pos"], "text", ["half"])
    for h in (0, 1):
        got = "".join(open(p).read() for p in sorted(glob.glob(f"{by}/half={h}/part-*"))).split()
        assert got == [r[2] for r in rows if r[0] % 2 == h]


def test_string_input(spark):
    df = spark.createDataFrame([(1, "one word"), (2, " a b\nc ")], "id int, text string")
    got = sorted((r.id, r.pos, r.word, r.prev_word, r.next_word) for r in words_from_input(df, "id").collect())
    assert got == [(1, 0, "one word", "_", "_"), (2, 0, "a", "_", "b"), (2, 1, "b", "a", "c"), (2, 2, "c", "b", "_")]


def test_numbers_follow_the_order_whatever_the_partitions(spark):
    rows = [(k * 7 % 1000, k % 3) for k in range(1000)]
    df = spark.createDataFrame(rows, "k int, g int").repartition(9)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert all(r.k == r.row_no for r in number_rows(df, ["k"]).collect())
        got = sorted((r.g, r.k, r.row_no) for r in number_in_groups(df, ["g"], ["k"]).collect())
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r[2] for r in got] == [sum(1 for o in got if o[0] == r[0] and o[1] < r[1]) for r in got]
    assert number_rows(df.limit(0), ["k"]).count() == 0


@pytest.mark.parametrize("prop,k", [(0.1, 10), (0.3, 3), (0.0, 0)])
def test_every_kth_row_exactly(spark, prop, k):
    df = spark.range(97).withColumn("word", F.lit("x")).repartition(5)
    test = sorted(r.id for r in holdout_kth(df, ["id"], prop).filter("is_test = 1").collect())
    assert test == ([i for i in range(97) if (i + 1) % k == 0] if k else [])


def test_folders_are_read_at_once(spark, tmp_path):
    """Each folder is a text of its own, whatever its files: one read for all, none per folder."""
    from subseg.sources.lines import ordered_lines
    from subseg.sources.sinks import write_lines
    rows = [(lang, d, p, f"{lang}{d}.{p}") for lang in ("de", "01", None) for d in range(30) for p in range(3)]
    df = spark.createDataFrame(rows, "lang string, doc_id long, pos int, line string").repartitionByRange(5, "doc_id")
    path = str(tmp_path / "t")
    write_lines(df, path, ["lang", "doc_id", "pos"], F.col("line"), ["lang"], placed=True)
    got = ordered_lines(spark, path, folders=("lang",)).collect()
    for lang in ("de", "01", None):
        want = [r[3] if lang else f"None{r[1]}.{r[2]}" for r in rows if r[0] == lang]
        have = sorted((r for r in got if r["lang"] == lang), key=lambda r: r["pos"])
        assert [r["value"] for r in have] == want and [r["pos"] for r in have] == list(range(90))
        assert [r["prev"] for r in have] == [None, *want[:-1]] and [r["next"] for r in have] == [*want[1:], None]
    read = ordered_lines(spark, path, folders=("lang",))._jdf.queryExecution().optimizedPlan().toString()
    assert read.count("Relation [") == 2
