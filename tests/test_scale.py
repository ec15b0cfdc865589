"""What plans read, sort and shuffle: figures that grow faster than the texts came from these."""
import re

from pyspark.sql import functions as F

from subseg.config import LATIN
from subseg.operators.context import sentence_chunks
from subseg.operators.decode import decode_chars, explode_chars
from subseg.operators.features import char_features, feature_value_frames
from subseg.operators.planted import planted_seg
from subseg.operators.silver import with_silver
from subseg.operators.treebank import format_predictions, silver_treebank
from subseg.plans import fixture as fx
from subseg.plans.segmenter import training_contexts


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _nodes(df, name: str) -> int:
    return len(re.findall(rf"(?m)^[ :+*()\d-]*{name}\b", _plan(df)))


def _tables(spark, tmp_path) -> str:
    rows = [(1, "en", "redo walking . un . . on"), (2, "de", " ".join(f"w{k}ing" for k in range(230)) + " . end"), (3, "en", ""), (4, None, None), (None, "fr", "a . b")]
    spark.createDataFrame(rows, "doc_id long, lang string, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    return str(tmp_path)


def test_texts_not_words_are_dealt_to_tasks_and_nothing_is_kept(spark, tmp_path):
    words = fx.words(spark, _tables(spark, tmp_path))
    assert "InMemoryTableScan" not in _plan(words)
    assert words.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))  # the file has one row group
    assert words.count() == 7 + 232 + 3


def test_checksum_holds_sums_beyond_a_long(spark):
    one = spark.range(1).select(F.lit((1 << 32) - 1).cast("long").alias("u"))
    many = one.crossJoin(spark.range(1000))
    got = many.agg(fx._words32_sum(F.col("u")).alias("a"), fx.mod_sum(F.col("u")).alias("b")).first()
    assert got["a"] == got["b"] == 1000 * ((1 << 32) - 1)
    assert "decimal" not in _plan(many.agg(fx._words32_sum(F.col("u")))).split("HashAggregate")[-1]  # none a row


def test_a_document_is_sorted_once_for_its_sentences_and_lines(spark, tmp_path):
    words = fx.words(spark, _tables(spark, tmp_path), by="doc_id")
    conllu = silver_treebank(with_silver(words), LATIN)
    assert (_nodes(sentence_chunks(words), "Sort"), _nodes(sentence_chunks(words), "Exchange")) == (1, 1)
    assert (_nodes(conllu, "Sort"), _nodes(conllu, "Exchange")) == (1, 1)
    got = [(r.sent_dots, r.sent_chunk, r.n) for r in sentence_chunks(words).filter("doc_id = 2").groupBy("sent_dots", "sent_chunk").agg(F.count("*").alias("n"))
           .orderBy("sent_dots", "sent_chunk").collect()]
    assert got == [(0, 0, 101), (0, 1, 101), (0, 2, 29), (1, 0, 1)]
    ids = [(r.line_no, r.id, r.form) for r in conllu.filter("sent_id = '1-0-0'").orderBy("line_no").collect()]
    assert ids == [(0, "1", "redo"), (1, "2-3", "walking"), (2, "2", "walk"), (3, "3", "ing"), (4, "4", ".")]
    starts = conllu.filter("line_no = 0").select("sent_id").distinct().count()
    assert starts == conllu.select("sent_id").distinct().count()


def test_a_row_a_word_is_shuffled_when_characters_are_decoded(spark):
    long = "ab" * 100
    words = spark.createDataFrame([(1, "abc"), (2, long), (3, "x"), (None, "abc"), (5, "no"), (5, "no")], "k long, word string")
    chars = explode_chars(words, ["k"]).withColumn("p", F.when(F.col("idx") % 2 == 1, 0.9).otherwise(0.2))
    out = decode_chars(chars, ["k"], LATIN.with_(allowed=None), sep="#")
    assert "partial_collect_list(struct(i" not in _plan(out) and "partial_bit_or" in _plan(out)
    got = {(r.k, r.word): (r.seg, r.min_boundary_p) for r in out.collect()}
    assert got == {(1, "abc"): ("ab#c", 0.2), (2, long): ("#".join(["ab"] * 100), 0.2), (3, "x"): ("x", 0.2), (None, "abc"): ("ab#c", 0.2),
                   (5, "no"): ("nnoo", 0.2)}  # a key's word twice: each character twice, as ever


def test_only_what_is_asked_for_is_looked_up(spark, tmp_path):
    sf = _tables(spark, tmp_path)
    words, lex, fq = fx.words(spark, sf), fx.lexicon(spark, sf), fx.freqs(spark, sf)
    frame = lambda only: char_features(words, lex, fq, LATIN, keep=("doc_id", "pos"), only=only)
    joins = lambda df: _nodes(df, "(?:SortMergeJoin|BroadcastHashJoin|ShuffledHashJoin)")
    assert joins(frame(["prev_grp_first", "next_grp_len"])) == 1  # types to tokens
    assert joins(frame(["prev_grp_pos"])) == 2
    assert joins(frame(["freq_ratio"])) + 2 == joins(frame(["freq_ratio", "prev_grp_pos", "next_grp_pos"]))
    all_cols = ["prev_grp_pos", "next_grp_pos", "prev_grp_first", "next_grp_last"]
    _, near = feature_value_frames(words, lex, fq, LATIN)
    full = frame(None)
    for c in all_cols:
        values = lambda df, c=c: {r[0] for r in df.select(c).distinct().collect()} - {"_"}
        assert values(near) == values(full), c
    assert near.count() < words.count() * 2


def test_several_formats_come_from_one_pass(spark):
    preds = spark.createDataFrame([("s", 1, "w", "O", "0.123456", "O", "N"), ("s", 2, "v", "B", "1", "O", "V")],
                                  "sent_id string, tid int, word string, pred string, score string, true string, pos string")
    both = format_predictions(preds, ("conllu", "xg", "diff"))
    assert "Union" not in _plan(both)
    for fmt in ("conllu", "xg", "diff"):
        assert sorted(map(tuple, both.filter(F.col("fmt") == fmt).drop("fmt").collect())) == sorted(map(tuple, format_predictions(preds, fmt).collect()))


def test_the_check_of_training_rows_makes_a_segmentation_once(spark):
    rows = spark.createDataFrame([(1, "abcde", "_", "_"), (2, "|", "_", "_"), (3, "a|b", "_", "_"), (4, "x", "_", "_")], "k long, word string, prev_word string, next_word string")
    good, bad = training_contexts(rows.withColumn("seg", planted_seg(F.col("word"))), ["k"], 0.1)
    assert _plan(good).count("^[0-9]+$") == _plan(bad).count("^[0-9]+$") == 1
    assert sorted(r.k for r in good.collect()) == [1, 2, 4] and [r.k for r in bad.collect()] == [3]


def test_silver_rule_is_one_expression_a_word(spark):
    """The rule names the word a few times, not once a pair of affixes, and cuts what it did."""
    from subseg.operators.decode import segments_long
    from subseg.operators.silver import silver_seg
    cases = {"reding": "red|ing", "retelling": "re|tell|ing", "unable": "un|able", "Nation": "Nation", "CREATION": "CREA|TION", "inly": "inly",
             "reed": "reed", "end.": "end|.", "a,b": "a,b", "|": "|", "re|turned": "re|turned", "reKing": "reK|ing", "unwary!": "unwary|!"}
    df = spark.createDataFrame(list(cases.items()), "word string, want string")
    got = {r["word"]: r["seg"] for r in df.select("word", silver_seg(F.col("word")).alias("seg")).collect()}
    assert got == cases
    rule = df.select("word", silver_seg(F.col("word")).alias("seg"))
    plan = rule._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("word#") < 25
    # pieces are made once: no filter that cuts the segmentation before it is exploded
    long = segments_long(rule, ["word"])._jdf.queryExecution().optimizedPlan().toString()
    assert long.count("regexp_replace") == plan.count("regexp_replace")


def test_sentences_named_with_their_document_are_not_shuffled(spark, tmp_path):
    """Words are dealt by document; units, folds and texts of its sentences need no exchange of lines."""
    from subseg.plans import treebank_queries as tq
    sf = _tables(spark, tmp_path)
    for q in (tq.q_superpos, tq.q_pred_formats, tq.q_treebank_segs, tq.q_affix_labels, tq.q_unit_ranges):
        assert "hashpartitioning(sent_id" not in _plan(q(spark, sf))
    assert sum(r["n"] for r in tq.q_superpos(spark, sf).collect()) >= 7 + 232 + 3


def test_training_counts_make_the_segmentation_once(spark):
    """no filter on the exploded pieces that makes them again."""
    from subseg.operators.lexicon import train_freqs
    df = spark.createDataFrame([("redoing",), ("un",), (None,)], "word string")
    counts = train_freqs(with_silver(df))
    assert "size(" not in counts._jdf.queryExecution().optimizedPlan().toString()
    assert {r["word"]: r["n"] for r in counts.collect()} == {"redoing": 1, "redo": 1, "ing": 1, "un": 2}


def test_a_result_read_once_is_not_kept(spark, tmp_path):
    """the query's rows come from the shuffle that makes them, not from blocks kept on the way."""
    from subseg.plans import catalog
    sf = _tables(spark, tmp_path)
    tags, freqs = catalog.q_lexicon_tags(spark, sf), catalog.q_freq_norm(spark, sf)
    for df in (tags, freqs):
        assert "InMemoryTableScan" not in _plan(df) and not df.is_cached
    got = {r.word: r.tags for r in tags.collect()}
    assert (got["un"], got["."], got["a"]) == ("GER", "GER|ROM", "ROM")
    counts = {r.word: (r.cnt, r.freq) for r in freqs.collect()}
    assert counts["."] == (5, 5 / 242) and counts["redo"] == (1, 1 / 242) and len(counts) == len(got)
