"""Registered queries (Spark) and their DuckDB oracle SQL.

Every query reads whole driver tables and returns a small result: either
row-level output where that is small, or per-group counts plus an
order-insensitive checksum (Σ of the first 32 md5 bits of each tab-joined
row), so that every input row influences the compared values.  Doubles are
either exact divisions (bit-identical in both engines) or reduced to
``floor(x * 1e6)`` before summing.
"""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import LATIN
from ..functions.hashing import md5_u32
from ..functions.rules import apply_regex_tok, rule_tokenised
from ..functions.segstr import aligned, bits_to_seg, boundary_bits, bit_at, segments
from ..operators import context as ctx_ops
from ..operators import decode as dec
from ..operators import evaluate as ev
from ..operators import features as fe
from ..operators import lexicon as lx
from ..operators.encode import Encoder, fit_encoders, fit_encoders_from_parts
from ..operators.seats import join_in_place
from ..operators.silver import silver_seg
from ..session import table
from ..sources.corpus import words_from_lines, words_from_turns, words_with_context
from ..sources.sinks import write_lines
from ..sources.tables import read_seg_table
from ..streaming.segment import scratch_path
from . import fixture as fx
from .fixture import checksum

CFG = LATIN


def _big(*names):
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ---------------------------------------------------------------------------
# Spark side
# ---------------------------------------------------------------------------

def q_words(spark: SparkSession, sf: str) -> DataFrame:
    w = fx.words(spark, sf)
    return w.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_words"), F.sum(F.length("word")).cast("bigint").alias("n_chars"),
        checksum("pos", "word", "prev_word", "next_word").alias("checksum"))


def q_turn_words(spark: SparkSession, sf: str) -> DataFrame:
    w = words_from_turns(table(spark, sf, "conversations"))
    return w.groupBy("conv_id").agg(
        F.count(F.lit(1)).alias("n_words"),
        checksum("turn", "pos", "word", "prev_word", "next_word").alias("checksum"))


def q_silver_segs(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.silver(spark, sf).withColumn("n_segs", F.size(segments(F.col("seg"))).cast("bigint"))
    return s.groupBy("lang", "n_segs").agg(F.count(F.lit(1)).alias("n"), checksum("doc_id", "pos", "seg").alias("checksum"))


def q_boundary_bits(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.silver(spark, sf).withColumn("bits", boundary_bits(F.col("seg")))
    ones = F.length("bits") - F.length(F.regexp_replace("bits", "1", ""))
    return s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"), F.sum(ones).cast("bigint").alias("boundaries"),
        checksum("doc_id", "pos", "bits").alias("checksum"),
        F.sum((bits_to_seg(F.col("word"), F.col("bits")) == F.col("seg")).cast("int")).cast("bigint")
        .alias("roundtrip_ok"))


def q_align_check(spark: SparkSession, sf: str) -> DataFrame:
    s = fx.silver(spark, sf).withColumn("next_seg", silver_seg(F.col("next_word")))
    return s.groupBy("lang").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(aligned(F.col("word"), F.col("seg")).cast("int")).cast("bigint").alias("own_aligned"),
        F.sum(aligned(F.col("word"), F.col("next_seg")).cast("int")).cast("bigint").alias("next_aligned"))


def q_lexicon_tags(spark: SparkSession, sf: str) -> DataFrame:
    return fx.lexicon_rows(spark, sf)


def q_lexicon_raw(spark: SparkSession, sf: str) -> DataFrame:
    lex = lx.lexicon_tags(lx.corpus_lexicon(fx.words(spark, sf)), CFG.with_(pos_classes={}))
    return lex.groupBy("tags").agg(F.count(F.lit(1)).alias("n"), checksum("word").alias("checksum"))


def q_freq_norm(spark: SparkSession, sf: str) -> DataFrame:
    return fx.freq_rows(spark, sf)


def _split_silver(spark, sf):
    return ctx_ops.holdout_split(fx.silver(spark, sf), ["doc_id", "pos"], 0.1)


def q_split_hash(spark: SparkSession, sf: str) -> DataFrame:
    s = _split_silver(spark, sf)
    return s.groupBy("lang").agg(F.sum("is_test").cast("bigint").alias("n_test"),
                                 F.sum(1 - F.col("is_test")).cast("bigint").alias("n_train"))


def q_train_freqs(spark: SparkSession, sf: str) -> DataFrame:
    return lx.train_freqs(_split_silver(spark, sf).filter("is_test = 0"))


def q_prune_lexicon(spark: SparkSession, sf: str) -> DataFrame:
    tf = lx.train_freqs(_split_silver(spark, sf).filter("is_test = 0"))
    return lx.prune_lexicon(fx.lexicon(spark, sf), tf, 0.1)


def _feats(spark, sf, seg=False, encode_with=None, only=None):
    rows = fx.silver(spark, sf, seats=True) if seg else fx.words(spark, sf, seats=True)
    return fe.char_features(rows, fx.lexicon(spark, sf), fx.freqs(spark, sf), CFG,
                            seg_col="seg" if seg else None, keep=("doc_id", "pos"), encode_with=encode_with, only=only)


LETTER_COLS = ["current_letter", "prev_prev_letter", "prev_letter", "next_letter", "next_next_letter",
               "current_vowel", "prev_prev_vowel", "prev_vowel", "next_vowel", "next_next_vowel"]
GROUP_COLS = ["prev_grp_first", "prev_grp_last", "next_grp_first", "next_grp_last", "prev_grp_len", "next_grp_len"]
LEX_COLS = ["group_in_lex", "mns4_coarse", "mns3_coarse", "mns2_coarse", "mns1_coarse", "pls1_coarse",
            "pls2_coarse", "pls3_coarse", "pls4_coarse", "so_far_pos", "remaining_pos", "prev_grp_pos",
            "next_grp_pos", "remaining_pos_mns1", "remaining_pos_mns2"]
INT_NUM_COLS = [c for c in fe.NUM_COLS if c != "freq_ratio"]


def _by_shape(df, cols, extra=()):
    return df.groupBy(F.col("len_bound_group").cast("bigint").alias("len_bound_group"),
                      F.col("idx").cast("bigint").alias("idx")).agg(
        F.count(F.lit(1)).alias("n"), checksum("doc_id", "pos", *cols).alias("checksum"), *extra)


def q_letter_feats(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, only=LETTER_COLS), LETTER_COLS)


def q_group_feats(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, only=GROUP_COLS), GROUP_COLS)


def q_lexicon_feats(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, only=LEX_COLS), LEX_COLS)


def _freq_sum():
    fr = F.col("freq_ratio")
    return [fx.mod_sum(F.floor(fr * F.lit(1e6))).alias("freq_ratio_e6"),
            F.sum((fr > 0).cast("int")).cast("bigint").alias("freq_ratio_nonzero")]


def q_freq_ratio(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, only=["freq_ratio"]), [], _freq_sum())


def q_feature_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, seg=True), fe.CAT_COLS + INT_NUM_COLS + ["label"], _freq_sum())


def _fitted_encoders(spark, sf):
    """Encoders fitted on the type-level and token-level value frames."""
    parts = fe.feature_value_frames(fx.words(spark, sf), fx.lexicon(spark, sf), fx.freqs(spark, sf), CFG)
    return fit_encoders_from_parts(*parts, fe.CAT_COLS)


def q_encoders(spark: SparkSession, sf: str) -> DataFrame:
    return _fitted_encoders(spark, sf)


def q_encoders_full(spark: SparkSession, sf: str) -> DataFrame:
    """The same dictionary fitted by unpivoting the whole character frame."""
    return fit_encoders(_feats(spark, sf, only=fe.CAT_COLS), fe.CAT_COLS)


def q_encoded_frame(spark: SparkSession, sf: str) -> DataFrame:
    return _by_shape(_feats(spark, sf, encode_with=Encoder(_fitted_encoders(spark, sf))), fe.CAT_COLS)


def q_encoded_unseen(spark: SparkSession, sf: str) -> DataFrame:
    """Dictionaries fitted on even documents, applied to odd ones: unseen values get code 0."""
    words = fx.words(spark, sf, seats=True)
    parts = fe.feature_value_frames(words.where("doc_id % 2 = 0"), fx.lexicon(spark, sf), fx.freqs(spark, sf), CFG)
    enc = Encoder(fit_encoders_from_parts(*parts, fe.CAT_COLS))
    odd = fe.char_features(words.where("doc_id % 2 = 1"), fx.lexicon(spark, sf), fx.freqs(spark, sf), CFG, keep=("doc_id", "pos"), encode_with=enc)
    return _by_shape(odd, fe.CAT_COLS)


def q_regex_rules(spark: SparkSession, sf: str) -> DataFrame:
    w = fx.words(spark, sf)
    rr = dec.rule_rows(w, ["doc_id", "pos", "lang"], CFG)
    return rr.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), checksum("doc_id", "pos", "seg").alias("checksum"))


def _pseudo(chars):
    return chars.withColumn("p", dec.pseudo_proba(F.col("word"), F.col("idx")))


def _decode_summary(segd, key):
    return segd.groupBy(key).agg(
        F.count(F.lit(1)).alias("n"), checksum("pos", "seg").alias("checksum"),
        fx.mod_sum(F.floor(F.col("min_boundary_p") * F.lit(1e6))).alias("min_p_e6"))


def q_allowed_decode(spark: SparkSession, sf: str) -> DataFrame:
    segd = dec.segment_with(fx.words(spark, sf), ["doc_id", "pos"], CFG, proba_array_fn=dec.pseudo_proba_array)
    return _decode_summary(segd, "doc_id")


def q_char_decode(spark: SparkSession, sf: str) -> DataFrame:
    """Same decode through exploded character rows and the per-word regroup (model path)."""
    segd = dec.segment_with(fx.words(spark, sf), ["doc_id", "pos"], CFG, _pseudo)
    return _decode_summary(segd, "doc_id")


def q_benchmark_decode(spark: SparkSession, sf: str) -> DataFrame:
    w = words_with_context(table(spark, sf, "benchmark"), "item_id", predict=True)
    segd = dec.segment_with(w, ["item_id", "pos"], CFG, proba_array_fn=dec.pseudo_proba_array)
    return _decode_summary(segd, "item_id")


def q_segments_long(spark: SparkSession, sf: str) -> DataFrame:
    s = dec.segments_long(fx.silver(spark, sf), ["doc_id", "pos", "lang"])
    return s.groupBy("lang", F.col("seg_idx").cast("bigint").alias("seg_idx")).agg(
        F.count(F.lit(1)).alias("n"), checksum("doc_id", "pos", "segment").alias("checksum"))


def q_sentence_chunks(spark: SparkSession, sf: str) -> DataFrame:
    s = ctx_ops.sentence_chunks(fx.words(spark, sf, by="doc_id"))
    return s.groupBy("doc_id").agg(
        F.max("sent_dots").cast("bigint").alias("max_dots"), F.max("sent_chunk").cast("bigint").alias("max_chunk"),
        checksum("pos", "sent_dots", "sent_chunk").alias("checksum"))


def _eval_inputs(spark, sf):
    join_in_place(spark)  # both sides are dealt by document
    gold = fx.silver(spark, sf, by="doc_id")
    pred = fx.silver(spark, sf, drop_suffix="ly", by="doc_id").select("doc_id", "pos", "seg")
    return gold, pred


def _eval_cols(df, group=()):
    return df.select(*group, "rows", "chars", "perfect", "tp", "fp", "fn", "errors", "precision", "recall",
                     "f_score", "perfect_ratio")


def q_eval_prf(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = _eval_inputs(spark, sf)
    return _eval_cols(ev.evaluate(gold.select("doc_id", "pos", "seg"), pred, ["doc_id", "pos"]))


def q_eval_by_lang(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = _eval_inputs(spark, sf)
    return _eval_cols(ev.evaluate(gold.select("doc_id", "pos", "seg", "lang"), pred, ["doc_id", "pos"],
                                  ("lang",)), ("lang",))


def q_eval_by_quality(spark: SparkSession, sf: str) -> DataFrame:
    gold, pred = _eval_inputs(spark, sf)
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").cast("bigint").alias("quality"))
    gold = gold.join(labels, "doc_id", "inner").select("doc_id", "pos", "seg", "quality")
    pred = pred.join(labels, "doc_id", "left_semi")  # only labelled documents are scored, on both sides
    return _eval_cols(ev.evaluate(gold, pred, ["doc_id", "pos"], ("quality",)), ("quality",))


def q_eval_errors(spark: SparkSession, sf: str) -> DataFrame:
    """Every reason a row can't be scored: the predictions have missing, surplus, malformed and repeated rows."""
    gold, pred = _eval_inputs(spark, sf)
    turn = F.pmod("pos", F.lit(37))
    base = pred.where(turn != 3)
    seg = F.when(turn == 7, F.concat(F.lit("|"), "seg")).when(turn == 11, F.concat("seg", F.lit("x"))).when(turn == 13, F.concat("seg", F.lit("||a"))) \
        .otherwise(F.col("seg"))
    bad = base.withColumn("seg", seg)
    again = base.where(turn == 5)
    extra = base.where(turn == 17).withColumn("pos", -F.col("pos") - 1)
    flags = ev.row_flags(gold.select("doc_id", "pos", "seg"), bad.unionByName(again).unionByName(extra), ["doc_id", "pos"])
    return ev.error_report(flags).select(F.coalesce("error", F.lit("scored")).alias("error"), "rows", "gold_chars", "chars")


def q_char_accuracy(spark: SparkSession, sf: str) -> DataFrame:
    chars = dec.explode_chars(fx.silver(spark, sf).select("doc_id", "pos", "word", "seg"), ["doc_id", "pos", "seg"])
    scored = chars.select(
        "idx", F.length("word").alias("len_bound_group"),
        bit_at(boundary_bits(F.col("seg")), F.col("idx")).alias("label"),
        (dec.pseudo_proba(F.col("word"), F.col("idx")) > 0.5).cast("int").alias("pred"))
    return ev.char_accuracy(scored)


def q_split_kth(spark: SparkSession, sf: str) -> DataFrame:
    """Exactly every tenth word of the corpus, by its number in the order of documents and positions."""
    rows = ctx_ops.holdout_kth(fx.words(spark, sf).select("doc_id", "pos", "word"), ["doc_id", "pos"], 0.1)
    return rows.groupBy("doc_id").agg(F.sum("is_test").cast("bigint").alias("n_test"), F.count(F.lit(1)).alias("n"),
                                      checksum("pos", "word", "is_test").alias("checksum"))


def q_ordered_lines(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus written as a word-per-line text in order (K1) and read back with its context."""
    path = scratch_path(spark, "lines")
    words = fx.words(spark, sf, by="doc_id", ranges=True)
    write_lines(words.select("doc_id", "pos", "word"), path, ["doc_id", "pos"], F.col("word"), placed=True)
    back = words_from_lines(spark, path, one_document=True)
    return back.groupBy(F.floor(F.col("pos") / 1000).cast("bigint").alias("chunk")).agg(
        F.count(F.lit(1)).alias("n"), checksum("pos", "word", "prev_word", "next_word").alias("checksum"))


def q_ordered_seg_table(spark: SparkSession, sf: str) -> DataFrame:
    """Two-column segmentation files, one folder a language, written in order and read back (K3, S3)."""
    path = scratch_path(spark, "seg-table")
    gold = fx.silver(spark, sf, by="doc_id", ranges=True).select("lang", "doc_id", "pos", F.concat_ws("\t", "word", "seg").alias("line"))
    write_lines(gold, path, ["lang", "doc_id", "pos"], F.col("line"), ["lang"], placed=True)
    out = read_seg_table(spark, path, folders=("lang",))
    return out.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), checksum("pos", "prev_word", "next_word", "word", "seg").alias("checksum"))


SPARK_QUERIES = {
    "split_kth": q_split_kth,
    "ordered_lines": q_ordered_lines,
    "ordered_seg_table": q_ordered_seg_table,
    "words": q_words,
    "turn_words": q_turn_words,
    "silver_segs": q_silver_segs,
    "boundary_bits": q_boundary_bits,
    "align_check": q_align_check,
    "lexicon_tags": q_lexicon_tags,
    "lexicon_raw": q_lexicon_raw,
    "freq_norm": q_freq_norm,
    "split_hash": q_split_hash,
    "train_freqs": q_train_freqs,
    "prune_lexicon": q_prune_lexicon,
    "letter_feats": q_letter_feats,
    "group_feats": q_group_feats,
    "lexicon_feats": q_lexicon_feats,
    "freq_ratio": q_freq_ratio,
    "feature_frame": q_feature_frame,
    "encoders": q_encoders,
    "encoders_full": q_encoders_full,
    "encoded_frame": q_encoded_frame,
    "encoded_unseen": q_encoded_unseen,
    "regex_rules": q_regex_rules,
    "allowed_decode": q_allowed_decode,
    "char_decode": q_char_decode,
    "benchmark_decode": q_benchmark_decode,
    "segments_long": q_segments_long,
    "sentence_chunks": q_sentence_chunks,
    "eval_prf": q_eval_prf,
    "eval_by_lang": q_eval_by_lang,
    "eval_by_quality": q_eval_by_quality,
    "eval_errors": q_eval_errors,
    "char_accuracy": q_char_accuracy,
}


# ---------------------------------------------------------------------------
# DuckDB oracle SQL
# ---------------------------------------------------------------------------

def md5u(x: str) -> str:
    return f"('0x' || substr(md5({x}), 1, 8))::BIGINT"


def msum(expr: str) -> str:
    return f"(sum(({expr})::HUGEINT) % 2305843009213693951)::BIGINT"


def cks(*cols: str) -> str:
    return msum(md5u("concat_ws(chr(9), " + ", ".join(cols) + ")"))


def _words_cte(src: str = "documents", key: str = "doc_id", extra: str = ", lang", name: str = "words") -> str:
    return rf"""
{name}_ws AS (
  SELECT {key}{extra}, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS ws FROM {src}),
{name}_raw AS (
  SELECT {key}{extra}, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM {name}_ws),
{name}_ctx AS (
  SELECT {key}{extra}, pos, word,
         coalesce(lag(word) OVER (PARTITION BY {key} ORDER BY pos), '_') AS prev_word,
         coalesce(lead(word) OVER (PARTITION BY {key} ORDER BY pos), '_') AS next_word
  FROM {name}_raw),
{name} AS (SELECT * FROM {name}_ctx WHERE word <> '')"""


def _silver_expr(word: str, suffixes=("ing", "tion", "ed", "ly")) -> str:
    lw, n = f"lower({word})", f"length({word})"
    suf = "CASE " + " ".join(f"WHEN ends_with({lw}, '{s}') AND {n} - {len(s)} >= 3 THEN {len(s)}"
                             for s in suffixes) + " ELSE 0 END"
    pre0 = f"(CASE WHEN starts_with({lw}, 're') OR starts_with({lw}, 'un') OR starts_with({lw}, 'in') THEN 2 ELSE 0 END)"
    pre = f"(CASE WHEN {n} - {pre0} - ({suf}) >= 3 THEN {pre0} ELSE 0 END)"
    punct = "'^([^|,.;:!?]+)([,.;:!?])$'"
    return (f"(CASE WHEN regexp_matches({word}, {punct}) THEN regexp_replace({word}, {punct}, '\\1|\\2') "
            f"WHEN regexp_matches({lw}, '^[a-z]+$') THEN "
            f"(CASE WHEN {pre} > 0 THEN substr({word}, 1, {pre}) || '|' ELSE '' END) || "
            f"substr({word}, {pre} + 1, {n} - {pre} - ({suf})) || "
            f"(CASE WHEN ({suf}) > 0 THEN '|' || substr({word}, {n} - ({suf}) + 1, {suf}) ELSE '' END) "
            f"ELSE {word} END)")


WORDS = _words_cte()
SILVER = WORDS + f""",
silver AS (SELECT *, {_silver_expr('word')} AS seg FROM words)"""
LEX = """,
lex AS (
  SELECT word, string_agg(tag, '|' ORDER BY tag) AS tags FROM (
    SELECT DISTINCT word, CASE upper(lang) WHEN 'DE' THEN 'GER' WHEN 'EN' THEN 'GER' WHEN 'FR' THEN 'ROM'
                                           WHEN 'ES' THEN 'ROM' ELSE upper(lang) END AS tag
    FROM words WHERE lang IS NOT NULL) GROUP BY word)"""
FREQS = """,
cnts AS (SELECT word, count(*) AS cnt FROM words GROUP BY word),
freqs AS (SELECT word, cnt, cnt::DOUBLE / (SELECT sum(cnt)::DOUBLE FROM cnts) AS freq FROM cnts)"""


def _bits(seg: str) -> str:
    return (f"regexp_replace(regexp_replace(regexp_replace({seg}, '[^|]\\|', chr(1), 'g'), "
            f"'[^' || chr(1) || ']', '0', 'g'), chr(1), '1', 'g')")


def _aligned(word: str, seg: str) -> str:
    t = f"trim({seg})"
    malformed = (f"((length({t}) > 1 AND (starts_with({t}, '|') OR ends_with({t}, '|'))) "
                 f"OR contains({t}, '||'))")
    return (f"(({word} = '|' AND {seg} = '|') OR ({word} <> '|' AND length({word}) = "
            f"length(replace({seg}, '|', '')) AND NOT {malformed}))")


def _split_flag(key: str) -> str:
    return f"(CASE WHEN {md5u(key)} % 10 = 0 THEN 1 ELSE 0 END)"


SPLIT = SILVER + f""",
split AS (SELECT *, {_split_flag("doc_id::VARCHAR || '#' || pos::VARCHAR")} AS is_test FROM silver),
tfreqs AS (
  SELECT w AS word, count(*) AS n FROM (
    SELECT unnest(list_append(string_split(seg, '|'), word)) AS w FROM split WHERE is_test = 0) GROUP BY w)"""

VOWELS = "('a','e','i','o','u','A','E','I','O','U')"


def _feats_cte(with_seg: bool = False) -> str:
    base = SILVER if with_seg else WORDS
    seg_col = ", seg" if with_seg else ""
    def tag(alias):
        return f"coalesce({alias}.tags, '_')"
    lex_joins = {
        "l0": "c.word",
        "m4": "substr(c.word, c.i - 3, 5)", "m3": "substr(c.word, c.i - 2, 4)",
        "m2": "substr(c.word, c.i - 1, 3)", "m1": "substr(c.word, c.i, 2)",
        "p1": "substr(c.word, c.i + 1, 2)", "p2": "substr(c.word, c.i + 1, 3)",
        "p3": "substr(c.word, c.i + 1, 4)", "p4": "substr(c.word, c.i + 1, 5)",
        "sf": "substr(c.word, 1, c.i + 1)", "rm": "substr(c.word, c.i + 2, c.L)",
        "r1": "substr(c.word, c.i + 1, c.L)", "r2": "substr(c.word, greatest(c.i, 1), c.L)",
        "lp": "c.prev_word", "ln": "c.next_word",
    }
    joins = "\n  ".join(f"LEFT JOIN lex {a} ON {a}.word = {e}" for a, e in lex_joins.items())
    def v(off):
        return f"(CASE WHEN substr(c.word, c.i + {1 + off}, 1) IN {VOWELS} THEN 1 ELSE 0 END)"
    pok = "(c.prev_word <> '_' AND c.prev_word <> '')"
    nok = "(c.next_word <> '_' AND c.next_word <> '')"
    return base + LEX + FREQS + f""",
chars AS (
  SELECT doc_id, pos, word, prev_word, next_word{seg_col}, length(word) AS L, unnest(range(length(word))) AS i
  FROM {'silver' if with_seg else 'words'}),
feats AS (
  SELECT c.doc_id, c.pos, c.word{', c.seg' if with_seg else ''},
    {tag('l0')} AS group_in_lex,
    substr(c.word, c.i + 1, 1) AS current_letter,
    CASE WHEN c.i > 1 THEN substr(c.word, c.i - 1, 1) ELSE '_' END AS prev_prev_letter,
    CASE WHEN c.i > 0 THEN substr(c.word, c.i, 1) ELSE '_' END AS prev_letter,
    CASE WHEN c.i < c.L - 1 THEN substr(c.word, c.i + 2, 1) ELSE '_' END AS next_letter,
    CASE WHEN c.i < c.L - 2 THEN substr(c.word, c.i + 3, 1) ELSE '_' END AS next_next_letter,
    CASE WHEN c.i >= 4 THEN {tag('m4')} ELSE '_' END AS mns4_coarse,
    CASE WHEN c.i >= 3 THEN {tag('m3')} ELSE '_' END AS mns3_coarse,
    CASE WHEN c.i >= 2 THEN {tag('m2')} ELSE '_' END AS mns2_coarse,
    CASE WHEN c.i >= 1 THEN {tag('m1')} ELSE '_' END AS mns1_coarse,
    CASE WHEN c.i + 1 <= c.L THEN {tag('p1')} ELSE '_' END AS pls1_coarse,
    CASE WHEN c.i + 2 <= c.L THEN {tag('p2')} ELSE '_' END AS pls2_coarse,
    CASE WHEN c.i + 3 <= c.L THEN {tag('p3')} ELSE '_' END AS pls3_coarse,
    CASE WHEN c.i + 4 <= c.L THEN {tag('p4')} ELSE '_' END AS pls4_coarse,
    {tag('sf')} AS so_far_pos,
    CASE WHEN c.i + 1 < c.L THEN {tag('rm')} ELSE '_' END AS remaining_pos,
    CASE WHEN {pok} THEN {tag('lp')} ELSE '_' END AS prev_grp_pos,
    CASE WHEN {nok} THEN {tag('ln')} ELSE '_' END AS next_grp_pos,
    {tag('r1')} AS remaining_pos_mns1,
    {tag('r2')} AS remaining_pos_mns2,
    CASE WHEN {pok} THEN substr(c.prev_word, 1, 1) ELSE '_' END AS prev_grp_first,
    CASE WHEN {pok} THEN right(c.prev_word, 1) ELSE '_' END AS prev_grp_last,
    CASE WHEN {nok} THEN substr(c.next_word, 1, 1) ELSE '_' END AS next_grp_first,
    CASE WHEN {nok} THEN right(c.next_word, 1) ELSE '_' END AS next_grp_last,
    c.i AS idx, c.L AS len_bound_group,
    {v(0)} AS current_vowel,
    CASE WHEN c.i > 1 THEN {v(-2)} ELSE -1 END AS prev_prev_vowel,
    CASE WHEN c.i > 0 THEN {v(-1)} ELSE -1 END AS prev_vowel,
    CASE WHEN c.i < c.L - 1 THEN {v(1)} ELSE -1 END AS next_vowel,
    CASE WHEN c.i < c.L - 2 THEN {v(2)} ELSE -1 END AS next_next_vowel,
    CASE WHEN {pok} THEN length(c.prev_word) ELSE 0 END AS prev_grp_len,
    CASE WHEN {nok} THEN length(c.next_word) ELSE 0 END AS next_grp_len,
    (coalesce(fs.freq, 0.0) * (CASE WHEN c.i + 1 < c.L THEN coalesce(fr.freq, 0.0) ELSE 0.0 END))
      / (coalesce(fw.freq, 0.0) + 1e-10) AS freq_ratio
  FROM chars c
  {joins}
  LEFT JOIN freqs fs ON fs.word = substr(c.word, 1, c.i + 1)
  LEFT JOIN freqs fr ON fr.word = substr(c.word, c.i + 2, c.L)
  LEFT JOIN freqs fw ON fw.word = c.word)"""


def _by_shape_sql(cols, extra="", src="feats") -> str:
    ck = cks("doc_id", "pos", *cols)
    return (f"SELECT len_bound_group::BIGINT AS len_bound_group, idx::BIGINT AS idx, count(*) AS n, "
            f"{ck} AS checksum{extra} FROM {src} GROUP BY 1, 2")


FREQ_SUM_SQL = (", " + msum("floor(freq_ratio * 1e6)::BIGINT") + " AS freq_ratio_e6, "
                "sum(CASE WHEN freq_ratio > 0 THEN 1 ELSE 0 END)::BIGINT AS freq_ratio_nonzero")

ENC_SQL = ",\npairs AS (" + "\n  UNION ".join(
    f"SELECT DISTINCT '{c}' AS col, {c}::VARCHAR AS value FROM feats" for c in fe.CAT_COLS) + """),
enc AS (
  SELECT col, value, (dense_rank() OVER (PARTITION BY col ORDER BY value))::INTEGER AS code
  FROM pairs WHERE value <> '_'
  UNION ALL SELECT DISTINCT col, '_' AS value, 0::INTEGER AS code FROM (SELECT unnest(["""
ENC_SQL += ", ".join(f"'{c}'" for c in fe.CAT_COLS) + "]) AS col))"

ENCODED_SQL = ",\nencoded AS (SELECT f.doc_id, f.pos, f.idx, f.len_bound_group, " + ", ".join(
    f"coalesce(e_{k}.code, 0) AS {c}" for k, c in enumerate(fe.CAT_COLS)) + " FROM feats f " + " ".join(
    f"LEFT JOIN enc e_{k} ON e_{k}.col = '{c}' AND e_{k}.value = f.{c}" for k, c in enumerate(fe.CAT_COLS)) + ")"


RULE_PRED = ("(length(word) = 1 OR regexp_matches(word, '^([0-9]+)$') "
             "OR regexp_matches(word, '^([^|,.;:!?]+)([,.;:!?])$'))")
RULE_SEG = ("(CASE WHEN length(word) > 1 THEN regexp_replace(regexp_replace(word, '^([0-9]+)$', '\\1'), "
            "'^([^|,.;:!?]+)([,.;:!?])$', '\\1|\\2') ELSE word END)")


def _decode_sql(words: str, key: str) -> str:
    allowed = ("((c.i = 1 AND ch IN ('e','E','n','N')) OR (-(c.L - c.i - 1) = -4 AND nx IN ('t','T')) "
               "OR (-(c.L - c.i - 1) = -3 AND nx IN ('i','I')) OR (-(c.L - c.i - 1) = -2 AND nx IN ('e','E','l','L')))")
    return f""",
mchars AS (
  SELECT {key}, pos, word, length(word) AS L, unnest(range(length(word))) AS i
  FROM {words} WHERE NOT {RULE_PRED}),
mp AS (
  SELECT {key}, pos, word, L, i, substr(word, i + 1, 1) AS ch, substr(word, i + 2, 1) AS nx,
         {md5u("word || '#' || i::VARCHAR")} / 4294967296.0 AS p FROM mchars),
decoded AS (
  SELECT {key}, pos, word,
         string_agg(ch || CASE WHEN p > 0.5 AND i < L - 1 AND {allowed.replace('c.', '')} THEN '|' ELSE '' END, ''
                    ORDER BY i) AS seg,
         least(1.0, min(p)) AS min_boundary_p
  FROM mp GROUP BY {key}, pos, word
  UNION ALL
  SELECT {key}, pos, word, {RULE_SEG} AS seg, 1.0 AS min_boundary_p FROM {words} WHERE {RULE_PRED})
SELECT {key}, count(*) AS n, {cks('pos', 'seg')} AS checksum,
       {msum('floor(min_boundary_p * 1e6)::BIGINT')} AS min_p_e6
FROM decoded GROUP BY {key}"""


def _eval_sql(group: str = "", join_labels: bool = False) -> str:
    g_sel = f"{group}, " if group else ""
    src = "silver s"
    if join_labels:
        src = "silver s JOIN (SELECT doc_id, quality::BIGINT AS quality FROM labels) lb USING (doc_id)"
    flag = lambda a, b: (f"(CASE WHEN n > 1 THEN len(list_filter(range(1, n), lambda k: substr(gb, k, 1) = '{a}' "
                         f"AND substr(pb, k, 1) = '{b}')) ELSE 0 END)")
    return "WITH " + SILVER + f""",
pairs AS (
  SELECT {g_sel}trim(s.seg) AS g, trim(p.seg) AS pr FROM {src}
  LEFT JOIN (SELECT doc_id, pos, {_silver_expr('word', ('ing', 'tion', 'ed'))} AS seg FROM words) p
    ON p.doc_id = s.doc_id AND p.pos = s.pos),
rowf AS (
  SELECT {g_sel}g, pr, {_bits('g')} AS gb, {_bits('pr')} AS pb,
         length(CASE WHEN g = '|' THEN g ELSE replace(g, '|', '') END) AS n,
         length(CASE WHEN pr = '|' THEN pr ELSE replace(pr, '|', '') END) AS pn
  FROM pairs),
flags AS (
  SELECT {g_sel}pn, (g = pr)::INTEGER AS perfect, {flag('1', '1')} AS tp, {flag('0', '1')} AS fp,
         {flag('1', '0')} AS fn FROM rowf),
agg AS (
  SELECT {g_sel}count(*) AS rows, sum(pn)::BIGINT AS chars, sum(perfect)::BIGINT AS perfect,
         sum(tp)::BIGINT AS tp, sum(fp)::BIGINT AS fp, sum(fn)::BIGINT AS fn, 0::BIGINT AS errors
  FROM flags {'GROUP BY ' + group if group else ''}),
agg2 AS (
  SELECT *, coalesce(tp::DOUBLE / nullif(tp + fp, 0)::DOUBLE, 0.0) AS precision,
            coalesce(tp::DOUBLE / nullif(tp + fn, 0)::DOUBLE, 0.0) AS recall FROM agg)
SELECT {g_sel}rows, chars, perfect, tp, fp, fn, errors, precision, recall,
       coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f_score,
       coalesce(perfect::DOUBLE / nullif(rows, 0)::DOUBLE, 0.0) AS perfect_ratio
FROM agg2"""


def _eval_errors_sql() -> str:
    chars = lambda c: f"length(CASE WHEN {c} = '|' THEN {c} ELSE replace({c}, '|', '') END)"
    bad = lambda c, side: (f"WHEN length({c}) > 1 AND starts_with({c}, '|') THEN '{side}_leading_pipe' "  # noqa: E731
                           f"WHEN length({c}) > 1 AND ends_with({c}, '|') THEN '{side}_trailing_pipe' "
                           f"WHEN contains({c}, '||') THEN '{side}_double_pipe' ")
    return "WITH " + SILVER + f""",
p0 AS (SELECT doc_id, pos, {_silver_expr('word', ('ing', 'tion', 'ed'))} AS seg FROM words WHERE pos % 37 <> 3),
p1 AS (
  SELECT doc_id, pos, CASE pos % 37 WHEN 7 THEN '|' || seg WHEN 11 THEN seg || 'x' WHEN 13 THEN seg || '||a' ELSE seg END AS seg FROM p0
  UNION ALL SELECT doc_id, pos, seg FROM p0 WHERE pos % 37 = 5
  UNION ALL SELECT doc_id, -pos - 1, seg FROM p0 WHERE pos % 37 = 17),
g2 AS (SELECT doc_id, pos, trim(seg) AS g FROM silver),
once AS (SELECT doc_id, pos, min(trim(seg)) AS p, count(*) AS copies FROM p1 GROUP BY 1, 2),
j AS (SELECT g, p, coalesce(copies, 1) AS copies FROM g2 FULL JOIN once USING (doc_id, pos)),
r AS (
  SELECT g, p, CASE WHEN g IS NULL THEN 'extra_pred' WHEN p IS NULL THEN 'missing_pred' {bad('g', 'gold')} {bad('p', 'pred')}
                    WHEN {chars('g')} <> {chars('p')} THEN 'char_mismatch' ELSE 'scored' END AS error FROM j
  UNION ALL SELECT NULL, p, 'duplicate_key' FROM j, range(1, copies))
SELECT error, count(*) AS rows, coalesce(sum({chars('g')}), 0)::BIGINT AS gold_chars, coalesce(sum({chars('p')}), 0)::BIGINT AS chars
FROM r GROUP BY error"""


TURNS = r"""
turns AS (
  SELECT conv_id, turn, string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+') AS ws
  FROM conversations),
tw_raw AS (SELECT conv_id, turn, unnest(range(len(ws))) AS pos, unnest(ws) AS word FROM turns),
tw AS (SELECT * FROM tw_raw WHERE word <> ''),
tw_ctx AS (
  SELECT conv_id, turn, pos, word,
         coalesce(lag(word) OVER (PARTITION BY conv_id ORDER BY turn, pos), '_') AS prev_word,
         coalesce(lead(word) OVER (PARTITION BY conv_id ORDER BY turn, pos), '_') AS next_word
  FROM tw)"""

SEGS_LONG = SILVER + """,
sl AS (
  SELECT doc_id, pos, lang, CASE WHEN seg = '|' THEN ['|'] ELSE string_split(seg, '|') END AS parts FROM silver),
sx AS (SELECT doc_id, pos, lang, unnest(range(len(parts))) AS seg_idx, unnest(parts) AS segment FROM sl)"""

SENTS = WORDS + """,
sd AS (
  SELECT doc_id, pos, word, coalesce(sum(CASE WHEN word = '.' THEN 1 ELSE 0 END) OVER (
    PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sent_dots FROM words),
sc AS (
  SELECT doc_id, pos, sent_dots,
         floor((row_number() OVER (PARTITION BY doc_id, sent_dots ORDER BY pos) - 1) / 101)::BIGINT AS sent_chunk
  FROM sd)"""

CHAR_ACC = SILVER + f""",
sc AS (
  SELECT word, seg, length(word) AS L, unnest(range(length(word))) AS i FROM silver),
sp AS (
  SELECT i, L, substr({_bits('seg')}, i + 1, 1)::INTEGER AS label,
         (CASE WHEN {md5u("word || '#' || i::VARCHAR")} / 4294967296.0 > 0.5 THEN 1 ELSE 0 END) AS pred FROM sc)"""

ORACLE_SQL = {
    "words": f"WITH {WORDS}\nSELECT doc_id, count(*) AS n_words, sum(length(word))::BIGINT AS n_chars, "
             f"{cks('pos', 'word', 'prev_word', 'next_word')} AS checksum FROM words GROUP BY doc_id",
    "turn_words": f"WITH {TURNS}\nSELECT conv_id, count(*) AS n_words, "
                  f"{cks('turn', 'pos', 'word', 'prev_word', 'next_word')} AS checksum FROM tw_ctx GROUP BY conv_id",
    "silver_segs": f"WITH {SILVER}\nSELECT lang, (CASE WHEN seg = '|' THEN 1 ELSE len(string_split(seg, '|')) END)"
                   f"::BIGINT AS n_segs, count(*) AS n, {cks('doc_id', 'pos', 'seg')} AS checksum "
                   f"FROM silver GROUP BY 1, 2",
    "boundary_bits": f"WITH {SILVER},\nb AS (SELECT *, {_bits('seg')} AS bits FROM silver)\n"
                     f"SELECT lang, count(*) AS n, sum(length(bits) - length(replace(bits, '1', '')))::BIGINT "
                     f"AS boundaries, {cks('doc_id', 'pos', 'bits')} AS checksum, count(*) AS roundtrip_ok "
                     f"FROM b GROUP BY lang",
    "align_check": f"WITH {SILVER},\na AS (SELECT *, {_silver_expr('next_word')} AS next_seg FROM silver)\n"
                   f"SELECT lang, count(*) AS n, sum({_aligned('word', 'seg')}::INTEGER)::BIGINT AS own_aligned, "
                   f"sum({_aligned('word', 'next_seg')}::INTEGER)::BIGINT AS next_aligned FROM a GROUP BY lang",
    "lexicon_tags": f"WITH {WORDS}{LEX}\nSELECT word, tags FROM lex",
    "lexicon_raw": f"WITH {WORDS},\nlexr AS (SELECT word, string_agg(tag, '|' ORDER BY tag) AS tags FROM "
                   f"(SELECT DISTINCT word, upper(lang) AS tag FROM words WHERE lang IS NOT NULL) GROUP BY word)\n"
                   f"SELECT tags, count(*) AS n, {cks('word')} AS checksum FROM lexr GROUP BY tags",
    "freq_norm": f"WITH {WORDS}{FREQS}\nSELECT word, cnt, freq FROM freqs",
    "split_kth": f"WITH {SILVER},\nk AS (SELECT doc_id, pos, word, (row_number() OVER (ORDER BY doc_id, pos) % 10 = 0)::INTEGER AS is_test FROM silver)\n"
                 f"SELECT doc_id, sum(is_test)::BIGINT AS n_test, count(*) AS n, {cks('pos', 'word', 'is_test')} AS checksum FROM k GROUP BY 1",
    "ordered_lines": f"WITH {SILVER},\nl AS (SELECT row_number() OVER w - 1 AS pos, word, coalesce(lag(word) OVER w, '_') AS prev_word, "
                     f"coalesce(lead(word) OVER w, '_') AS next_word FROM silver WINDOW w AS (ORDER BY doc_id, pos))\n"
                     f"SELECT pos // 1000 AS chunk, count(*) AS n, {cks('pos', 'word', 'prev_word', 'next_word')} AS checksum FROM l GROUP BY 1",
    "ordered_seg_table": f"WITH {SILVER},\nl AS (SELECT lang, row_number() OVER w - 1 AS pos, word, seg, coalesce(lag(word) OVER w, '_') AS prev_word, "
                         f"coalesce(lead(word) OVER w, '_') AS next_word FROM silver WINDOW w AS (PARTITION BY lang ORDER BY doc_id, pos))\n"
                         f"SELECT lang, count(*) AS n, {cks('pos', 'prev_word', 'next_word', 'word', 'seg')} AS checksum FROM l GROUP BY 1",
    "split_hash": f"WITH {SPLIT}\nSELECT lang, sum(is_test)::BIGINT AS n_test, sum(1 - is_test)::BIGINT AS n_train "
                  f"FROM split GROUP BY lang",
    "train_freqs": f"WITH {SPLIT}\nSELECT word, n FROM tfreqs",
    "prune_lexicon": f"WITH {SPLIT}{LEX}\nSELECT l.word, l.tags FROM lex l LEFT JOIN tfreqs t ON t.word = l.word "
                     f"WHERE coalesce(t.n, 0) > 1 OR {md5u('l.word')} / 4294967296.0 > 0.1",
    "letter_feats": f"WITH {_feats_cte()}\n{_by_shape_sql(LETTER_COLS)}",
    "group_feats": f"WITH {_feats_cte()}\n{_by_shape_sql(GROUP_COLS)}",
    "lexicon_feats": f"WITH {_feats_cte()}\n{_by_shape_sql(LEX_COLS)}",
    "freq_ratio": f"WITH {_feats_cte()}\n{_by_shape_sql([], FREQ_SUM_SQL)}",
    "feature_frame": f"WITH {_feats_cte(True)},\nfl AS (SELECT *, substr({_bits('seg')}, idx + 1, 1)::INTEGER AS label "
                     f"FROM feats)\n{_by_shape_sql(fe.CAT_COLS + INT_NUM_COLS + ['label'], FREQ_SUM_SQL, 'fl')}",
    "encoders": f"WITH {_feats_cte()}{ENC_SQL}\nSELECT col, value, code FROM enc",
    "encoders_full": f"WITH {_feats_cte()}{ENC_SQL}\nSELECT col, value, code FROM enc",
    "encoded_frame": f"WITH {_feats_cte()}{ENC_SQL}{ENCODED_SQL}\n{_by_shape_sql(fe.CAT_COLS, '', 'encoded')}",
    "encoded_unseen": f"WITH {_feats_cte()}{ENC_SQL.replace('FROM feats', 'FROM feats WHERE doc_id % 2 = 0')}{ENCODED_SQL}\n"
                      f"{_by_shape_sql(fe.CAT_COLS, '', '(SELECT * FROM encoded WHERE doc_id % 2 = 1)')}",
    "regex_rules": f"WITH {WORDS}\nSELECT lang, count(*) AS n, {cks('doc_id', 'pos', 'seg')} AS checksum FROM "
                   f"(SELECT lang, doc_id, pos, {RULE_SEG} AS seg FROM words WHERE {RULE_PRED}) GROUP BY lang",
    "allowed_decode": f"WITH {WORDS}{_decode_sql('words', 'doc_id')}",
    "char_decode": f"WITH {WORDS}{_decode_sql('words', 'doc_id')}",
    "benchmark_decode": f"WITH {_words_cte('benchmark', 'item_id', '', 'bw')}{_decode_sql('bw', 'item_id')}",
    "segments_long": f"WITH {SEGS_LONG}\nSELECT lang, seg_idx::BIGINT AS seg_idx, count(*) AS n, "
                     f"{cks('doc_id', 'pos', 'segment')} AS checksum FROM sx GROUP BY 1, 2",
    "sentence_chunks": f"WITH {SENTS}\nSELECT doc_id, max(sent_dots)::BIGINT AS max_dots, "
                       f"max(sent_chunk)::BIGINT AS max_chunk, {cks('pos', 'sent_dots', 'sent_chunk')} AS checksum "
                       f"FROM sc GROUP BY doc_id",
    "eval_prf": _eval_sql(),
    "eval_by_lang": _eval_sql("lang"),
    "eval_by_quality": _eval_sql("quality", join_labels=True),
    "eval_errors": _eval_errors_sql(),
    "char_accuracy": f"WITH {CHAR_ACC}\nSELECT avg(CASE WHEN label = (CASE WHEN i + 1 = L THEN 0 ELSE pred END) "
                     f"THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy, count(*) AS chars FROM sp",
}
