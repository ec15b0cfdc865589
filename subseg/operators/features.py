"""Character feature frame.

Plan (one lookup join instead of one probe per feature):

1. distinct word types;
2. each type's *probed* substrings only - prefixes, suffixes and 2..5-char
   windows, O(6·L) per word - exploded;
3. inner join with the lookup table (lexicon tags + frequencies) on the
   substring: only hits survive;
4. hits regrouped per type into ``map<substring, struct<tags, freq>>``
   (bounded by the word's own length);
5. each type explodes one row per character and reads every lexicon and
   frequency feature with a codegen'd ``try_element_at`` on its map - once per
   type, not per token;
6. tokens join their type's character rows and add the neighbour features.

Neighbour-word tags are plain left joins on the neighbour word.  Callers
deduplicate rows to ``(prev_word, word, next_word)`` first, so the joins see
distinct contexts, not tokens.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import SegConfig
from ..functions.rules import is_vowel, letter
from ..functions.segstr import bit_at, boundary_bits
from .lexicon import lookup_dict
from .seats import SEAT, answers, has_seats

MISSING = "_"

# fixed values: feature names and their order in the model input
CAT_COLS = [
    "group_in_lex", "current_letter", "prev_prev_letter", "prev_letter", "next_letter", "next_next_letter",
    "mns4_coarse", "mns3_coarse", "mns2_coarse", "mns1_coarse", "pls1_coarse", "pls2_coarse",
    "pls3_coarse", "pls4_coarse", "so_far_pos", "remaining_pos", "prev_grp_pos", "next_grp_pos",
    "remaining_pos_mns1", "remaining_pos_mns2", "prev_grp_first", "prev_grp_last", "next_grp_first",
    "next_grp_last",
]
NUM_COLS = [
    "idx", "len_bound_group", "current_vowel", "prev_prev_vowel", "prev_vowel", "next_vowel",
    "next_next_vowel", "prev_grp_len", "next_grp_len", "freq_ratio",
]
WINDOW_SIZES = (1, 2, 3, 4)


def probe_array(word: Column, lengths: list[int] | None = None, windows: bool = True) -> Column:
    """Every substring a feature of this word can look up (whole word included); ``windows``: those around a character too.

    ``lengths``: the lengths that the dictionary has; other prefixes and
    suffixes can't hit, so a very long word costs its length times these, not
    its length squared.
    """
    n = F.length(word)
    if lengths is None:
        prefixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(word, 1, k))
        suffixes = F.transform(F.sequence(F.lit(1), n), lambda k: F.substring(word, k, n - k + 1))
    else:
        fits = F.filter(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>"), lambda k: k <= n)
        prefixes = F.transform(fits, lambda k: F.substring(word, F.lit(1), k))
        suffixes = F.transform(fits, lambda k: F.substring(word, n - k + 1, k))
    parts = [prefixes, suffixes]

    def window_of(size):
        return lambda k: F.substring(word, k, size)

    for size in (2, 3, 4, 5) if windows else ():
        parts.append(F.when(n >= size, F.transform(F.sequence(F.lit(1), n - size + 1), window_of(size)))
                     .otherwise(F.array().cast("array<string>")))
    return F.array_distinct(F.concat(*parts))


def lookup_maps(types: DataFrame, dict_df: DataFrame, windows: bool = True) -> DataFrame:
    """``(word)`` types -> ``(word, m)`` with ``m`` holding only the substrings that hit."""
    lengths = sorted(r[0] for r in dict_df.select(F.length("word")).distinct().collect() if r[0])  # word lengths: some dozens
    probes = types.select("word", F.explode(probe_array(F.col("word"), lengths, windows)).alias("s"))
    d = dict_df.select(F.col("word").alias("s"), "tags", "freq")
    hits = probes.join(d, "s", "inner")
    return hits.groupBy("word").agg(
        F.map_from_entries(F.collect_list(F.struct("s", F.struct("tags", "freq")))).alias("m"))


def _tag(m: Column, key: Column, missing: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key).getField("tags"), missing)


def _freq(m: Column, key: Column) -> Column:
    return F.coalesce(F.try_element_at(m, key).getField("freq"), F.lit(0.0))


#: name of the feature that a tag column (a sequence tagger's output) becomes
TAG_FEATURE = "bert"


def tag_feature(tag: Column) -> Column:
    """A word's tag as a feature (P8): no tag is ``O``, ``CDO`` is shown as ``X``."""
    t = F.coalesce(tag, F.lit("O"))
    return F.when(t == "CDO", F.lit("X")).otherwise(t)


#: features read from a word's lookup map
LOOKUP_COLS = {"group_in_lex", "so_far_pos", "remaining_pos", "remaining_pos_mns1", "remaining_pos_mns2", "freq_ratio",
               *(f"{s}{n}_coarse" for s in ("mns", "pls") for n in WINDOW_SIZES)}
WINDOW_COLS = {c for c in LOOKUP_COLS if c.endswith("_coarse")}
INTERNAL_COLS = [c for c in CAT_COLS + NUM_COLS if not c.startswith(("prev_grp", "next_grp"))]


def _lookup_exprs(w: Column, m: Column, i: Column, L: Column, has_freqs: bool, missing: Column | None = None) -> dict[str, Column]:
    """The features that character ``i`` of a word reads from the word's lookup map."""
    none = F.lit(MISSING) if missing is None else missing

    def tag(key: Column) -> Column:
        return _tag(m, key, none)

    cols: dict[str, Column] = {"group_in_lex": tag(w)}
    for n in reversed(WINDOW_SIZES):
        cols[f"mns{n}_coarse"] = F.when(i >= n, tag(F.substring(w, i - n + 1, F.lit(n + 1)))).otherwise(none)
    for n in WINDOW_SIZES:
        cols[f"pls{n}_coarse"] = F.when(i + n <= L, tag(F.substring(w, i + 1, F.lit(n + 1)))).otherwise(none)
    so_far = F.substring(w, F.lit(1), i + 1)
    remaining = F.substring(w, i + 2, L)
    cols["so_far_pos"] = tag(so_far)
    cols["remaining_pos"] = F.when(i + 1 < L, tag(remaining)).otherwise(none)
    cols["remaining_pos_mns1"] = tag(F.substring(w, i + 1, L))
    cols["remaining_pos_mns2"] = tag(F.substring(w, F.greatest(i, F.lit(1)), L))
    if not has_freqs:
        cols["freq_ratio"] = F.lit(0.0)
    else:
        cols["freq_ratio"] = (_freq(m, so_far) * F.when(i + 1 < L, _freq(m, remaining)).otherwise(0.0)
                              / (_freq(m, w) + F.lit(1e-10)))
    return cols


def _letter_exprs(w: Column, i: Column, L: Column, cfg: SegConfig) -> dict[str, Column]:
    """The features that follow from a word's spelling alone."""
    def ch(offset: int) -> Column:
        return F.substring(w, i + 1 + offset, F.lit(1))

    cols: dict[str, Column] = {}
    cols["current_letter"] = letter(ch(0), cfg)
    cols["prev_prev_letter"] = F.when(i > 1, letter(ch(-2), cfg)).otherwise(MISSING)
    cols["prev_letter"] = F.when(i > 0, letter(ch(-1), cfg)).otherwise(MISSING)
    cols["next_letter"] = F.when(i < L - 1, letter(ch(1), cfg)).otherwise(MISSING)
    cols["next_next_letter"] = F.when(i < L - 2, letter(ch(2), cfg)).otherwise(MISSING)
    cols["idx"] = i
    cols["len_bound_group"] = L
    cols["current_vowel"] = is_vowel(ch(0), cfg)
    cols["prev_prev_vowel"] = F.when(i > 1, is_vowel(ch(-2), cfg)).otherwise(-1)
    cols["prev_vowel"] = F.when(i > 0, is_vowel(ch(-1), cfg)).otherwise(-1)
    cols["next_vowel"] = F.when(i < L - 1, is_vowel(ch(1), cfg)).otherwise(-1)
    cols["next_next_vowel"] = F.when(i < L - 2, is_vowel(ch(2), cfg)).otherwise(-1)
    return cols


def _with_maps(types: DataFrame, maps: DataFrame | None) -> DataFrame:
    if maps is None:  # no feature looks anything up
        return types.withColumn("m", F.lit(None).cast("map<string,struct<tags:string,freq:double>>"))
    return types.join(maps, "word", "left")


def type_char_features(types: DataFrame, maps: DataFrame | None, cfg: SegConfig, has_freqs: bool) -> DataFrame:
    """Word-internal features, one row per character of each distinct word type.

    Letters, vowels, every lexicon window and the frequency ratio depend on
    the word alone, so they are computed once per type (Zipf: far fewer
    types than tokens) and joined to the tokens afterwards.
    """
    w, m, i = F.col("word"), F.col("m"), F.col("idx")
    L = F.length(w)
    r = _with_maps(types, maps).select("word", "m", F.explode(F.sequence(F.lit(0), L - 1)).alias("idx"))
    cols = {**_lookup_exprs(w, m, i, L, has_freqs), **_letter_exprs(w, i, L, cfg)}
    return r.select("word", *[cols[c].alias(c) for c in INTERNAL_COLS])


#: so many different tag sets of a lexicon are sent as numbers
MAX_TAG_SETS = 10_000


def seat_char_features(rows: DataFrame, types: DataFrame, lookup: DataFrame, cfg: SegConfig, has_freqs: bool, asks: set[str]) -> DataFrame:
    """``type_char_features`` of each seat's words, at that seat.

    What a word's characters look up is found once a type and sent to the
    seats as one array of tags and one of ratios; what its spelling says is
    read there.  Tag sets, few in a lexicon, travel as numbers.
    """
    w, i = F.col("word"), F.col("idx")
    L = F.length(w)
    sets = [r[0] for r in lookup.select("tags").filter(F.col("tags").isNotNull()).distinct().limit(MAX_TAG_SETS + 1).collect()]
    missing, shown = F.lit(MISSING), lambda c: c
    if len(sets) <= MAX_TAG_SETS:
        codes = rows.sparkSession.createDataFrame([(t, k + 1) for k, t in enumerate(sorted(sets))], "tags string, _code short")
        lookup = lookup.join(F.broadcast(codes), "tags", "left").select("word", F.col("_code").alias("tags"), "freq")
        missing, names = F.lit(0).cast("short"), F.array(*[F.lit(t) for t in [MISSING, *sorted(sets)]])
        shown = lambda c: F.get(names, c.cast("int"))
    tags = [c for c in INTERNAL_COLS if c in asks and c != "freq_ratio"]
    at = F.sequence(F.lit(0), L - 1)

    def found(k: Column) -> dict[str, Column]:
        return _lookup_exprs(w, F.col("m"), k, L, has_freqs, missing)

    packed = []
    if tags:
        packed.append(F.flatten(F.transform(at, lambda k: F.array(*[found(k)[c] for c in tags]))).alias("_tags"))
    if "freq_ratio" in asks:
        packed.append(F.transform(at, lambda k: found(k)["freq_ratio"]).alias("_ratios"))
    maps = lookup_maps(types, lookup, bool(asks & WINDOW_COLS))
    per_type = types.join(maps, "word", "left").select("word", *packed)
    chars = answers(rows, per_type, ["word"]).select("*", F.explode(at).alias("idx"))
    cols = _letter_exprs(w, i, L, cfg) | {c: shown(F.get("_tags", i * len(tags) + n)) for n, c in enumerate(tags)}
    cols["freq_ratio"] = F.get("_ratios", i) if "freq_ratio" in asks else F.lit(0.0)
    return chars.select(SEAT, "word", *[cols[c].alias(c) for c in INTERNAL_COLS if c in cols])


CONTEXT_COLS = [c for c in CAT_COLS + NUM_COLS if c not in INTERNAL_COLS]


def token_context(rows: DataFrame, lex_tags: DataFrame, only: list[str] | None = None) -> DataFrame:
    """Neighbour-word features, once per token row (before any per-char fan-out).

    A neighbour's letters and length are read before the joins, so that these
    move its lookup key alone, not the neighbours' spellings beside it.
    ``only``: as in ``char_features``; tags not asked for are not looked up.
    Seated rows stay where they are: their seats ask for the neighbours' tags.
    """
    def nb_ok(c: str) -> Column:
        return (F.col(c) != MISSING) & (F.col(c) != "")

    at_seats = has_seats(rows)

    def key_of(c: str) -> Column:
        if at_seats:
            return F.when(nb_ok(c), F.col(c))
        # a missing neighbour looks nothing up: its rows get keys of no word, spread over tasks
        return F.when(nb_ok(c), F.col(c)).otherwise(F.concat(F.lit("\u0000"), F.pmod(F.xxhash64("word", "prev_word", "next_word"), F.lit(4096)).cast("string")))

    cols, sides = {}, [s for s in ("prev", "next") if only is None or f"{s}_grp_pos" in only]
    for side in ("prev", "next"):
        nb = f"{side}_word"
        cols[f"{side}_grp_first"] = F.when(nb_ok(nb), F.substring(nb, 1, 1)).otherwise(MISSING)
        cols[f"{side}_grp_last"] = F.when(nb_ok(nb), F.substring(nb, -1, 1)).otherwise(MISSING)
        cols[f"{side}_grp_len"] = F.when(nb_ok(nb), F.length(nb)).otherwise(0)
    keys = {f"_{s}_key": key_of(f"{s}_word") for s in sides}
    r = rows.select("*", *[c.alias(n) for n, c in {**cols, **keys}.items()])
    tags = lex_tags.select(F.col("word").alias("_nb"), F.col("tags").alias("_tags"))
    if at_seats and sides:
        near = rows.select(SEAT, F.explode(F.array(*[key_of(f"{s}_word") for s in sides])).alias("_nb")).filter(F.col("_nb").isNotNull())
        tags = answers(near, tags, ["_nb"]).hint("shuffle_hash")
    for side in ("prev", "next"):
        pos = F.lit(MISSING)
        if side in sides:
            r = r.withColumn("_nb", F.col(f"_{side}_key")).join(tags, [SEAT, "_nb"] if at_seats else ["_nb"], "left")
            pos = F.when(F.col(f"{side}_grp_len") > 0, F.coalesce("_tags", F.lit(MISSING))).otherwise(MISSING)
        r = r.withColumn(f"{side}_grp_pos", pos).drop("_tags", "_nb")
    return r.select(*rows.columns, *CONTEXT_COLS)


def char_features(rows: DataFrame, lex_tags: DataFrame, freqs: DataFrame | None, cfg: SegConfig,
                  seg_col: str | None = None, keep: tuple[str, ...] = (),
                  tag_col: str | None = None, encode_with=None, only: list[str] | None = None) -> DataFrame:
    """``rows(word, prev_word, next_word, *keep[, seg])`` -> one row per character.

    Output: ``*keep, word, CAT_COLS (STRING), NUM_COLS`` (+ ``label INT`` when
    ``seg_col`` is given, + ``bert`` when ``tag_col`` is given).  With
    ``encode_with(frame, cat_cols, keep_cols)`` the categorical columns are
    codes: each side of the join is encoded before its rows fan out, type rows
    for the word's own columns, token rows for the neighbours'.
    ``only``: the features to make (default all), so that ablated ones are
    neither looked up nor encoded.
    """
    cat_cols = [c for c in CAT_COLS if only is None or c in only]
    num_cols = [c for c in NUM_COLS if only is None or c in only]
    rows = rows.filter(F.length("word") > 0)
    if tag_col is not None:
        rows = rows.withColumn(TAG_FEATURE, tag_feature(F.col(tag_col)))
    if seg_col is not None:
        # boundary bits once per word (three regex passes), not once per character
        rows = rows.withColumn("_bits", boundary_bits(F.col(seg_col)))
    asks = {*cat_cols, *num_cols} & LOOKUP_COLS
    types = rows.select("word").distinct()
    # rows without neighbours hold their features already
    context = token_context(rows, lex_tags, only) if "prev_word" in rows.columns else rows
    inner = [c for c in cat_cols if c in INTERNAL_COLS]
    outer = [c for c in cat_cols if c not in INTERNAL_COLS] + ([TAG_FEATURE] if tag_col is not None else [])
    at_seats = has_seats(rows)
    if at_seats and not asks and encode_with is None:
        # nothing is looked up: the letters are those of the row's own word
        w = F.col("word")
        r = context.select("*", F.explode(F.sequence(F.lit(0), F.length(w) - 1)).alias("idx"))
        letters = _letter_exprs(w, F.col("idx"), F.length(w), cfg)
        r = r.withColumns({c: e for c, e in letters.items() if c != "idx" and (c in cat_cols or c in num_cols or c == "len_bound_group")})
    else:
        if at_seats:
            tchars = seat_char_features(rows, types, lookup_dict(lex_tags, freqs), cfg, freqs is not None, asks)
        else:
            maps = lookup_maps(types, lookup_dict(lex_tags, freqs), bool(asks & WINDOW_COLS)) if asks else None
            tchars = type_char_features(types, maps, cfg, freqs is not None)
        if encode_with is not None:
            need = {*num_cols, "word", "idx", "len_bound_group", SEAT}
            tchars = encode_with(tchars, inner, [c for c in tchars.columns if c in need])
            context = encode_with(context, outer, [c for c in context.columns if c not in CAT_COLS and c != TAG_FEATURE])
        # one-to-many: every token gets its type's character rows (a hot word's
        # tokens are split across tasks by AQE's skew join, or stay at their seats)
        r = context.join(tchars, [SEAT, "word"] if at_seats else "word", "inner")

    index = [c for c in ("idx", "len_bound_group") if c not in num_cols]
    out = [*[k for k in keep if k != "word"], "word", *cat_cols, *num_cols, *index]
    if tag_col is not None:
        out.append(TAG_FEATURE)
    if seg_col is not None:
        out.append(bit_at(F.col("_bits"), F.col("idx")).alias("label"))
    return r.select(*out)


def feature_value_frames(rows: DataFrame, lex_tags: DataFrame, freqs: DataFrame | None,
                         cfg: SegConfig, tag_col: str | None = None,
                         only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """The two small frames whose value sets equal the character frame's.

    Word-internal columns take the same values over the distinct types'
    character rows as over every token's; neighbour columns the same over
    token rows as over their characters.  Encoders fitted on these see every
    value while reading ~types x length and tokens rows, not tokens x length.
    """
    rows = rows.filter(F.length("word") > 0)
    if tag_col is not None:
        rows = rows.withColumn(TAG_FEATURE, tag_feature(F.col(tag_col)))
    types = rows.select("word").distinct()
    asks = LOOKUP_COLS if only is None else LOOKUP_COLS & set(only)
    maps = lookup_maps(types, lookup_dict(lex_tags, freqs), bool(asks & WINDOW_COLS)) if asks else None
    tchars = type_char_features(types, maps, cfg, freqs is not None)
    if "prev_word" not in rows.columns:  # rows that hold the neighbours' features already
        own = [c for c in [*CONTEXT_COLS, TAG_FEATURE] if c in rows.columns]
        return tchars, (rows.select(*own) if own else rows.select(F.lit(MISSING).alias(CONTEXT_COLS[0]))).distinct()
    # a neighbour's features are its own: each word that stands before or after another is read once, beside a missing one
    own = [TAG_FEATURE] if tag_col is not None else []
    sides = [rows.select(*[F.col(c) if c == side else F.lit(MISSING).alias(c) for c in ("prev_word", "next_word")], *own).distinct()
             for side in ("prev_word", "next_word")]
    near = sides[0].unionByName(sides[1]).withColumn("word", F.lit(""))
    return tchars, token_context(near, lex_tags, only)
