"""Word tables from prose and line files (S1, S2) with neighbour context.

A document is one row, so its word array, and the previous/next word of every
position, are built inside that row and exploded once: no window, no shuffle.
Context that crosses rows (conversation turns) joins one narrow row per turn
on its neighbour's key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MISSING = "_"
WS = r"(?U)\s+"
_STRIP = r"(?U)^\s+|\s+$"


def split_words(text: Column) -> Column:
    """Whitespace split of a whole text after a Unicode-aware strip."""
    return F.split(F.regexp_replace(text, _STRIP, ""), WS)


def split_input(text: Column) -> Column:
    """In-memory string semantics: split only if it holds a newline, else one word."""
    return F.when(text.contains("\n"), split_words(text)).otherwise(F.array(text))


def _ctx_arrays(ws: Column, first_prev: Column | None = None, last_next: Column | None = None,
                predict: bool = False) -> Column:
    """array<struct<word, prev_word, next_word>> for a word array."""
    n = F.size(ws)
    head = F.array(first_prev if first_prev is not None else F.lit(MISSING))
    tail = F.array(last_next if last_next is not None else F.lit(MISSING))
    prevs = F.concat(head, F.slice(ws, 1, F.greatest(n - 1, F.lit(0))))
    nexts = F.concat(F.slice(ws, 2, F.greatest(n - 1, F.lit(0))), tail)
    if predict:
        prevs = F.transform(prevs, lambda x: F.when(x == "", F.lit(MISSING)).otherwise(x))
        nexts = F.transform(nexts, lambda x: F.when(x == "", F.lit(MISSING)).otherwise(x))
    return F.arrays_zip(ws.alias("word"), prevs.alias("prev_word"), nexts.alias("next_word"))


def _explode_with_neighbours(df: DataFrame, keep: list, ws: str = "ws", first_prev: Column | None = None,
                             last_next: Column | None = None, predict: bool = False) -> DataFrame:
    """One row per array element with its neighbours read from the same array.

    ``posexplode_outer`` (not ``posexplode``) keeps Catalyst from inferring a
    ``size(ws) > 0`` filter that would evaluate the split a second time; empty
    and null words are filtered after the explode instead.
    """
    e = df.select(*keep, ws, *([c for c in ("prev_last", "next_first") if c in df.columns]),
                  F.posexplode_outer(ws).alias("pos", "word"))
    pos = F.col("pos")
    prev = F.get(F.col(ws), pos - 1)
    nxt = F.get(F.col(ws), pos + 1)
    if predict:
        prev = F.when(prev == "", F.lit(MISSING)).otherwise(prev)
        nxt = F.when(nxt == "", F.lit(MISSING)).otherwise(nxt)
    prev = F.coalesce(prev, *([first_prev] if first_prev is not None else []), F.lit(MISSING))
    nxt = F.coalesce(nxt, *([last_next] if last_next is not None else []), F.lit(MISSING))
    return e.select(*keep, "pos", "word", prev.alias("prev_word"), nxt.alias("next_word"))


def words_with_context(df: DataFrame, key: str, text_col: str = "text", keep: tuple[str, ...] = (),
                       predict: bool = False) -> DataFrame:
    """Prose rows -> ``(key, *keep, pos INT, word, prev_word, next_word)``.

    ``pos`` is the 0-based word index inside the row; context is ``_`` at both
    ends of the row.  Blank texts yield no words.
    """
    x = df.select(key, *keep, split_words(F.col(text_col)).alias("ws"))
    return _explode_with_neighbours(x, [key, *keep], predict=predict).filter(F.col("word") != "")


def words_from_documents(docs: DataFrame, predict: bool = False) -> DataFrame:
    """``documents`` -> ``(doc_id, lang, pos, word, prev_word, next_word)``."""
    return words_with_context(docs, "doc_id", keep=("lang",), predict=predict)


def words_from_turns(conv: DataFrame, predict: bool = False) -> DataFrame:
    """``conversations`` -> words with context running across the turns of a conversation.

    The previous turn's last word and the next turn's first word come from
    equi-joins of one narrow row per turn on ``(conv_id, turn -/+ 1)``: unique
    keys, so the joins stay parallel however long a conversation is (a window
    over the conversation would put a hot conversation in one task).  A
    missing or blank neighbouring turn is a context boundary (``_``).
    """
    t = conv.select("conv_id", "turn", split_words(F.col("text")).alias("ws"))
    t = t.withColumn("ws", F.filter("ws", lambda x: x != ""))
    ends = t.filter(F.size("ws") > 0).select(
        "conv_id", "turn", F.get("ws", 0).alias("first_w"), F.get("ws", F.size("ws") - 1).alias("last_w"))
    prev = ends.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("last_w").alias("prev_last"))
    nxt = ends.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("first_w").alias("next_first"))
    j = (t.filter(F.size("ws") > 0)
         .join(prev, ["conv_id", "turn"], "left")
         .join(nxt, ["conv_id", "turn"], "left"))
    e = _explode_with_neighbours(j, ["conv_id", "turn"], first_prev=F.col("prev_last"),
                                 last_next=F.col("next_first"), predict=predict)
    return e.filter(F.col("word") != "")


def words_from_lines(spark: SparkSession, paths, predict: bool = True, one_document: bool = False) -> DataFrame:
    """Word-per-line files (S1) -> ``(file, pos, word, prev_word, next_word)``.

    A file splits across tasks (``lines.ordered_lines``).  Empty lines inside
    stay as empty words; ``predict`` context maps them to ``_``.
    """
    from .lines import ordered_lines
    x = ordered_lines(spark, paths, one_document)

    def context(c: str) -> Column:
        near = F.coalesce(c, F.lit(MISSING))
        return F.when(near == "", F.lit(MISSING)).otherwise(near) if predict else near

    return x.select("file", "pos", F.col("value").alias("word"), context("prev").alias("prev_word"), context("next").alias("next_word"))


def words_from_input(df: DataFrame, key: str, text_col: str = "text", keep: tuple[str, ...] = (), predict: bool = True) -> DataFrame:
    """Strings handed in (S2), a row each -> words with context; a string without a line feed is one word."""
    x = df.select(key, *keep, split_input(F.col(text_col)).alias("ws"))
    return _explode_with_neighbours(x, [key, *keep], predict=predict).filter(F.col("word") != "")
