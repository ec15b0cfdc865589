"""Rule expressions built from a ``SegConfig``.

Rules are literals, so each becomes a short chain of codegen'd comparisons
(``IN`` lists, ``rlike``, ``regexp_replace``) folded into the surrounding
projection; nothing is joined or broadcast.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import SegConfig, anchored, java_replacement


def is_vowel(ch: Column, cfg: SegConfig) -> Column:
    """1 if ``ch`` is in the vowel class, else 0."""
    if not cfg.vowels:
        return F.lit(0)
    return ch.isin(list(cfg.vowels)).cast("int")


def letter(ch: Column, cfg: SegConfig) -> Column:
    """Raw letter, or ``_`` for letters outside ``base_letters`` when asked."""
    if cfg.map_oov_letters and cfg.base_letters:
        return F.when(ch.isin(list(cfg.base_letters)), ch).otherwise(F.lit("_"))
    return ch


def split_allowed(idx: Column, length: Column, ch: Column, next_ch: Column, cfg: SegConfig) -> Column:
    """Positional rule: may a boundary follow character ``idx``?

    Permitted iff the char is listed for position ``idx`` counted from the
    start, or the next char is listed for position ``-(L-idx-1)`` counted from
    the end.  ``allowed=None`` means unconstrained; ``{}`` forbids all splits.
    """
    if cfg.allowed is None:
        return F.lit(True)
    if not cfg.allowed:
        return F.lit(False)
    neg = -(length - idx - 1)
    conds = []
    for pos, chars in sorted(cfg.allowed.items()):
        if pos >= 0:
            conds.append((idx == pos) & ch.isin(list(chars)))
        else:
            conds.append((neg == pos) & next_ch.isin(list(chars)))
    return reduce(lambda a, b: a | b, conds)


def rule_tokenised(word: Column, cfg: SegConfig) -> Column:
    """Words that never reach the model: length 1, or a regex rule matches at the start."""
    cond = F.length(word) == 1
    for pat, _ in cfg.regex_tok:
        cond = cond | word.rlike(anchored(pat))
    return cond


def apply_regex_tok(word: Column, cfg: SegConfig, sep: str = "|") -> Column:
    """Apply every substitution in order (as the rule path does) and honour ``sep``."""
    out = word
    for pat, rep in cfg.regex_tok:
        out = F.regexp_replace(out, pat, java_replacement(rep))
    if sep != "|":
        out = F.regexp_replace(out, r"\|", sep.replace("\\", "\\\\").replace("$", "\\$"))
    return out


def collapse_tag(tag: Column, cfg: SegConfig) -> Column:
    """POS class collapse: mapped tag if listed, else the tag itself."""
    if not cfg.pos_classes:
        return tag
    expr = None
    for src, tgt in sorted(cfg.pos_classes.items()):
        expr = (F.when(tag == src, F.lit(tgt)) if expr is None
                else expr.when(tag == src, F.lit(tgt)))
    return expr.otherwise(tag)


def rare_tag(tag: Column, known: list[str] | None, rare: str) -> Column:
    """Replace tags outside ``known`` by the ``rare`` tag (B13); no-op without a known set."""
    if not known:
        return tag
    return F.when(tag.isin(list(known)), tag).otherwise(F.lit(rare))
