"""Silver segmentations for the Latin-script fixture corpus.

The fixtures carry no gold segmentations, so a deterministic affix rule makes
them: an alphabetic word (``^[a-z]+$`` after lower-casing) loses a suffix
``ing|tion|ed|ly`` and a prefix ``re|un|in`` as long as a stem of at least
three letters remains; cuts are placed at the same offsets in the original
spelling.  A word ending in one punctuation mark (``,.;:!?``) after a run of
other characters is cut before the mark, as the fixture rule set does, and
is not cut further.  Everything else is one segment.  ``drop_suffix`` removes one
suffix from the rule, which yields a second, slightly wrong segmentation
used as "predictions" when checking the evaluator.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SUFFIXES = ("ing", "tion", "ed", "ly")
PREFIXES = ("re", "un", "in")
MIN_STEM = 3
PUNCT = ",.;:!?"
PUNCT_SPLIT = "^([^|,.;:!?]+)([,.;:!?])$"


def _affix_cut(suffixes, prefixes) -> str:
    """Prefix, stem and suffix of an alphabetic word, the suffix taken first: groups 1 or 6, 2 or 4 or 7, 3 or 5."""
    pre, suf, stem = f"({'|'.join(prefixes)})", f"({'|'.join(suffixes)})", f"(.{{{MIN_STEM},}})"
    alpha = r"(?=[a-z\u212a]+$)"  # the Kelvin sign is a k in lower case
    return rf"(?is)\A{alpha}(?:{pre}{stem}{suf}|{stem}{suf}|{pre}{stem})\z"


def silver_seg(word: Column, suffixes=SUFFIXES, prefixes=PREFIXES) -> Column:
    """The affix rule, one regular expression a word; no suffix may end another one, no prefix begin another."""
    # pipes at the ends are those of missing affixes, as words with pipes of their own are not cut
    cut = F.trim(F.regexp_replace(word, _affix_cut(suffixes, prefixes), "$1$6|$2$4$7|$3$5"), F.lit("|"))
    lw = F.lower(word)
    marked = reduce(or_, [word.contains(m) for m in PUNCT])
    affixed = reduce(or_, [lw.endswith(s) for s in suffixes] + [lw.startswith(p) for p in prefixes])  # most words need no expression
    return (F.when(word.contains("|"), word)
            .when(marked, F.regexp_replace(word, PUNCT_SPLIT, "$1|$2"))
            .when(affixed, cut).otherwise(word))


def with_silver(words: DataFrame, col: str = "seg", drop_suffix: str | None = None) -> DataFrame:
    sufs = tuple(s for s in SUFFIXES if s != drop_suffix)
    return words.withColumn(col, silver_seg(F.col("word"), sufs))
