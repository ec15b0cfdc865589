"""Column functions over pipe-segmented strings (``a|b|c``).

All are built-in expressions (regex replace, substring, split) so they run
inside whole-stage codegen; none needs a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PIPE = "|"
_MARK = "\u0001"


def unpiped(seg: Column) -> Column:
    """The word a segmentation spells: pipes removed (the literal ``|`` word stays)."""
    return F.when(seg == PIPE, F.lit(PIPE)).otherwise(F.regexp_replace(seg, r"\|", ""))


def boundary_bits(seg: Column) -> Column:
    """Segmentation -> string of '0'/'1', one per character, '1' = boundary follows.

    ``ab|c`` -> ``010``; the literal word ``|`` -> ``0``.  The last character
    is always '0' for a well-formed segmentation.
    """
    marked = F.regexp_replace(seg, r"(?s)[^|]\|", _MARK)
    zeros = F.regexp_replace(marked, "(?s)[^" + _MARK + "]", "0")
    return F.when(seg.contains(PIPE), F.regexp_replace(zeros, _MARK, "1")).otherwise(F.repeat(F.lit("0"), F.length(seg)))


def bit_at(bits: Column, idx: Column) -> Column:
    """0-based bit of a bit string as INT."""
    return F.substring(bits, idx + 1, 1).cast("int")


def segments(seg: Column) -> Column:
    """Segmentation -> array of segments; the literal ``|`` word stays whole."""
    return F.when(seg == PIPE, F.array(F.lit(PIPE))).otherwise(F.split(seg, r"\|"))


def bits_to_seg(word: Column, bits: Column, sep: str = PIPE) -> Column:
    """Inverse of ``boundary_bits``: put ``sep`` after every char flagged '1'."""
    n = F.length(word)
    return F.when(n == 0, word).otherwise(
        F.array_join(
            F.transform(
                F.sequence(F.lit(1), n),
                lambda k: F.concat(
                    F.substring(word, k, 1),
                    F.when((F.substring(bits, k, 1) == "1") & (k < n), F.lit(sep)).otherwise(F.lit("")),
                ),
            ),
            "",
        )
    )


def malformed(seg: Column) -> Column:
    """Reason a segmentation is unusable, or NULL.

    Leading or trailing pipe on a multi-char row, or doubled pipes.
    """
    s = F.trim(seg)
    multi = F.length(s) > 1
    return (
        F.when(multi & s.startswith(PIPE), F.lit("leading_pipe"))
        .when(multi & s.endswith(PIPE), F.lit("trailing_pipe"))
        .when(s.contains("||"), F.lit("double_pipe"))
    )


def aligned(word: Column, seg: Column) -> Column:
    """Row passes the alignment check (word spelled by seg, well formed)."""
    ok_len = F.length(word) == F.length(F.regexp_replace(seg, r"\|", ""))
    pipe_word = (word == PIPE) & (seg == PIPE)
    return (pipe_word | ((word != PIPE) & ok_len & malformed(seg).isNull()))
