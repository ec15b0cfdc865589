"""Secret scans: fixed key patterns plus sliding-window entropy, in DataFrame functions only.

Per document, in its own row, with no shuffle:

* *fixed kinds* ``assign``, ``access`` and ``hex``: leftmost non-overlapping
  matches; positions come from the lengths of the pieces between matches;
* *entropy*: every run of ``[A-Za-z0-9+/_=-]`` of at least ``window``
  characters that holds a digit is a candidate. Its character class (lower
  hex, upper hex, digits, mixed) sets the threshold. A window slides over the
  candidate; the sum of ``c*log2(c)`` over its character counts is updated from
  the counts of the character that leaves and the one that enters, so a window
  costs O(window) string work and never a new histogram. A candidate with one
  window at or above the threshold is reported whole, unless an allow-list
  pattern matches it or a fixed span already covers it.

Defined results: null or empty text has no span; any number of spans, ties and
repeated rows are kept row by row (a row never looks at another); extra input
columns pass through ``scan_secrets`` and can't clash (results sit in one struct column
whose name is chosen by the caller).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
WINDOW = 20
#: bits per character that a window of a class must reach
THRESHOLDS = {"hex": 3.0, "mixed": 3.9}
#: candidates that are no secrets: identifiers, paths, numbers, runs, words with a number
ALLOW = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9_=+/-]+$",
    r"(?i)example|placeholder|changeme|abcdefghij|0123456789|xxxxxx",
    r"^/?([a-z0-9]{1,15}[/_=-])+[a-z0-9]{0,15}$",
    r"^[A-Za-z]+[-_=+/]?[0-9]{1,4}$",
)
KINDS = ("assign", "access", "hex", "entropy")


def _hits(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _located(text: Column, hits: Column, pattern: str, kind: int) -> Column:
    """Structs (start, end, kind, hit) of the matches, in code points."""
    pieces = F.split(text, pattern, -1)
    empty = F.array().cast("array<struct<start:bigint,end:bigint,kind:int,hit:string>>")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["piece"]).cast("bigint")
        end = start + F.length(x["hit"]).cast("bigint")
        span = F.struct(start.alias("start"), end.alias("end"), F.lit(kind).alias("kind"), x["hit"].alias("hit"))
        return F.struct(end.alias("at"), F.array_append(acc["out"], span).alias("out"))

    pairs = F.arrays_zip(F.slice(pieces, 1, F.size(hits)).alias("piece"), hits.alias("hit"))
    found = F.aggregate(pairs, F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out")), step, lambda a: a["out"])
    return F.when(F.size(hits) > 0, found).otherwise(empty)


def _xlog(c: Column) -> Column:
    return F.when(c > 1, c * F.log2(c)).otherwise(F.lit(0.0))


def max_window_entropy(s: Column, window: int = WINDOW) -> Column:
    """Largest Shannon entropy (bits) of any ``window`` characters of s, from incremental counts; null if s is shorter."""
    count = lambda win, ch: (F.length(win) - F.length(F.replace(win, ch, F.lit("")))).cast("double")
    start = F.struct(F.lit("").alias("win"), F.lit(0.0).alias("sum"), F.lit(window).cast("double").alias("least"))

    def step(acc: Column, ch: Column) -> Column:
        # what the leaving character takes from the sum
        full = F.length(acc["win"]) == window
        out = F.substring(acc["win"], 1, 1)
        c_out = count(acc["win"], out)
        kept = F.struct(
            F.when(full, F.substring(acc["win"], 2, window)).otherwise(acc["win"]).alias("win"),
            F.when(full, acc["sum"] - _xlog(c_out) + _xlog(c_out - 1)).otherwise(acc["sum"]).alias("sum"),
            acc["least"].alias("least"),
        )

        # what the entering character adds
        def enter(k: Column) -> Column:
            c_in = count(k["win"], ch)
            total = k["sum"] + _xlog(c_in + 1) - _xlog(c_in)
            done = F.length(k["win"]) == window - 1
            return F.struct(
                F.concat(k["win"], ch).alias("win"),
                total.alias("sum"),
                F.when(done, F.least(k["least"], total / window)).otherwise(k["least"]).alias("least"),
            )

        return F.get(F.transform(F.array(kept), enter), F.lit(0))

    best = F.aggregate(F.split(s, ""), start, step, lambda a: F.lit(math.log2(window)) - a["least"])
    return F.when(F.length(s) >= window, best)


def _has_entropy(s: Column, window: int, thresholds: dict[str, float], allow: tuple[str, ...]) -> Column:
    ok = s.rlike("[0-9]")
    for pattern in allow:
        ok &= ~s.rlike(pattern)
    limit = F.when(s.rlike("^([0-9a-f]+|[0-9A-F]+)$"), F.lit(thresholds["hex"])).otherwise(F.lit(thresholds["mixed"]))
    # rounded, so that a sum's last bits decide no tie
    return F.when(ok, F.round(max_window_entropy(s, window), 9) >= limit).otherwise(F.lit(False))


def scan_secrets(
    docs: DataFrame,
    text_col: str = "text",
    out_col: str = "secret_spans",
    window: int = WINDOW,
    thresholds: dict[str, float] = THRESHOLDS,
    allow: tuple[str, ...] = ALLOW,
) -> DataFrame:
    """``docs`` plus ``out_col``: array of (start, end, kind) in code points, end exclusive, by start and kind (0..3 of ``KINDS``)."""
    own = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    t = "__secret_text"
    df = docs.select(*own, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias(t))
    text = F.col(t)
    wide = CANDIDATE % window
    df = df.select(
        "*",
        _hits(text, ASSIGN).alias("__h0"),
        _hits(text, ACCESS).alias("__h1"),
        _hits(text, HEX).alias("__h2"),
        F.when(text.rlike(wide), _hits(text, wide)).otherwise(F.array().cast("array<string>")).alias("__h3"),
    )
    df = df.select("*", F.exists("__h3", lambda s: _has_entropy(s, window, thresholds, allow)).alias("__any3"))
    size = {
        0: lambda x: F.length(F.regexp_extract(x["hit"], "^" + ASSIGN + "$", 1)) >= 12,
        1: lambda x: F.length(x["hit"]) >= 18,
        2: lambda x: F.length(x["hit"]) >= 16,
    }
    fixed = F.concat(*(F.filter(_located(text, F.col(f"__h{k}"), p, k), size[k]) for k, p in enumerate((ASSIGN, ACCESS, HEX))))
    df = df.select("*", fixed.alias("__fixed"))
    more = F.filter(
        _located(text, F.col("__h3"), wide, 3),
        lambda x: _has_entropy(x["hit"], window, thresholds, allow)
        & ~F.exists("__fixed", lambda b: (b["start"] <= x["start"]) & (b["end"] >= x["end"])),
    )
    spans = F.when(F.col("__any3"), F.concat("__fixed", more)).otherwise(F.col("__fixed"))
    bare = F.transform(spans, lambda x: F.struct(x["start"].alias("start"), x["kind"].alias("kind"), x["end"].alias("end")))
    return df.select(*own, F.array_sort(bare).alias(out_col))


def span_text(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", **kw) -> DataFrame:
    """``docs`` with every span of ``scan_secrets`` replaced by ``mark`` (overlapping spans make one mark); other rows stay as they are."""
    s = "__secret_spans"
    text = F.col(f"`{text_col}`")
    found = scan_secrets(docs, text_col, s, **kw)
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        before = F.when(
            x["start"] >= acc["at"],
            F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mark)),
        ).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), before.alias("out"))

    rest = F.aggregate(s, start, step, lambda a: F.concat(a["out"], F.substring(text, (a["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    clean = F.when(F.size(s) > 0, rest).otherwise(text)
    return found.select(*((clean if c == text_col else F.col(f"`{c}`")).alias(c) for c in docs.columns))
