"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies.

DataFrame functions only, in each document's own row, no shuffle. Words are
runs of letters and digits in lower case; a shingle is five words, as one 64-bit hash.

*Windows.* A document's shingles are cut into tiles; a window is two neighbouring
tiles, windows overlap by a tile. A template is matched in the size class whose
tile its length fits: ``words`` (below five words, which make no shingle: runs of the
document's words are compared with the whole template), ``tiny`` (up to 4 shingles: tiles of one shingle, so a window's
sketch is the shingle itself), ``short`` (tiles of 8), ``long`` (tiles of 64, whose
sketches are minima over the short tiles' sketches). Templates of over 128 shingles are cut into parts; a rest
of over 4 shingles is a part of its own, for a smaller one the last 128 shingles are.

*Bands.* ``BANDS`` bands of one row each. Row k's order is "smallest hash xor mask k": for
random hashes each element of a union is as likely to be the smallest. The masks
are spread over all 64 bits, each with first bits of its own (``_spread``), so that bands look for their minima
in different parts of the hash space: they meet more of a set's elements than independent orders would.
At the containment threshold a window shares at least 4 of 5 shingles (short: similarity 4/17) or 25 of 33
(long: 25/136); independent bands would collide with probability 1 - (1 - 4/17)^24 = 0.998 and
1 - (1 - 25/136)^24 = 0.992, and spread ones were measured no lower (the seeded recall test does it again).
A tiny template collides surely.

*Verification.* For retrieved templates the share of template shingles
within the window, widened by a template's length on both sides, must reach ``containment``.
``first_shingle`` is where the window begins, not the first shingle that matches.

Defined results: null and empty texts match nothing, texts below five words only ``words`` templates,
whose ``first_shingle`` is the run's first word; a template without words matches nothing;
repeated rows are scanned each; any number of licenses may match a row; of equal windows the first is the best.
A very long text is scanned whole, in work that grows with its length. An input column named like the result is replaced;
other columns pass through, names that begin with two underscores apart.
"""

from __future__ import annotations

import random
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = 24
TILE, LONG = 8, 8  # shingles in a short tile; short tiles in a long one
TINY_MOST, SHORT_MOST, PART = 4, 32, 128
CONTAINMENT = 0.75
SPLIT = r"[^a-z0-9\u0080-\x{10FFFF}]+"


def _spread(n: int, seed: int = 20240607) -> list[int]:
    """``n`` masks of 64 bits (as signed numbers): the first bits count up in reversed binary, the rest is random."""
    rng, k = random.Random(seed), max(n - 1, 1).bit_length()
    head = [int(f"{i:0{k}b}"[::-1], 2) for i in range(n)]
    masks = [(h << (64 - k)) | rng.getrandbits(64 - k) for h in head]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


MASKS = _spread(BANDS)

#: notices and usual opening paragraphs of public licenses (fixed values)
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("All-Rights-Reserved", "All rights reserved."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0"),
    ("CC-BY-NC-4.0", "SPDX-License-Identifier: CC-BY-NC-4.0"),
    ("CC-BY-4.0", "SPDX-License-Identifier: CC-BY-4.0"),
    ("CC-BY-SA-4.0", "SPDX-License-Identifier: CC-BY-SA-4.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("MPL-2.0", "SPDX-License-Identifier: MPL-2.0"),
)


def _once(value: Column) -> Column:
    """The value itself, behind a generator: filters that a caller puts on results then don't copy the whole expression below."""
    return F.explode_outer(F.array(value))


def word_hashes(text: Column) -> Column:
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), SPLIT), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    """Hashes of all runs of five words, in order; shorter texts have none."""
    # the array is bound once, so that its words aren't split again for each shingle
    return F.flatten(
        F.transform(
            F.array(hashes),
            lambda h: F.when(F.size(h) >= 5, F.transform(F.sequence(F.lit(1), F.size(h) - 4), lambda i: F.xxhash64(F.slice(h, i, 5)))).otherwise(F.array().cast("array<bigint>")),
        )
    )


@dataclass(frozen=True)
class Template:
    number: int
    license: str
    grams: tuple[int, ...]
    #: word hashes of a template below five words, which has no shingle
    words: tuple[int, ...] = ()

    @property
    def kind(self) -> str:
        n = len(self.grams)
        return "words" if self.words else "tiny" if n <= TINY_MOST else "short" if n <= SHORT_MOST else "long"

    @property
    def keys(self) -> list[int]:
        """Values that a window's sketch must share one of."""
        return list(self.grams) if self.kind == "tiny" else [min(g ^ m for g in self.grams) for m in MASKS]


def load_templates(spark: SparkSession, templates) -> list[Template]:
    """Template parts with the shingles that documents get; templates are a parameter, some hundreds of short texts."""
    rows = spark.createDataFrame([(i, lic, t) for i, (lic, t) in enumerate(templates)], "n int, license string, text string")
    out = []
    hashes = rows.select("n", "license", _once(word_hashes(F.col("text"))).alias("h"))
    for r in hashes.select("n", "license", "h", shingles(F.col("h")).alias("s")).orderBy("n").collect():
        grams = r["s"]
        if r["h"] and not grams:
            out.append(Template(len(out), r["license"], (), tuple(r["h"])))
        for lo in range(0, len(grams), PART):
            # a rest of few shingles would be met by chance: the last PART ones stand for it
            lo = lo if lo == 0 or len(grams) - lo > TINY_MOST else len(grams) - PART
            out.append(Template(len(out), r["license"], tuple(dict.fromkeys(grams[lo : lo + PART]))))
    return out


def _longs(values) -> Column:
    return F.array(*[F.lit(int(v)).cast("bigint") for v in values]) if values else F.array().cast("array<bigint>")


def _sketch(tile: Column) -> Column:
    """The smallest hash of a tile in each of the orders; one small expression over the masks, not one for each mask."""
    return F.transform(_longs(MASKS), lambda mask: F.array_min(F.transform(tile, lambda x: x.bitwiseXOR(mask))))


def _pairwise_least(tiles: Column) -> Column:
    """Sketches of windows: element-wise minima of each tile and the next; the last tile stands alone."""
    return F.transform(tiles, lambda t, i: F.when(F.get(tiles, i + 1).isNull(), t).otherwise(F.zip_with(t, F.get(tiles, i + 1), lambda a, b: F.least(a, b))))


def _sketches(windows: Column, kind: str):
    """What gives a window's sketch by its place; a tiny window is a shingle, which is its own sketch."""
    return (lambda i: F.array(F.get(windows, i))) if kind == "tiny" else (lambda i: F.get(windows, i))


def _retrieved(places: Column, windows: Column, keys: set[int], tiny: bool) -> Column:
    """Places of windows that share a band with some template."""
    known = sorted(keys)
    if tiny:
        hit = F.filter(places, lambda i: F.get(windows, i).isin(*known))
        return F.when(F.arrays_overlap(windows, _longs(known)), hit).otherwise(F.array().cast("array<int>"))
    return F.filter(places, lambda i: F.exists(F.get(windows, i), lambda v: v.isin(*known)))


def scan_licenses(docs: DataFrame, templates=TEMPLATES, text_col: str = "text", out_col: str = "licenses", containment: float = CONTAINMENT, retrieve: bool = True) -> DataFrame:
    """``docs`` plus ``out_col``: array of (license, template, first_shingle, containment), the best window of each template.

    ``retrieve=False`` verifies every window against every template (tests only).
    """
    spark = docs.sparkSession
    parts = load_templates(spark, templates)
    by = {k: [t for t in parts if t.kind == k] for k in ("words", "tiny", "short", "long")}
    own = [F.col(f"`{c}`") for c in docs.columns if c != out_col]
    kind = "array<struct<license:string,template:int,first_shingle:int,containment:double>>"
    df = docs.select(*own, _once(word_hashes(F.col(f"`{text_col}`"))).alias("__h"))
    df = df.select("*", _once(shingles(F.col("__h"))).alias("__s"))
    s = F.col("__s")

    tile_count = F.ceil(F.size(s) / TILE).cast("int")
    tiles = F.when(
        F.size(s) > 0,
        F.transform(F.sequence(F.lit(0), tile_count - 1), lambda i: F.transform(F.array(F.slice(s, i * TILE + 1, TILE)), _sketch)[0]),
    ).otherwise(F.array().cast("array<array<bigint>>"))
    df = df.select("*", tiles.alias("__t1"))
    t1 = F.col("__t1")
    if by["long"]:
        # minima over LONG short tiles, a row of the sketch at a time
        longs = F.when(
            F.size(t1) > 0,
            F.transform(
                F.sequence(F.lit(0), F.ceil(F.size(t1) / LONG).cast("int") - 1),
                lambda i: F.transform(F.array(F.slice(t1, i * LONG + 1, LONG)), lambda g: F.aggregate(g, g[0], lambda acc, t: F.zip_with(acc, t, lambda a, b: F.least(a, b))))[0],
            ),
        ).otherwise(F.array().cast("array<array<bigint>>"))
        df = df.select("*", longs.alias("__t2"))
    df = df.select("*", _pairwise_least(t1).alias("__w1"), *([_pairwise_least(F.col("__t2")).alias("__w2")] if by["long"] else []))

    def verified(windows: Column, sketch_of, width: int, group: list[Template]) -> Column:
        """Structs for (window, template) pairs that share a key and hold enough shingles."""
        tables = F.array(*[F.struct(F.lit(t.license).alias("license"), F.lit(t.number).alias("template"), _longs(t.grams).alias("grams"), _longs(t.keys).alias("keys")) for t in group])

        def of_window(i: Column) -> Column:
            def of_template(t: Column) -> Column:
                n = F.size(t["grams"])
                first = F.greatest(F.lit(0), i * width - n)
                region = F.slice(s, first + 1, 2 * width + 2 * n)
                share = F.size(F.array_intersect(t["grams"], region)).cast("double") / n
                return F.struct(t["license"].alias("license"), t["template"].alias("template"), (i * width).cast("int").alias("first_shingle"), share.alias("containment"))

            met = F.filter(tables, lambda t: F.arrays_overlap(t["keys"], sketch_of(i))) if retrieve else tables
            return F.filter(F.transform(met, of_template), lambda r: r["containment"] >= containment)

        return F.flatten(F.transform(windows, of_window))

    found = []
    if by["words"]:
        h, firsts = F.col("__h"), sorted({t.words[0] for t in by["words"]})
        runs = F.array(*[F.struct(F.lit(t.license).alias("license"), F.lit(t.number).alias("template"), _longs(t.words).alias("words")) for t in by["words"]])
        starts = F.when(F.arrays_overlap(h, _longs(firsts)), F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: F.get(h, i).isin(*firsts))).otherwise(F.array().cast("array<int>"))

        def of_start(i: Column) -> Column:
            met = F.filter(runs, lambda t: F.slice(h, i + 1, F.size(t["words"])) == t["words"])
            return F.transform(met, lambda t: F.struct(t["license"].alias("license"), t["template"].alias("template"), i.cast("int").alias("first_shingle"), F.lit(1.0).alias("containment")))

        found.append(F.flatten(F.transform(starts, of_start)))
    for name, windows, width in (("tiny", s, 1), ("short", F.col("__w1"), TILE), ("long", F.col("__w2"), TILE * LONG)):
        group = by[name]
        if not group:
            continue
        keys = {k for t in group for k in t.keys}
        places = F.when(F.size(windows) > 0, F.sequence(F.lit(0), F.size(windows) - 1)).otherwise(F.array().cast("array<int>"))
        found.append(verified(_retrieved(places, windows, keys, name == "tiny") if retrieve else places, _sketches(windows, name), width, group))
    df = df.select(*own, (F.concat(*found) if found else F.array()).cast(kind).alias("__found"))


    def best(template: Column) -> Column:
        """The best window of a template, the first of equals."""
        mine = F.filter("__found", lambda r: r["template"] == template)
        return F.array_min(F.transform(mine, lambda r: F.struct((-r["containment"]).alias("less"), r["first_shingle"].alias("at"), r.alias("hit"))))["hit"]

    # one pass over the windows for each template found
    numbers = F.array_distinct(F.transform("__found", lambda r: r["template"]))
    return df.select(*own, _once(F.array_sort(F.transform(numbers, best))).alias(out_col))
