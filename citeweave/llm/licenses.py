"""Licence scan: lines, whole texts and windows of words next to licence templates, by the Dice coefficient of word bigrams.

A text is lower-cased and everything but letters a-z, digits and line ends becomes one space. Its units are its lines and, where it has more
than one line with words, the whole. A unit matches a template when 2 * common / (own + template's) distinct word bigrams reach the
threshold. That needs sizes within a factor of (2 - t) / t of each other, so a unit meets only the templates whose size
bounds it lies in; most lines and nearly all whole texts meet none.

Notices that are wrapped over lines or stand among other words, further notices (``NOTICES``) and full licence texts
(``texts/``) are found in windows of consecutive words, whatever the lines. A match needs t / (2 - t) of the template's
bigrams, so a text that has fewer of them is done. Otherwise windows open where a run of the template's bigrams opens
and close where one closes (a window's Dice never falls by such a bigram more), and are at most (2 - t) / t times as long as the
template. A short template meets all of them; a full text meets, for each opening, the one in which most bigrams are
its own. Of windows that overlap, the one with most common bigrams counts, then the higher Dice. A window counts
beside a matched line it overlaps only with another licence and more common bigrams;
beside a matched whole only with another licence. Everything stays in the row: no shuffle, no Python.

Defined results: a null or empty text has no units and no match; a unit of one word has no bigrams and never matches;
repeated lines count each, and so do windows apart; ties between templates go to the first by name; a null ``doc_id`` stays null; other columns
are ignored."""

from __future__ import annotations

import math
from pathlib import Path

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import let

THRESHOLD = 0.8
#: Templates of more bigrams are full texts.
SHORT = 64

# The names of licences and the wording of their notices.
TEMPLATES = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    ),
    "CC-BY-4.0": ("This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0."),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",),
}

# Notices that windows meet besides.
NOTICES = {
    "AGPL-3.0": (
        "Licensed under the GNU Affero General Public License, version 3.",
        "This work is licensed under the GNU Affero General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.",),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.",),
    "CC0-1.0": ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "GPL-2.0": (
        "Licensed under the GNU General Public License, version 2.",
        "This work is licensed under the GNU General Public License, version 2.",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    ),
    "GPL-3.0": ("Licensed under the GNU General Public License, version 3.",),
    "LGPL-2.1": (
        "Licensed under the GNU Lesser General Public License, version 2.1.",
        "This work is licensed under the GNU Lesser General Public License, version 2.1.",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "LGPL-3.0": (
        "Licensed under the GNU Lesser General Public License, version 3.",
        "This work is licensed under the GNU Lesser General Public License, version 3.",
        "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "ISC": ("Licensed under the ISC License.",),
    "MPL-2.0": ("Licensed under the Mozilla Public License, version 2.0.",),
}


def bigrams_of(text: str) -> list[str]:
    """The distinct word bigrams of a template, sorted."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def templates() -> list[tuple[str, list[str]]]:
    return [(name, bigrams_of(text)) for name, texts in sorted(TEMPLATES.items()) for text in texts]


def window_templates() -> list[tuple[str, int, list[str]]]:
    """Name, length in bigrams and distinct bigrams of what windows meet: the templates, the further notices and the full texts."""
    full = [(p.stem, p.read_text(encoding="utf-8")) for p in sorted((Path(__file__).parent / "texts").glob("*.txt"))]
    texts = [(n, t) for known in (TEMPLATES, NOTICES) for n, ts in known.items() for t in ts] + full
    return [(n, len("".join(c if c.isascii() and c.isalnum() else " " for c in t.lower()).split()) - 1, bigrams_of(t)) for n, t in sorted(texts)]


def bounds(size: int, threshold: float) -> tuple[float, float]:
    """Sizes of a unit that can reach the threshold with a template of the given size."""
    return size * threshold / (2 - threshold), size * (2 - threshold) / threshold


def _pairs(unit: Column) -> Column:
    """The word bigrams in order."""
    return let(F.split(unit, " "), lambda w: F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w)), lambda a, b: F.when(b.isNotNull(), F.concat(a, F.lit(" "), b))))


def _bigrams(unit: Column) -> Column:
    return F.array_distinct(_pairs(unit))


def _best(grams: Column, threshold: float) -> Column:
    """The best template for a set of bigrams as struct<dice, license, common>, or null."""
    size = F.size(grams)
    common_of = lambda s, top: F.round(top * (size + F.element_at(F.array(*(F.lit(len(w)) for _, w in templates())), F.array_position(s, top).cast("int"))) / 2).cast("int")
    scored = []
    for name, wanted in templates():
        low, high = bounds(len(wanted), threshold)
        common = F.size(F.array_intersect(grams, F.array(*map(F.lit, wanted))))
        dice = F.round(2.0 * common / (size + len(wanted)), 9)
        scored.append(F.when((size >= low) & (size <= high), dice).otherwise(F.lit(-1.0)))
    return let(
        F.array(*scored),
        lambda s: let(F.array_max(s), lambda top: F.when(top >= threshold, F.struct(top.alias("dice"), F.element_at(F.array(*(F.lit(n) for n, _ in templates())), F.array_position(s, top).cast("int")).alias("license"), common_of(s, top).alias("common")))),
    )


def _listed(grams: list[str]) -> str:
    """A SQL list of bigrams: thousands of them parse faster as text than they are made one by one."""
    return ", ".join(f"'{g}'" for g in grams)


WINDOWS = "array<struct<common:int,dice:double,license:string,start:int,end:int,window:boolean>>"


def _windows_of(name: str, length: int, wanted: list[str], threshold: float) -> Column:
    """Each opening's best window of the column ``pairs`` next to one template."""
    p = F.col("pairs")
    need, span = math.ceil(bounds(len(wanted), threshold)[0] - 1e-9), math.ceil(bounds(length, threshold)[1])
    literal = F.split(F.lit("\n".join(wanted)), "\n")

    def matched(s: Column, e: Column) -> Column:
        return let(
            F.slice(p, s["at"] + 1, e["at"] - s["at"] + 1),
            lambda x: let(
                F.size(F.array_intersect(x, literal)),
                lambda c: F.struct(
                    F.round(2.0 * c / (F.size(F.array_distinct(x)) + len(wanted)), 9).alias("dice"), c.alias("common"), (-s["at"]).alias("s"), e["at"].alias("e")
                ),
            ),
        )

    def from_opening(h: Column, s: Column) -> Column:
        ends = F.filter(F.slice(h, s["i"] + need, span), lambda e: e["closes"] & (e["at"] - s["at"] < span))
        if len(wanted) > SHORT:
            ends = let(ends, lambda es: F.slice(F.array_sort(es, lambda x, y: F.sign(_gain(s, y) - _gain(s, x)).cast("int")), 1, 1))
        return F.array_max(F.transform(ends, lambda e: matched(s, e)))

    def _gain(s: Column, e: Column) -> Column:
        return 2 * (e["i"] - s["i"]) - threshold * (e["at"] - s["at"])

    def hits() -> Column:
        at = F.expr(f"filter(transform(pairs, (g, i) -> CASE WHEN g IN ({_listed(wanted)}) THEN i END), i -> i IS NOT NULL)")
        return let(at, lambda a: F.transform(a, lambda q, i: F.struct(
            q.alias("at"), i.alias("i"), (~F.coalesce(F.get(a, i - 1) == q - 1, F.lit(False))).alias("opens"), (~F.coalesce(F.get(a, i + 1) == q + 1, F.lit(False))).alias("closes"),
            F.coalesce(F.get(a, i + need - 1) - q < span, F.lit(False)).alias("enough"))))

    found = let(hits(), lambda h: F.transform(F.filter(h, lambda s: s["opens"] & s["enough"]), lambda s: from_opening(h, s)))
    return F.transform(
        F.filter(found, lambda m: m["dice"] >= threshold),
        lambda m: F.struct(m["common"].alias("common"), m["dice"].alias("dice"), F.lit(name).alias("license"), (-m["s"]).alias("start"), m["e"].alias("end"), F.lit(True).alias("window")),
    ).cast(WINDOWS)


def _apart(windows: Column, lines: Column) -> Column:
    """The windows that count beside each other and beside matched lines, by common bigrams."""
    before = lambda x, y: (x["common"] > y["common"]) | ((x["common"] == y["common"]) & ((x["dice"] > y["dice"]) | ((x["dice"] == y["dice"]) & ((x["license"] < y["license"]) | ((x["license"] == y["license"]) & (x["start"] < y["start"]))))))
    ordered = F.array_sort(windows, lambda x, y: F.when(before(x, y), -1).when(before(y, x), 1).otherwise(0))
    meets = lambda t, w: (t["start"] <= w["end"]) & (w["start"] <= t["end"])
    beaten = lambda taken, w: F.exists(taken, lambda t: meets(t, w) & (t["common"] >= w["common"]))
    # A window around a smaller match of its own licence does not count again, but still holds its place against others.
    counted = lambda taken, w: ~F.exists(taken, lambda t: meets(t, w) & (t["license"] == w["license"]))
    placed = lambda taken, w: F.array_append(taken, w.withField("window", counted(taken, w)))
    chosen = F.aggregate(ordered, lines, lambda taken, w: F.when(beaten(taken, w), taken).otherwise(placed(taken, w)))
    return F.filter(chosen, lambda t: t["window"])


def _windows(threshold: float) -> Column:
    """Windows that match beside the units' matches, from the columns units, m (their matches), pairs and known (the text's distinct bigrams that any template has)."""
    known, units, matched = F.col("known"), F.col("units"), F.col("m")
    each = []
    for name, length, wanted in window_templates():
        need = math.ceil(bounds(len(wanted), threshold)[0] - 1e-9)
        has = F.size(F.array_intersect(known, F.split(F.lit("\n".join(wanted)), "\n"))) >= need
        each.append(F.when(F.when(F.size(known) >= need, has).otherwise(F.lit(False)), _windows_of(name, length, wanted, threshold)).otherwise(F.array().cast(WINDOWS)))
    # Where the lines lie among the words, and which licence they match.
    sizes = F.transform(units, lambda u: F.size(F.split(u, " ")))
    starts = let(sizes, lambda z: F.aggregate(z, F.array(F.lit(0)), lambda acc, n: F.array_append(acc, F.element_at(acc, -1) + n)))
    n_lines = F.when(F.size(units) > 1, F.size(units) - 1).otherwise(F.size(units))
    lines = let(starts, lambda at: F.filter(F.transform(F.slice(matched, 1, n_lines), lambda m, i: F.when(m.isNotNull(), F.struct(
        m["common"].alias("common"), m["dice"].alias("dice"), m["license"].alias("license"), F.get(at, i).alias("start"), (F.get(at, i + 1) - 2).alias("end"), F.lit(False).alias("window")))), lambda x: x.isNotNull()).cast(WINDOWS))
    whole = F.when(F.size(units) > 1, F.element_at(matched, -1)["license"])
    return let(F.concat(*each), lambda w: F.when(F.size(w) > 0, F.filter(_apart(w, lines), lambda t: ~F.coalesce(t["license"] == whole, F.lit(False)))).otherwise(w))


def scan(documents: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_units (lines, and the whole of several), n_matches (of units, and of windows besides), license (of the best match), dice, licenses (distinct, comma-joined)."""
    largest = max(bounds(len(w), threshold)[1] for _, w in templates())
    smallest = min(bounds(len(w), threshold)[0] for _, w in templates())
    least = min(math.ceil(bounds(len(w), threshold)[0] - 1e-9) for _, _, w in window_templates())
    plain = F.regexp_replace(F.lower(F.coalesce(F.col("text"), F.lit(""))), "[^a-z0-9\n]+", " ")
    lines = F.filter(F.transform(F.split(plain, "\n"), lambda u: F.trim(u)), lambda u: u != "")
    units = let(lines, lambda u: F.when(F.size(u) > 1, F.array_append(u, F.array_join(u, " "))).otherwise(u))
    rows = documents.select(F.col("doc_id").cast("long"), units.alias("units"))
    rows = rows.select("doc_id", "units", F.transform("units", _bigrams).alias("grams"))
    matched = F.transform("grams", lambda g: F.when((F.size(g) >= smallest) & (F.size(g) <= largest), _best(g, threshold)))
    known = F.expr(f"filter(get(grams, size(grams) - 1), g -> g IN ({_listed(sorted({g for _, _, w in window_templates() for g in w}))}))")
    rows = rows.select("doc_id", "units", matched.alias("m"), F.coalesce(known, F.array().cast("array<string>")).alias("known"))
    rows = rows.select("doc_id", "units", "m", "known", F.when(F.size("known") >= least, _pairs(F.element_at("units", -1))).alias("pairs"))
    windows = F.when(F.col("pairs").isNotNull(), _windows(threshold)).otherwise(F.array().cast(WINDOWS))
    matches = F.concat(F.transform(F.filter("m", lambda m: m.isNotNull()), lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license"))), F.transform(windows, lambda w: F.struct(w["dice"].alias("dice"), w["license"].alias("license"))))
    rows = rows.select("doc_id", F.size("units").cast("long").alias("n_units"), matches.alias("m"))
    first = F.get(F.array_sort("m", lambda a, b: F.when(a["dice"] != b["dice"], F.when(a["dice"] > b["dice"], -1).otherwise(1)).when(a["license"] < b["license"], -1).when(a["license"] > b["license"], 1).otherwise(0)), F.lit(0))
    rows = rows.select("doc_id", "n_units", "m", first.alias("first"))
    return rows.select(
        "doc_id", "n_units", F.size("m").cast("long").alias("n_matches"), F.col("first.license").alias("license"), F.col("first.dice").alias("dice"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("m", lambda m: m["license"]))), ",").alias("licenses"),
    )


def oracle(threshold: float = THRESHOLD) -> str:
    """The scan of units as DuckDB SQL: units and templates joined within the size bounds. It knows no windows."""
    values = ", ".join(f"({i}, '{name}', {wanted!r})" for i, (name, wanted) in enumerate(templates()))
    low, high = threshold / (2 - threshold), (2 - threshold) / threshold
    return f"""
WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(lower(coalesce(text, '')), '[^a-z0-9\\n]+', ' ', 'g'), chr(10)), lambda u: trim(u)), lambda u: u <> '') AS u FROM documents),
u AS (SELECT doc_id, CASE WHEN len(u) > 1 THEN list_append(u, array_to_string(u, ' ')) ELSE u END AS units FROM l),
e AS (SELECT doc_id, unnest(range(1, len(units) + 1)) AS i, units FROM u),
w AS (SELECT doc_id, i, string_split(units[i], ' ') AS w FROM e),
g AS (SELECT doc_id, i, list_distinct(list_transform(range(1, len(w)), lambda k: w[k] || ' ' || w[k + 1])) AS g FROM w WHERE len(w) > 1),
t(k, license, wanted) AS (VALUES {values}),
p AS (SELECT doc_id, i, license, k, round(2.0::DOUBLE * len(list_intersect(g, wanted)) / (len(g) + len(wanted)), 9) AS dice
      FROM g JOIN t ON len(g) >= {low!r} * len(wanted) AND len(g) <= {high!r} * len(wanted)),
m AS (SELECT doc_id, i, max(dice) AS dice, arg_min(license, (-dice, k)) AS license FROM p WHERE dice >= {threshold} GROUP BY doc_id, i),
d AS (SELECT doc_id, count(*) AS n_matches, arg_min(license, (-dice, license)) AS license, max(dice) AS dice, string_agg(DISTINCT license, ',' ORDER BY license) AS licenses FROM m GROUP BY doc_id)
SELECT u.doc_id, len(units)::BIGINT AS n_units, coalesce(n_matches, 0)::BIGINT AS n_matches, license, dice, coalesce(licenses, '') AS licenses FROM u LEFT JOIN d USING (doc_id)
"""
