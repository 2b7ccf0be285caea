"""Personal data by generated candidates and boosted trees, in DataFrame operations only.

Four base kinds come from patterns and checks (addresses, IPv4, cards by Luhn, phones by digit count) and always stand.
Around them high-recall generators propose further spans, which may overlap: runs of seven digits or more in any
grouping, and anything around an @. Each candidate gets small integer features of its format and of what stands beside
it. Whether a candidate overlaps a base span is the label; candidates with equal features fall into one cell, and Spark
counts cells and labels over all documents. The cell table is bounded by the product of the features' ranges
(``CELLS``), whatever the input, so the driver can grow the trees from it exactly: logistic boosting of trees of two
levels. A threshold is calibrated on the cells' counts from a held-out quarter of the documents: the lowest score from
which on precision stays at least ``PRECISION``. Candidates at or above it that overlap no base span are added. The
trees are compiled to expressions, so that scoring runs inside the scan.

All offsets are code points, ends exclusive. Every generator is a leftmost scan without backtracking over runs
(possessive, and starting only where a run starts or the last match ended), so a long text costs linear time in its
length; the offsets of one kind are summed along its matches, which is quadratic in the number of matches of one text.

Defined results: a null text counts as empty and has no spans; repeated rows are judged each; a null ``doc_id`` stays
null and its candidates count for training; other columns are carried through by ``redact``; an empty table or one
without candidates gets no trees and no added spans."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from ..functions.expr import let

PRECISION = 0.95
TREES = 24
RATE = 0.4

KINDS = ("email", "ip", "card", "phone", "number", "mail")

_LOCAL = "[A-Za-z0-9._%+-]"
_PART = "[A-Za-z0-9-]"
#: The base kinds. A run can only match from where it starts, or from where the last match ended.
PATTERNS = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@{_PART}++(?:\.{_PART}++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "number": r"(?:\G|(?<![0-9]))[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+",
    "mail": r"(?:\G|(?<=[\s@<>(),;:]))[^\s@<>(),;:]++@[^\s@<>(),;:]++",
}

#: Ranges of the features, in order: 0 <= value < range.
RANGES = {"mail": 2, "digits": 21, "groups": 6, "plus": 2, "paren": 2, "dots": 5, "luhn": 2, "context": 4, "glued_left": 2, "glued_right": 2}
CELLS = int(np.prod(list(RANGES.values())))


def matches(text: Column, kind: str) -> Column:
    """array<struct<start, end, m, before, after>>: the pattern's leftmost matches and what stands beside them."""
    pattern = F.lit(PATTERNS[kind])

    def placed(parts: Column, found: Column) -> Column:
        n = F.size(found)
        pairs = F.zip_with(F.slice(parts, 1, n), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        pairs = F.zip_with(pairs, F.slice(parts, 2, n), lambda p, after: F.struct(p["gap"].alias("gap"), p["m"].alias("m"), F.substring(after, 1, 1).alias("after")))
        row = "start int, end int, m string, before string, after string"
        return F.aggregate(
            pairs,
            F.struct(F.lit(0).alias("at"), F.array().cast(f"array<struct<{row.replace(' ', ':').replace(',:', ',')}>>").alias("out")),
            lambda acc, p: let(
                acc["at"] + F.length(p["gap"]),
                lambda start: F.struct(
                    (start + F.length(p["m"])).alias("at"),
                    F.array_append(acc["out"], F.struct(start.alias("start"), (start + F.length(p["m"])).alias("end"), p["m"].alias("m"), F.substring(p["gap"], -24, 24).alias("before"), p["after"].alias("after"))).alias("out"),
                ),
            ),
            lambda acc: acc["out"],
        )

    found = F.regexp_extract_all(text, pattern, F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,m:string,before:string,after:string>>")
    return let(found, lambda f: F.when(F.size(f) == 0, none).otherwise(let(F.split(text, PATTERNS[kind], -1), lambda parts: placed(parts, f))))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits has a good check digit."""
    values = F.transform(F.split(F.reverse(digits), ""), lambda d, i: let(d.cast("int"), lambda v: F.when(i % 2 == 0, v).otherwise(F.when(v > 4, 2 * v - 9).otherwise(2 * v))))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


_BYTE = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])$"


def _passes(kind: str, m: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(m, r"\."), lambda p: p.rlike(_BYTE))
    if kind == "card":
        return let(digits_of(m), lambda d: F.length(d).between(12, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits_of(m)).between(9, 15)
    return F.lit(True)


def _good(kind: str, s: Column) -> Column:
    return _passes(kind, s["m"])


def _plain(k: int, s: Column) -> Column:
    return F.struct(s["start"].alias("start"), F.lit(k).alias("k"), s["end"].alias("end"))


def _is_kind(k: int, s: Column) -> Column:
    return s["k"] == k


def base_spans(text: Column) -> Column:
    """array<struct<start, end, k>> of the base kinds, by start and kind."""
    hint = {"email": text.contains("@"), "ip": text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9]"), "phone": text.contains("+")}
    none = F.array().cast("array<struct<start:int,k:int,end:int>>")
    parts = []
    for k, kind in enumerate(KINDS[:4]):
        good = F.filter(matches(text, kind), partial(_good, kind))
        parts.append(F.when(hint[kind], F.transform(good, partial(_plain, k))).otherwise(none))
    return F.array_sort(F.concat(*parts))


def _features(kind: str, s: Column) -> Column:
    m, before = s["m"], F.lower(s["before"])
    digits = digits_of(m)
    context = F.when(before.rlike("phone|tel|call|fax|mobile"), 1).when(before.rlike("mail|contact|write"), 2).when(before.rlike("card|visa|pay|account"), 3).otherwise(0)
    return let(
        digits,
        lambda d: F.struct(
            s["start"].alias("start"), s["end"].alias("end"), F.lit(KINDS.index(kind)).alias("k"), F.lit(int(kind == "mail")).alias("mail"), F.least(F.length(d), F.lit(20)).alias("digits"),
            F.least(F.size(F.split(m, "[^0-9]+")) - 1, F.lit(5)).alias("groups"), m.startswith("+").cast("int").alias("plus"), m.contains("(").cast("int").alias("paren"),
            F.least(F.length(F.regexp_replace(m, r"[^.]", "")), F.lit(4)).alias("dots"), F.when(F.length(d).between(12, 19), luhn(d)).otherwise(False).cast("int").alias("luhn"), context.alias("context"),
            before.rlike(r"\w$").cast("int").alias("glued_left"), s["after"].rlike(r"\w").cast("int").alias("glued_right"),
        ),
    )


def candidates(text: Column) -> Column:
    """Features of every proposed span."""
    number = F.transform(matches(text, "number"), lambda s: _features("number", s))
    mail = F.transform(matches(text, "mail"), lambda s: _features("mail", s))
    none = F.slice(F.transform(F.array(F.struct(F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("m"), F.lit("").alias("before"), F.lit("").alias("after"))), lambda s: _features("mail", s)), 1, 0)
    return F.concat(F.when(text.rlike("[0-9]"), number).otherwise(none), F.when(text.contains("@"), mail).otherwise(none))


def _overlaps(spans: Column, s: Column) -> Column:
    return F.exists(spans, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"]))


def _free(documents: DataFrame, name: str) -> str:
    """A column name like this one that the documents do not have, in any case of its letters."""
    taken = {c.lower() for c in documents.columns}
    while name in taken:
        name += "_"
    return name


def found(documents: DataFrame, name: str) -> DataFrame:
    """The rows with their base spans and candidates, as fields of a new column."""
    text = F.coalesce(F.col("text"), F.lit(""))
    return documents.withColumn(name, let(text, lambda t: F.struct(base_spans(t).alias("base"), candidates(t).alias("candidates"))))


class Trees:
    """Boosted trees of two levels over cells of integer features, with a calibrated threshold."""

    def __init__(self, cells: list[dict]):
        self.trees: list[tuple] = []
        self.bias, self.threshold = 0.0, float("inf")
        x = np.array([[c[f] for f in RANGES] for c in cells], np.int64).reshape(len(cells), len(RANGES))
        yes, no = (np.array([c[k] for c in cells], float) for k in ("yes", "no"))
        held_yes, held_no = (np.array([c[k] for c in cells], float) for k in ("held_yes", "held_no"))
        if not yes.sum() or not no.sum():
            return
        self.bias = float(np.log(yes.sum() / no.sum()))
        score = np.full(len(x), self.bias)
        for _ in range(TREES):
            p = 1 / (1 + np.exp(-score))
            gradient, curve = yes - (yes + no) * p, (yes + no) * p * (1 - p)
            tree = self._grow(x, gradient, curve, np.ones(len(x), bool), 2)
            self.trees.append(tree)
            score += np.array([self._value(tree, row) for row in x])
        order = np.argsort(-score, kind="stable")
        good, bad = np.cumsum(held_yes[order]), np.cumsum(held_no[order])
        fine = (good >= PRECISION * (good + bad)) & (good + bad > 0) & np.append(score[order][1:] < score[order][:-1], True)
        if fine.any():
            self.threshold = float(score[order][np.flatnonzero(fine)[-1]])

    def _grow(self, x, gradient, curve, rows, depth) -> tuple:
        leaf = (RATE * float(gradient[rows].sum() / (curve[rows].sum() + 1)),)
        best = (1e-9, None)
        if depth:
            for f, values in enumerate(RANGES.values()):
                for cut in range(1, values):
                    left = rows & (x[:, f] < cut)
                    right = rows & ~left
                    gain = sum(gradient[r].sum() ** 2 / (curve[r].sum() + 1) for r in (left, right)) - gradient[rows].sum() ** 2 / (curve[rows].sum() + 1)
                    if left.any() and right.any() and gain > best[0]:
                        best = (gain, (f, cut, left, right))
        if best[1] is None:
            return leaf
        f, cut, left, right = best[1]
        return f, cut, self._grow(x, gradient, curve, left, depth - 1), self._grow(x, gradient, curve, right, depth - 1)

    def _value(self, tree, row) -> float:
        while len(tree) > 1:
            tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
        return tree[0]

    def score(self, s: Column) -> Column:
        names = list(RANGES)

        def built(tree) -> Column:
            return F.lit(tree[0]) if len(tree) == 1 else F.when(s[names[tree[0]]] < tree[1], built(tree[2])).otherwise(built(tree[3]))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + built(tree)
        return total


def train(documents: DataFrame) -> Trees:
    """Trees from the cells of all candidates of all documents."""
    held = F.coalesce(F.pmod(F.crc32(F.col("text").cast("binary")), F.lit(4)) == 2, F.lit(False))
    rows = found(documents.select("text"), "pii").select(held.alias("held"), F.col("pii.base").alias("base"), F.explode("pii.candidates").alias("s"))
    marked = rows.select("held", _overlaps(F.col("base"), F.col("s")).alias("hit"), *(F.col("s")[f].alias(f) for f in RANGES))
    counts = [F.count_if(F.col("hit") & ~F.col("held")).alias("yes"), F.count_if(~F.col("hit") & ~F.col("held")).alias("no"), F.count_if(F.col("hit") & F.col("held")).alias("held_yes"), F.count_if(~F.col("hit") & F.col("held")).alias("held_no")]
    cells = marked.groupBy(*RANGES).agg(*counts).orderBy(*RANGES)
    return Trees([r.asDict() for r in cells.collect()])


def spans(documents: DataFrame, trees: Trees, name: str) -> DataFrame:
    """The rows with a new column of two arrays, base and all: struct<start, k, end>, sorted by start and kind."""
    own, base, proposed = _free(documents, "_pii"), f"{_free(documents, '_pii')}.base", f"{_free(documents, '_pii')}.candidates"
    added = F.filter(proposed, lambda s: (trees.score(s) >= trees.threshold) & ~_overlaps(F.col(base), s)) if trees.trees else F.slice(proposed, 1, 0)
    plain = F.transform(added, lambda s: F.struct(s["start"].alias("start"), s["k"].alias("k"), s["end"].alias("end")))
    return found(documents, own).withColumn(name, F.struct(F.col(base).alias("base"), F.array_sort(F.concat(base, plain)).alias("all"))).drop(own)


def _written(spans_of: str) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans_of, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")


def report(documents: DataFrame, trees: Trees) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans and all spans."""
    rows = spans(documents.select("doc_id", "text"), trees, "spans")
    counts = [F.size(F.filter("spans.base", partial(_is_kind, k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS[:4])]
    return rows.select(F.col("doc_id").cast("long"), *counts, F.sha2(_written("spans.base"), 256).alias("base_sha256"), _written("spans.all").alias("spans"))


def redact(documents: DataFrame, trees: Trees, mark: Callable[[str], str] = lambda kind: f"[{kind}]") -> DataFrame:
    """The rows with every span replaced by a mark of its kind (of overlapping spans: the first's), columns as they were."""
    marks = F.array(*(F.lit(mark(k)) for k in KINDS))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        fresh = F.struct(s["end"].alias("at"), F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, s["start"] - acc["at"]), F.element_at(marks, s["k"] + 1)).alias("out"))
        return F.when(s["start"] >= acc["at"], fresh).otherwise(F.struct(F.greatest(acc["at"], s["end"]).alias("at"), acc["out"].alias("out")))

    name = _free(documents, "_spans")
    every = f"{name}.all"
    text = F.when(F.size(every) == 0, F.col("text")).otherwise(F.aggregate(every, start, step, lambda acc: F.concat(acc["out"], F.substr(F.col("text"), acc["at"] + 1, F.length("text")))))
    return spans(documents, trees, name).withColumn("text", text).select(*documents.columns)
