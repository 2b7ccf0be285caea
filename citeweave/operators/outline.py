"""Numbered outline documents: lines to chunks, trees, headings, neighbours.

A document is one row and its lines are parsed by array expressions inside that row, so
chunking shuffles nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let
from ..functions.hashing import content_hash
from ..functions.text import is_title, is_top_level, parent_id
from ..sources.scans import BLANKS, LINE_BREAK
from ..session import materialize
from .running import ordinal

# Fixed patterns of the outline grammar.
SECTION_HEADING = r"(?U)^\d{1,2}\.\s+\S"
SECTION_NUMBER = r"^(\d{1,2})\."
RULE_LINE = r"(?U)^(\d{3}(?:\.\d+[a-z]?)?)\.?\s+(\S.*)$"
GLOSSARY = "Glossary"

# Titles of the nine sections, which the text itself does not repeat.
SECTION_TITLES = {
    1: "Game Concepts",
    2: "Parts of a Card",
    3: "Card Types",
    4: "Zones",
    5: "Turn Structure",
    6: "Spells, Abilities, and Effects",
    7: "Additional Rules",
    8: "Multiplayer Rules",
    9: "Casual Variants",
}


def _positions(lines: Column, test) -> Column:
    """1-based positions of the lines that pass a test."""
    return F.filter(F.transform(lines, lambda x, i: F.when(test(x, i), i + 1)), lambda p: p.isNotNull())


def parse_outline(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per numbered rule: doc_id, line_no, rule_id, text, parent_id, content_hash.

    Section headings are dropped; the first one opens the contents block, the next one with
    the same number closes it; a glossary line outside the contents ends the document."""
    trimmed = F.transform(F.split(text, LINE_BREAK, -1), lambda x: F.btrim(x, F.lit(BLANKS)))
    number = lambda lines, p: F.regexp_extract(F.get(lines, p - 1), SECTION_NUMBER, 1)

    def contents(lines: Column) -> Column:
        # Positions of the first heading and of its repetition; without one the contents never end.
        beyond = F.size(lines) + 1
        return let(_positions(lines, lambda x, i: x.rlike(SECTION_HEADING)), lambda sec: let(F.coalesce(F.get(sec, F.lit(0)), beyond), lambda first: F.struct(
            first.alias("open"),
            F.coalesce(F.get(F.filter(sec, lambda p: (p > first) & (number(lines, p) == number(lines, first))), F.lit(0)), beyond).alias("close"))))

    in_body = lambda c, p: (p < c.open) | (p > c.close)
    glossary = lambda lines, c: F.coalesce(F.get(_positions(lines, lambda x, i: (x == GLOSSARY) & in_body(c, i + 1)), F.lit(0)), F.size(lines) + 1)

    def body(lines: Column, c: Column, end: Column) -> Column:
        keep = lambda x, i: in_body(c, i + 1) & (i + 1 < end) & (x != "") & ~x.rlike(SECTION_HEADING)
        return F.filter(F.transform(lines, lambda x, i: F.when(keep(x, i), F.struct((i + 1).alias("n"), x.alias("x")))), lambda s: s.isNotNull())

    def rules_of(kept: Column, start: Column) -> Column:
        until = lambda j: F.coalesce(F.get(start, j + 1), F.size(kept) + 1)
        folded = lambda p, j: F.transform(
            F.slice(kept, p, until(j) - p), lambda s, n: F.when(n == 0, F.regexp_extract(s.x, RULE_LINE, 2)).otherwise(s.x))
        return F.transform(start, lambda p, j: F.struct(
            F.get(kept, p - 1).n.alias("line_no"), F.regexp_extract(F.get(kept, p - 1).x, RULE_LINE, 1).alias("rule_id"),
            F.array_join(folded(p, j), " ").alias("text")))

    chunk = let(trimmed, lambda lines: let(contents(lines), lambda c: let(glossary(lines, c), lambda end: let(
        body(lines, c, end), lambda kept: let(_positions(kept, lambda s, j: s.x.rlike(RULE_LINE)), lambda start: rules_of(kept, start))))))
    rules = documents.select(doc_id, F.inline(chunk))
    return rules.withColumn("parent_id", parent_id(F.col("rule_id"))).withColumn("content_hash", content_hash(F.col("rule_id"), F.col("text")))


def with_ancestors(nodes: DataFrame, node: str = "rule_id", parent: str = "parent_id", text: str = "text") -> DataFrame:
    """Add ``ancestors``: array of (id, text), top level first, up to the first parent that is not in the table. Chains
    double: a round joins each to the chain of the node that it stops at, so rounds grow with the logarithm of the depth.
    A node that is its own ancestor raises."""
    item = "array<struct<id:string,text:string>>"
    # Chains of distinct parents only, each with the parent itself: many nodes share one.
    parents = nodes.where(F.col(parent).isNotNull()).select(F.col(parent).alias("_child_of")).distinct()
    start = F.array(F.struct(F.col(node).cast("string").alias("id"), F.col(text).alias("text"))).cast(item)
    chains = nodes.select(F.col(node).alias("_from"), F.col(parent).alias("_next"), start.alias("ancestors"))
    chains = materialize(chains.join(parents, F.col("_from") == F.col("_child_of"), "left_semi"), "ancestors")
    while True:
        seen = F.exists("ancestors", lambda a: a["id"] == F.col("_next").cast("string"))
        state = chains.agg(F.count_if(F.col("_next").isNotNull()), F.count_if(seen)).first()
        if state[1]:
            raise ValueError("a node is its own ancestor")
        if not state[0]:
            break
        above = chains.select(F.col("_from").alias("_at"), F.col("_next").alias("_beyond"), F.col("ancestors").alias("_above"))
        longer = chains.where(F.col("_next").isNotNull()).join(above, F.col("_next") == F.col("_at"), "left")
        longer = longer.select("_from", F.col("_beyond").alias("_next"), F.concat(F.coalesce("_above", F.array().cast(item)), F.col("ancestors")).alias("ancestors"))
        chains = materialize(chains.where(F.col("_next").isNull()).unionByName(longer), "ancestors")
    out = nodes.join(chains.select(F.col("_from"), F.col("ancestors")), F.col(parent) == F.col("_from"), "left").drop("_from")
    return out.withColumn("ancestors", F.coalesce("ancestors", F.array().cast("array<struct<id:string,text:string>>")))


def breadcrumb(ancestors: Column) -> Column:
    """``Section 601: Casting > 601.2: Playing`` and a line break; empty at the top."""
    parts = F.transform(ancestors, lambda a, i: F.concat(F.when(i == 0, "Section ").otherwise(""), a.id, F.lit(": "), a.text))
    return F.when(F.size(ancestors) > 0, F.concat(F.array_join(parts, " > "), F.lit("\n"))).otherwise("")


def heading(text: Column, ancestors: Column) -> Column:
    """The nearest heading-like text at or above a rule."""
    above = F.filter(ancestors, lambda a: is_title(a.text))
    return F.when(is_title(text), text).otherwise(F.try_element_at(above, F.lit(-1)).text)


def children(nodes: DataFrame, node: str = "rule_id", parent: str = "parent_id", line_no: str = "line_no") -> DataFrame:
    """Child rows of every known parent with their position among its children. Long form:
    a parent with very many children is never one array or one task."""
    known = nodes.select(F.col(node).alias("_id"))
    kids = nodes.join(known, F.col(parent) == F.col("_id"), "left_semi")
    return ordinal(kids, [parent], line_no, "position")


def table_of_contents(rules: DataFrame) -> DataFrame:
    """Top-level rules with their section number and title and their place in the section."""
    top = rules.filter(is_top_level(F.col("rule_id"))).withColumn("section", F.substring("rule_id", 1, 1).cast("int"))
    titles = F.create_map(*[F.lit(v) for pair in SECTION_TITLES.items() for v in pair])
    named = top.withColumn("section_title", F.coalesce(titles[F.col("section")], F.concat(F.lit("Section "), F.col("section").cast("string"))))
    return ordinal(named, ["section"], "line_no", "position")


def neighbours(nodes: DataFrame, group: list[str], line_no: str, node: str) -> DataFrame:
    """Previous and next row of every row in its list. Positions first, then two equi-joins
    on (list, position), so a long list is spread over all tasks."""
    placed = ordinal(nodes, group, line_no, "_pos")
    near = placed.select(*[F.col(g).alias(f"_g_{g}") for g in group], F.col("_pos").alias("_p"), F.col(node).alias("_n"))
    out = placed
    for name, step in (("prev", -1), ("next", 1)):
        same = F.col("_pos") + step == F.col("_p")
        for g in group:
            same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
        out = out.join(near, same, "left").withColumn(name, F.col("_n")).drop("_p", "_n", *[f"_g_{g}" for g in group])
    return out.drop("_pos")


def window_around(positions: DataFrame, centres: DataFrame, size: int = 14, group: str = "group_id", position: str = "position", total: str = "total") -> DataFrame:
    """Up to ``size`` rows around a centre row, clamped to the ends of its list. ``centres``
    carries window_id, the group, the centre's 0-based position and the list length; every
    window is spelled out as positions and found by an equi-join."""
    first = F.when(F.col(total) <= size, 0).otherwise(F.least(F.greatest(F.lit(0), F.col(position) - size // 2), F.col(total) - size))
    wanted = centres.select(
        "window_id", F.col(group).alias("_g"),
        F.explode(F.sequence(first.cast("bigint"), (first + F.least(F.lit(size), F.col(total)) - 1).cast("bigint"))).alias("_p"))
    return wanted.join(positions, (F.col(group) == F.col("_g")) & (F.col(position) == F.col("_p"))).drop("_g", "_p")
