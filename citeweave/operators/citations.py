"""Citations of a table of answers: validation, sources, references, segments, sentences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import RULE_REFERENCE, parse_citations, rule_references
from ..functions.expr import let
from ..functions.results import citation
from .retrieve import RESULT_FIELDS

LIVE_MARKER = r"\[\s*\d+(?:\s*,\s*\d+)*\s*\]"


def valid_numbers(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The numbers an answer may cite: those of its own (short) result list."""
    return results.groupBy(query_id).agg(F.sort_array(F.collect_set(F.col("number").cast("bigint"))).alias("valid_numbers"))


def validate(answers: DataFrame, results: DataFrame, query_id: str = "query_id", answer: str = "answer") -> DataFrame:
    """Answers with invalid markers removed and their statistics. Without an answer the
    statistics are zero and false."""
    joined = answers.join(valid_numbers(results, query_id), query_id, "left").withColumn(
        "valid_numbers", F.coalesce("valid_numbers", F.array().cast("array<bigint>")))
    parsed = parse_citations(joined, answer)
    has = F.col(answer).isNotNull()
    return (
        parsed.withColumn("cited", F.when(has, F.col("cited")).otherwise(F.array().cast("array<bigint>")))
        .withColumn("cited_count", F.size("cited")).withColumn("invalid_count", F.coalesce("invalid_count", F.lit(0)))
        .withColumn("uncited_answer", has & (F.size("cited") == 0)).drop("valid_numbers")
    )


def cited_sources(validated: DataFrame, results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """One citation record per (answer, cited number)."""
    numbers = validated.select(query_id, F.explode("cited").alias("number"))
    r = {name: F.col(name) for name in RESULT_FIELDS}
    hits = numbers.join(results.withColumn("number", F.col("number").cast("bigint")), [query_id, "number"])
    return hits.select(query_id, citation(F.col("number"), r).alias("c")).select(query_id, "c.*")


def mark_cited(results: DataFrame, validated: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Results with ``cited`` set where the answer cites their number."""
    numbers = validated.select(query_id, F.explode("cited").alias("number")).withColumn("_c", F.lit(True))
    return results.withColumn("number", F.col("number").cast("bigint")).join(numbers, [query_id, "number"], "left").withColumn(
        "cited", F.coalesce("_c", F.lit(False))).drop("_c")


def uncited(marked: DataFrame) -> DataFrame:
    return marked.filter(~F.col("cited"))


def referenced_rules(answers: DataFrame, rules: DataFrame, query_id: str = "query_id", text: str = "cleaned") -> DataFrame:
    """Existing rule numbers mentioned in prose, with their order of first appearance."""
    mentions = answers.select(query_id, F.posexplode(rule_references(F.col(text))).alias("position", "rule_id"))
    return mentions.join(rules.select("rule_id").distinct(), "rule_id", "left_semi")


def cite(answers: DataFrame, results: DataFrame, rules: DataFrame, query_id: str = "query_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Validated answers, their citation records and their rule references."""
    v = validate(answers, results, query_id)
    return v, cited_sources(v, results, query_id), referenced_rules(v, rules, query_id)


def live_numbers(draft: Column, known: Column) -> Column:
    """Known numbers a draft cites so far, ascending."""
    marks = F.regexp_extract_all(draft, F.lit(LIVE_MARKER), F.lit(0))
    numbers = F.flatten(F.transform(marks, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: F.coalesce(F.array_contains(known, n), F.lit(False)))))


def segments(answers: DataFrame, query_id: str = "query_id", answer: str = "answer", numbers: str = "citation_numbers", refs: str = "rule_refs") -> DataFrame:
    """An answer as ordered segments: text, cite (known numbers) and rule (known ids).
    Unknown markers and references stay part of the text around them."""
    token = rf"\[\s*\d+(?:\s*,\s*\d+)*\s*\]|{RULE_REFERENCE}"
    known = lambda m: F.filter(F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint")),
                               lambda n: F.coalesce(F.array_contains(F.col(numbers), n), F.lit(False)))
    is_cite = lambda m: m.startswith("[") & (F.size(known(m)) > 0)
    is_rule = lambda m: ~m.startswith("[") & F.array_contains(F.col(refs), m)
    # Plain text, token, plain text, ...; a token that is unknown turns into text.
    piece = lambda kind, text, m: F.struct(F.lit(kind).alias("kind"), text.alias("text"),
                                           (known(m) if kind == "cite" else F.array().cast("array<bigint>")).alias("numbers"))
    none = F.lit("")
    tokens = F.transform(F.regexp_extract_all(answer, F.lit(token), F.lit(0)),
                         lambda m: F.when(is_cite(m), piece("cite", m, m)).when(is_rule(m), piece("rule", m, none)).otherwise(piece("text", m, none)))
    mixed = let(tokens, lambda k: F.flatten(F.transform(
        F.split(answer, token, -1), lambda t, i: F.filter(F.array(piece("text", t, none), F.get(k, i)), lambda p: p.isNotNull()))))
    d = answers.select(query_id, F.posexplode(F.filter(mixed, lambda p: ~((p.kind == "text") & (p.text == "")))).alias("_i", "_p")).select(query_id, "_i", "_p.*")
    # Neighbouring text pieces are one segment.
    w = Window.partitionBy(query_id).orderBy("_i")
    starts = ~((F.col("kind") == "text") & F.coalesce(F.lag("kind").over(w) == "text", F.lit(False)))
    runs = d.withColumn("_new", starts.cast("int")).withColumn("segment", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    parts = F.sort_array(F.collect_list(F.struct("_i", "text")))
    return runs.groupBy(query_id, "segment").agg(
        F.first("kind").alias("kind"), F.array_join(F.transform(parts, lambda p: p.text), "").alias("text"), F.first("numbers").alias("numbers"))


BOUNDARY = r"[.!?]+(?=\s|$)|\n+"


def sentences(segs: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Pieces of segments with their sentence number. Text splits after a boundary; a
    marker with nothing but blanks since the last boundary belongs to the sentence before."""
    cut = let(F.regexp_extract_all("text", F.lit(BOUNDARY), F.lit(0)), lambda ends: F.transform(F.split("text", BOUNDARY, -1), lambda t, i: F.struct(
        F.concat(t, F.coalesce(F.get(ends, i), F.lit(""))).alias("text"), F.get(ends, i).isNotNull().cast("int").alias("ends"))))
    one = F.array(F.struct(F.col("text"), F.lit(0).alias("ends")))
    pieces = segs.select(query_id, "segment", "kind", "numbers", F.posexplode(F.when(F.col("kind") == "text", cut).otherwise(one)).alias("part", "_p")).select(
        query_id, "segment", "part", "kind", "numbers", "_p.*")
    w = Window.partitionBy(query_id).orderBy("segment", "part")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    # Since the last boundary: was there any text or rule? An id per piece orders both facts.
    at = F.row_number().over(w)
    p = pieces.withColumn("_at", at).withColumn("_s", F.coalesce(F.sum("ends").over(before), F.lit(0)))
    solid = ((F.col("kind") == "rule") | ((F.col("kind") == "text") & (F.trim(F.regexp_replace("text", r"\s+", " ")) != ""))) & (F.col("ends") == 0)
    p = p.withColumn("_solid", F.max(F.when(solid, F.col("_at"))).over(before)).withColumn("_bound", F.max(F.when(F.col("ends") == 1, F.col("_at"))).over(before))
    fresh = F.coalesce(F.col("_solid"), F.lit(0)) <= F.coalesce(F.col("_bound"), F.lit(0))
    sentence = F.when((F.col("kind") == "cite") & fresh & (F.col("_s") > 0), F.col("_s") - 1).otherwise(F.col("_s"))
    shown = p.filter((F.col("kind") != "text") | (F.col("text") != ""))
    return shown.select(query_id, F.row_number().over(w).alias("piece"), "kind", "text", "numbers", sentence.cast("bigint").alias("sentence"),
                        "segment", "part")


def lead(pieces: DataFrame, query_id: str = "query_id", max_chars: int = 140) -> DataFrame:
    """Per answer its opening sentence, where at most ``max_chars`` of text with a closing mark stand in it and the
    answer goes on after it; otherwise null."""
    first = F.sort_array(F.collect_list(F.when((F.col("sentence") == 0) & (F.col("kind") == "text"), F.struct("segment", "part", "text"))))
    text = F.regexp_replace(F.array_join(F.transform(first, lambda p: p.text), ""), r"^\s+|\s+$", "")
    more = F.bool_or((F.col("sentence") != 0) & ((F.col("kind") != "text") | F.col("text").rlike(r"\S")))
    out = pieces.groupBy(query_id).agg(text.alias("_lead"), more.alias("_more"))
    ok = F.col("_lead").rlike(r"[.!?]$") & (F.length("_lead") <= max_chars) & ~F.col("_lead").contains("\n") & F.col("_more")
    return out.select(query_id, F.when(ok, F.col("_lead")).alias("lead"))


def paragraphs(pieces: DataFrame, leads: DataFrame, query_id: str = "query_id") -> DataFrame:
    """The text outside the lead, cut at blank lines: (answer, paragraph, piece, kind, text).
    Paragraphs without content are left out and edges are trimmed."""
    rest = pieces.join(leads, query_id).filter(F.col("lead").isNull() | (F.col("sentence") != 0))
    parts = F.when(F.col("kind") == "text", F.split("text", r"\n{2,}", -1)).otherwise(F.array("text"))
    rows = rest.select(query_id, "piece", "kind", "numbers", F.posexplode(parts).alias("cut", "text"))
    w = Window.partitionBy(query_id).orderBy("piece", "cut")
    rows = rows.withColumn("paragraph", F.sum((F.col("cut") > 0).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    solid = (F.col("kind") != "text") | F.col("text").rlike(r"\S")
    one = Window.partitionBy(query_id, "paragraph").orderBy("piece", "cut")
    n, total = F.row_number().over(one), F.count("*").over(Window.partitionBy(query_id, "paragraph"))
    rows = rows.withColumn("_n", n).withColumn("_total", total).withColumn("_has", F.max(solid).over(Window.partitionBy(query_id, "paragraph")))
    kept = rows.filter(F.col("_has") & ~((F.col("kind") == "text") & ~F.col("text").rlike(r"\S") & ((F.col("_n") == 1) | (F.col("_n") == F.col("_total")))))
    head, tail = F.row_number().over(one) == 1, F.row_number().over(Window.partitionBy(query_id, "paragraph").orderBy(F.desc("piece"), F.desc("cut"))) == 1
    kept = kept.withColumn("_head", head).withColumn("_tail", tail)
    text = F.when((F.col("kind") == "text") & F.col("_head"), F.regexp_replace("text", r"^\s+", "")).otherwise(F.col("text"))
    text = F.when((F.col("kind") == "text") & F.col("_tail"), F.regexp_replace(text, r"\s+$", "")).otherwise(text)
    return kept.select(query_id, "paragraph", "piece", "cut", "kind", text.alias("text"), "numbers")
