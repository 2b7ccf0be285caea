"""Reading answers: citation markers, rule references, verdicts, grades, completion state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expr import let

# Fixed patterns of the answer format.
MARKER = r"[ \t]*\[[\d\s,;^\-–]*\d[\d\s,;^\-–]*\]"
WELL_FORMED = r"^[ \t]*\[\s*\d+(?:\s*,\s*\d+)*\s*\]$"
RULE_REFERENCE = r"(?<![\d.$€£])\d{3}\.\d+[a-z]?(?![a-z\d]|\.\d)"
BARE_RULE = r"(?<=\brules?\s)\d{3}(?!\d|\.\d)"

# The grades a judge may give.
ANSWER_GRADES = ("correct", "partial", "incorrect")
DECLINE_GRADES = ("declined_properly", "answered_anyway")


def parse_citations(df: DataFrame, answer: str = "answer", valid: str = "valid_numbers") -> DataFrame:
    """Add ``cleaned``, ``cited`` (first-appearance order) and ``invalid_count``.

    ``valid`` is an array of the numbers an answer may cite. Malformed and
    out-of-range markers leave the text together with the blanks before them."""
    numbers = lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda n: n.try_cast("bigint"))
    known = lambda n: F.coalesce(F.array_contains(F.col(valid), n), F.lit(False))

    def read(marker: Column) -> Column:
        ok = marker.rlike(WELL_FORMED)
        kept = F.when(ok, F.array_distinct(F.filter(numbers(marker), known))).otherwise(F.array().cast("array<bigint>"))
        bad = F.when(ok, F.size(F.filter(numbers(marker), lambda n: ~known(n)))).otherwise(1)
        return F.struct(F.regexp_extract(marker, r"^[ \t]*", 0).alias("lead"), kept.alias("kept"), bad.alias("bad"))

    def written(m: Column) -> Column:
        return F.when(F.size(m.kept) > 0, F.concat(m.lead, F.lit("["), F.array_join(m.kept.cast("array<string>"), ", "), F.lit("]"))).otherwise("")

    def parsed(marks: Column) -> Column:
        text = F.transform(F.split(answer, MARKER, -1), lambda t, i: F.concat(t, F.coalesce(written(F.get(marks, i)), F.lit(""))))
        return F.struct(
            F.array_join(text, "").alias("cleaned"), F.array_distinct(F.flatten(F.transform(marks, lambda m: m.kept))).alias("cited"),
            F.aggregate(marks, F.lit(0), lambda acc, m: acc + m.bad).alias("invalid_count"))

    found = F.transform(F.regexp_extract_all(answer, F.lit(MARKER), F.lit(0)), read)
    return df.withColumn("_p", let(found, parsed)).select("*", "_p.cleaned", "_p.cited", "_p.invalid_count").drop("_p")


def rule_references(text: Column) -> Column:
    """Distinct rule numbers mentioned in prose, in first-appearance order."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(RULE_REFERENCE), F.lit(0)))


def rule_text_references(text: Column) -> Column:
    """Rule numbers mentioned in rule text, a bare ``rule 100`` included, in order."""
    return F.regexp_extract_all(text, F.lit(f"{RULE_REFERENCE}|{BARE_RULE}"), F.lit(0))


def verdict(answer: Column) -> Column:
    """``yes`` / ``no`` / ``unclear`` from the opening sentence."""
    plain = F.regexp_replace(F.coalesce(answer, F.lit("")), r"[*_`#>]", "")
    bare = F.lower(F.regexp_replace(F.regexp_replace(plain, r"(?iU)^\s*(answer|short answer)\s*:\s*", ""), r"(?U)^\s+|\s+$", ""))
    first = F.substring(F.get(F.split(bare, r"[.!?\n]", 2), F.lit(0)), 1, 200)
    opening = F.regexp_extract(first, r"(?U)^(yes|no)\b", 1)
    kinds = F.array_distinct(F.regexp_extract_all(first, F.lit(r"(?U)\b(yes|no)\b"), F.lit(1)))
    return F.when(opening != "", opening).when(F.size(kinds) == 1, F.get(kinds, F.lit(0))).otherwise("unclear")


def parse_grade(text: Column, decline: Column) -> Column:
    """struct(grade, reason) from the first JSON object of a reply with an allowed grade."""
    allowed = F.when(decline, F.array(*map(F.lit, DECLINE_GRADES))).otherwise(F.array(*map(F.lit, ANSWER_GRADES)))
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?s)\{.*?\}"), F.lit(0))
    parsed = F.transform(found, lambda j: F.from_json(j, "grade string, reason string"))
    clean = F.transform(parsed, lambda g: F.struct(
        F.lower(F.trim(F.coalesce(g.grade, F.lit("")))).alias("grade"), F.trim(F.coalesce(g.reason, F.lit(""))).alias("reason")))
    first = F.get(F.filter(clean, lambda g: F.array_contains(allowed, g.grade)), F.lit(0))
    failed = F.struct(F.lit("error").alias("grade"),
                      F.concat(F.lit("unparseable judge reply: "), F.substring(F.coalesce(text, F.lit("")), 1, 200)).alias("reason"))
    return F.coalesce(first, failed)


def completion(text: Column, failure: Column, finish_reason: Column) -> Column:
    """struct(answer, answer_complete, error): text written before a failure is kept; an
    answer is complete only without failure and with finish reason STOP."""
    answer = F.when((F.coalesce(text, F.lit("")) != "") | failure.isNull(), F.coalesce(text, F.lit("")))
    complete = failure.isNull() & F.coalesce(finish_reason == "STOP", F.lit(False))
    cut = F.concat(F.lit("answer cut off (finish reason: "), F.coalesce(F.nullif(finish_reason, F.lit("")), F.lit("none")), F.lit(")"))
    error = F.coalesce(failure, F.when((answer != "") & ~complete, cut))
    return F.struct(answer.alias("answer"), F.when(answer.isNotNull(), complete).alias("answer_complete"), error.alias("error"))


def notice(answer: Column, degraded: Column, remaining: Column) -> Column:
    """Code of what is shown where an answer is wanting: out of budget, out of quota for now or for the day, or nothing written."""
    return (
        F.when(degraded == "global_budget", "paused")
        .when(degraded == "ip_quota", F.when(F.coalesce(remaining, F.lit(0)) != 0, "breather").otherwise("quota_used"))
        .when(F.coalesce(answer, F.lit("")) == "", "no_answer")
    )


# How few answers left count as low, and the wording of the labels below.
RUNNING_LOW_AT = 3


def is_running_low(remaining: Column) -> Column:
    return F.coalesce(remaining <= RUNNING_LOW_AT, F.lit(False))


def answers_left_label(n: Column, compact: bool = False) -> Column:
    if compact:
        return F.concat(n.cast("string"), F.lit(" left today"))
    low = F.concat(n.cast("string"), F.when(n == 1, " AI answer").otherwise(" AI answers"), F.lit(" left today"))
    return F.when(is_running_low(n), low).otherwise(F.concat(n.cast("string"), F.lit(" answers left today")))


def request_outcome(tracked: Column, degraded: Column, cache_hit: Column, failed: Column) -> Column:
    """The ledger outcome of a request; null when the request is not recorded."""
    return (
        F.when(~tracked, F.lit(None).cast("string"))
        .when(cache_hit, "cached")
        .when(degraded == "ip_quota", "degraded_ip")
        .when(degraded == "global_budget", "degraded_global")
        .when(failed, "error")
        .otherwise("generated")
    )


def shown_remaining(degraded: Column, cache_hit: Column, remaining: Column) -> Column:
    """Answers left as displayed: a cache hit under a spent budget promises none."""
    return F.when(cache_hit & F.coalesce(degraded == "global_budget", F.lit(False)), F.lit(0)).otherwise(remaining)


# Finish reasons of the line-per-message format.
FINISH_REASONS = {"stop": "STOP", "length": "MAX_TOKENS"}

_CANDIDATE_CHUNK = """candidates array<struct<content:struct<parts:array<struct<text:string,thought:boolean>>>,finishReason:string>>,
promptFeedback struct<blockReason:string>,
usageMetadata struct<promptTokenCount:int,candidatesTokenCount:int,thoughtsTokenCount:int>"""
_MESSAGE_CHUNK = "message struct<content:string>, done boolean, done_reason string, prompt_eval_count int, eval_count int, error string"


def candidate_chunk(raw: Column) -> Column:
    """One captured chunk of the candidates format as struct(text, counts, finish_reason, error)."""
    d = F.from_json(raw, _CANDIDATE_CHUNK)
    first = F.get(d.candidates, F.lit(0))
    parts = F.filter(F.coalesce(first.content.parts, F.array().cast("array<struct<text:string,thought:boolean>>")),
                     lambda p: ~F.coalesce(p.thought, F.lit(False)))
    blocked = (F.coalesce(F.size(d.candidates), F.lit(0)) <= 0) & (F.coalesce(d.promptFeedback.blockReason, F.lit("")) != "")
    return F.struct(
        F.array_join(F.transform(parts, lambda p: F.coalesce(p.text, F.lit(""))), "").alias("text"),
        d.usageMetadata.promptTokenCount.alias("input_tokens"),
        d.usageMetadata.candidatesTokenCount.alias("output_tokens"),
        d.usageMetadata.thoughtsTokenCount.alias("thinking_tokens"),
        first.finishReason.alias("finish_reason"),
        F.when(blocked, F.concat(F.lit("no answer: "), d.promptFeedback.blockReason)).alias("error"),
    )


def message_chunk(raw: Column) -> Column:
    """One captured line of the message format, in the same shape as ``candidate_chunk``."""
    d = F.from_json(raw, _MESSAGE_CHUNK)
    done = F.coalesce(d.done, F.lit(False))
    reason = F.nullif(d.done_reason, F.lit(""))
    mapped = F.upper(reason)
    for source, target in FINISH_REASONS.items():
        mapped = F.when(reason == source, target).otherwise(mapped)
    return F.struct(
        F.coalesce(d.message.content, F.lit("")).alias("text"),
        F.when(done, d.prompt_eval_count).alias("input_tokens"),
        F.when(done, d.eval_count).alias("output_tokens"),
        F.when(done, 0).alias("thinking_tokens"),
        F.when(done, mapped).alias("finish_reason"),
        d.error.alias("error"),
    )


def history_replay(df: DataFrame) -> DataFrame:
    """Saved history rows that can be shown again: null lists become empty, an answer
    with an error is a cut-off one, rows without an answer are left out."""
    return (
        df.filter(F.coalesce(F.col("answer"), F.lit("")) != "")
        .withColumn("citations", F.coalesce("citations", F.array().cast(df.schema["citations"].dataType)))
        .withColumn("rule_references", F.coalesce("rule_references", F.array().cast("array<string>")))
        .withColumn("answer_complete", F.coalesce(F.col("error"), F.lit("")) == "")
    )
