"""Scores of retrieval results and answers per evaluation case, and their aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.answers import verdict
from .cases import SOURCE_KINDS, category, is_judged, requirements, tagged

# Rank of the grades; no answer ranks with incorrect.
ANSWER_ORDER = {"correct": 2, "partial": 1, "incorrect": 0, "no_answer": 0}
DECLINE_ORDER = {"declined_properly": 1, "answered_anyway": 0, "no_answer": 0}
OVERFLOW_PREFIX = "context overflow:"


def satisfied(kind: Column, value: Column, source_type: Column, rule_id: Column, card_name: Column) -> Column:
    """Does a result or citation meet a requirement? Rules match by plain string prefix,
    rulings and cards by exact name and kind of source."""
    return F.coalesce(
        ((kind == "rules") & (source_type == "rule") & F.coalesce(rule_id, F.lit("")).startswith(value))
        | ((kind == "rulings") & (source_type == "ruling") & (card_name == value))
        | ((kind == "cards") & source_type.isin("card", "oracle") & (card_name == value)), F.lit(False))


def requirement_ranks(needs: DataFrame, results: DataFrame) -> DataFrame:
    """First rank of every requirement in its case's results; null when it is missing.
    Both sides are short lists per case; the join is an equality on the case."""
    r = results.select(F.col("case_id").alias("_case"), "number", F.col("source").alias("_s"), F.col("rule_id").alias("_r"), F.col("card_name").alias("_c"))
    hit = (F.col("case_id") == F.col("_case")) & satisfied(F.col("kind"), F.col("value"), F.col("_s"), F.col("_r"), F.col("_c"))
    return needs.join(r, hit, "left").groupBy("case_id", "ord", "kind", "value").agg(F.min("number").alias("rank"))


def score_retrieval(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Per case: pass (null when nothing is required), recall, first hit, card checks, size.

    A case's results are a short ranked list (the limits of the search), so they travel as
    one array and the requirements are looked up in it: results are read once."""
    none = F.array().cast("array<string>")
    item = F.struct("number", "source", "rule_id", "card_name", "match_type", F.length(F.coalesce("text", F.lit(""))).alias("chars"))
    got = results.groupBy("case_id").agg(F.sort_array(F.collect_list(item)).alias("_items"))
    d = cases.join(got, F.col("id") == F.col("case_id"), "left").drop("case_id")
    items = F.coalesce(F.col("_items"), F.array().cast(got.schema["_items"].dataType))
    need = F.flatten(F.array(*[tagged(kind, kind, "kind", "value") for kind in SOURCE_KINDS]))
    rank = lambda n: F.array_min(F.transform(F.filter(items, lambda i: satisfied(n.kind, n.value, i.source, i.rule_id, i.card_name)), lambda i: i.number))
    named = F.array_distinct(F.transform(F.filter(items, lambda i: i.match_type == "card_name_match"), lambda i: i.card_name))
    d = d.withColumn("_ranks", F.transform(need, lambda n: F.struct(F.concat_ws(":", n.kind, n.value).alias("label"), rank(n).alias("rank")))).withColumn("matched_cards", named)
    d = d.withColumn("expected_missing", F.array_except(F.coalesce("expected_cards", none), "matched_cards")).withColumn(
        "forbidden_hits", F.array_intersect(F.coalesce("forbidden_cards", none), "matched_cards"))
    found = F.array_compact(F.transform("_ranks", lambda r: r.rank))
    required = F.size("_ranks") > 0
    cards_ok = (F.size("expected_missing") == 0) & (F.size("forbidden_hits") == 0)
    has_checks = (F.size(F.coalesce("expected_cards", none)) > 0) | (F.size(F.coalesce("forbidden_cards", none)) > 0)
    sources_pass = F.when(required, F.size(found) == F.size("_ranks"))
    return d.select(
        "id", category(F.col("tags")).alias("category"),
        F.when(required, sources_pass & cards_ok).otherwise(F.when(has_checks, cards_ok)).alias("pass"), sources_pass.alias("sources_pass"),
        F.when(required, F.size(found) / F.size("_ranks")).alias("recall"), F.array_min(found).alias("first_hit_rank"), F.map_from_entries("_ranks").alias("requirement_ranks"),
        "matched_cards", "expected_missing", "forbidden_hits", F.size(items).cast("bigint").alias("result_count"),
        F.aggregate(items, F.lit(0).cast("bigint"), lambda acc, i: acc + i.chars).alias("context_chars"))


def score_citations(cases: DataFrame, citations: DataFrame) -> DataFrame:
    """Does any citation of a case meet any of its requirements? Null without requirements."""
    c = citations.select(F.col("case_id").alias("_case"), F.col("source_type").alias("_s"), F.col("rule_id").alias("_r"), F.col("card_name").alias("_c"))
    needs = requirements(cases)
    hit = (F.col("case_id") == F.col("_case")) & satisfied(F.col("kind"), F.col("value"), F.col("_s"), F.col("_r"), F.col("_c"))
    met = needs.join(c, hit, "left").groupBy("case_id").agg(F.bool_or(F.col("_case").isNotNull()).alias("cited_satisfies_required"))
    n = citations.groupBy("case_id").agg(F.count("*").alias("cited_count"))
    return cases.select(F.col("id").alias("case_id")).join(met, "case_id", "left").join(n, "case_id", "left").fillna(0, ["cited_count"])


def grade_cases(cases: DataFrame, answers: DataFrame) -> DataFrame:
    """The answer record of each case. ``answers`` has case_id, answer, the context hashes of
    both calls, grade (from the judge) and generation_error."""
    d = cases.join(answers, F.col("id") == F.col("case_id")).drop("case_id")
    parsed = F.when(F.col("verdict").isNotNull(), verdict(F.col("answer")))
    return (
        d.withColumn("verdict_expected", F.col("verdict")).withColumn("verdict_parsed", parsed)
        .withColumn("verdict_correct", F.when(F.col("verdict").isNotNull(), F.col("verdict_parsed") == F.col("verdict")))
        .withColumn("grade", F.when(is_judged(), F.when(F.col("answer").isNull(), "no_answer").otherwise(F.col("grade"))))
        .withColumn("context_drift", ~F.col("answer_cached") & ~F.col("context_hash").eqNullSafe(F.col("retrieval_context_hash")))
        .withColumn("context_overflow", F.coalesce(F.col("generation_error").startswith(OVERFLOW_PREFIX), F.lit(False)))
        .drop("verdict")
    )


def _rate(part: Column, whole: Column) -> Column:
    return F.try_divide(F.count_if(part & whole), F.count_if(whole))


def retrieval_metrics() -> list[Column]:
    """Aggregates over case records (error, pass, recall, first_hit_rank, ...). A case with
    an error counts as a failure and is left out of the means."""
    error = F.col("error").isNotNull()
    outcome = F.when(error, False).otherwise(F.col("pass"))
    ok = lambda c: F.when(~error, c)
    return [
        F.count("*").alias("cases"), F.count_if(error).alias("errors"), F.count(outcome).alias("scored"), F.count_if(outcome).alias("passed"),
        F.try_divide(F.count_if(outcome), F.count(outcome)).alias("pass_rate"),
        F.avg(ok(F.col("recall"))).alias("mean_recall"), F.avg(ok(F.col("first_hit_rank"))).alias("mean_first_hit_rank"),
        F.coalesce(F.sum(ok(F.size("forbidden_hits"))), F.lit(0)).alias("forbidden_hits"),
        F.coalesce(F.sum(ok(F.size("expected_missing"))), F.lit(0)).alias("expected_missing"),
        F.avg(ok(F.col("result_count"))).alias("mean_results"), F.avg(ok(F.col("context_chars"))).alias("mean_context_chars"),
    ]


def answer_metrics() -> list[Column]:
    """Aggregates over answer records. Records without an answer record have a null
    ``should_decline``."""
    full = F.col("should_decline").isNotNull()
    judged = full & F.col("grade").isNotNull()
    graded = judged & ~F.col("should_decline") & (F.col("grade") != "error")
    declined = judged & F.col("should_decline") & (F.col("grade") != "error")
    return [
        F.count_if(full & F.col("answer").isNotNull()).alias("answered"), F.count_if(judged & (F.col("grade") == "error")).alias("judge_errors"),
        F.count_if(graded).alias("judged"),
        _rate(F.col("grade") == "correct", graded).alias("correct_rate"), _rate(F.col("grade") == "partial", graded).alias("partial_rate"),
        _rate(F.col("grade").isin("incorrect", "no_answer"), graded).alias("incorrect_rate"),
        _rate(F.coalesce(F.col("verdict_correct"), F.lit(False)), full & F.col("verdict_expected").isNotNull()).alias("verdict_accuracy"),
        _rate(F.col("grade") == "declined_properly", declined).alias("decline_accuracy"),
        _rate(F.col("answer_cached"), full).alias("answer_cache_hit_rate"),
        _rate(F.col("judge_cached"), judged & (F.col("grade") != "no_answer")).alias("judge_cache_hit_rate"),
        F.coalesce(F.sum("invalid_citations"), F.lit(0)).alias("invalid_citations"), F.avg("generate_ms").alias("mean_generate_ms"),
        F.count_if(full & F.col("context_overflow")).alias("context_overruns"), F.max("prompt_tokens").alias("max_prompt_tokens"),
    ]


def aggregate(records: DataFrame, mode: str = "retrieval") -> DataFrame:
    """Metrics per category and overall (null category), in one pass."""
    metrics = retrieval_metrics() + (answer_metrics() if mode == "full" else [])
    return records.groupingSets([["category"], []], "category").agg(*metrics)
