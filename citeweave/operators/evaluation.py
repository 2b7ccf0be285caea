"""Evaluation runs: score retrieval, grade answers, aggregate; and sweeps over settings."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from . import rundiff, scoring, search

FULL_COLUMNS = ("should_decline", "answer", "grade", "verdict_expected", "verdict_correct", "verdict_parsed", "answer_cached", "judge_cached", "invalid_citations", "generate_ms", "context_overflow", "prompt_tokens")


def run(cases: DataFrame, results: DataFrame, answers: DataFrame | None = None, errors: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(case records, aggregates) of one run. ``answers`` (full mode) has one row per case
    in the shape ``scoring.grade_cases`` reads plus the counters of FULL_COLUMNS; ``errors``
    has case_id and error for calls that failed."""
    failed = cases.select("id").withColumn("error", F.lit(None).cast("string")) if errors is None else cases.select("id").join(
        errors.select(F.col("case_id").alias("id"), "error"), "id", "left")
    records = scoring.score_retrieval(cases, results).join(failed, "id")
    if answers is not None:
        graded = scoring.grade_cases(cases, answers)
        records = records.join(graded.select("id", *[c for c in FULL_COLUMNS if c in graded.columns]), "id", "left")
    records = materialize(records, "records")
    return records, scoring.aggregate(records, "full" if answers is not None else "retrieval")


def sweep(points: DataFrame, questions: DataFrame, experiments: dict[str, dict[str, float]], score: Callable[[DataFrame], DataFrame], per_branch: int = 50, top_k: int = 10) -> DataFrame:
    """Metrics by experiment. Both branches are searched once for the whole sweep; an
    experiment only fuses them anew (dense_weight, sparse_weight, threshold). ``score`` turns
    hits with an ``experiment`` column into case records that keep it."""
    dense = materialize(search.dense_topk(points, questions, per_branch), "dense-hits")
    sparse = materialize(search.sparse_topk(points, questions, per_branch), "sparse-hits")
    hits = [search.fuse(dense, sparse, e.get("dense_weight", 0.5), e.get("sparse_weight", 0.5), e.get("threshold", 0.0), top_k).withColumn("experiment", F.lit(name))
            for name, e in experiments.items()]
    records = score(reduce(DataFrame.unionByName, hits))
    totals = records.groupBy("experiment").agg(*scoring.retrieval_metrics()).withColumn("category", F.lit(None).cast("string"))
    return rundiff.sweep_table(totals, list(experiments))


def result_identifiers(results: DataFrame, query_id: str = "query_id") -> DataFrame:
    """What identifies each result of a run: question, rank, kind, key and score. Two runs are equal up to ties when
    ``rundiff.ties_differ`` finds nothing between them by question, kind, key and score."""
    key = F.coalesce(F.when(F.col("source") == "rule", F.col("rule_id")), F.col("oracle_id"), F.col("title"))
    return results.select(query_id, F.col("number").alias("rank"), F.col("source").alias("kind"), key.alias("key"), "score")
