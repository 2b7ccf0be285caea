"""Memoised batch inference: hits reused, misses computed once, results appended."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def probe(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """Inputs with the cached value's columns and ``hit``. The cache has one row per key."""
    found = cache.withColumnRenamed(key, "_key").withColumn("_hit", F.lit(True))
    return inputs.join(found, F.col(key) == F.col("_key"), "left").withColumn("hit", F.coalesce("_hit", F.lit(False))).drop("_key", "_hit")


def misses(inputs: DataFrame, cache: DataFrame, key: str = "key") -> DataFrame:
    """One input per key that the cache does not hold. Copies of one question are reduced
    before the shuffle, so a key with very many copies is computed once."""
    first = F.any_value(F.struct(*[c for c in inputs.columns if c != key])).alias("_row")
    return inputs.join(cache.select(key), key, "left_anti").groupBy(key).agg(first).select(key, "_row.*")


def run_batches(rows: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], schema: T.StructType | str) -> DataFrame:
    """Call a user's batch function in Arrow batches; ``load`` runs once per task."""

    def call(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn = load()
        for part in parts:
            if len(part):
                yield fn(part)

    return rows.mapInPandas(call, schema)


def memoize(inputs: DataFrame, cache: DataFrame, load: Callable[[], Callable[[pd.DataFrame], pd.DataFrame]], key: str = "key",
            keep=None) -> tuple[DataFrame, DataFrame]:
    """(inputs with values, rows to append to the cache).

    ``load`` yields a function from input rows to rows of the cache's schema. ``keep`` is a
    predicate of the results worth caching (a failed reply is worth another try). Write the
    second result before using the first one again, so misses are computed once."""
    computed = run_batches(misses(inputs, cache, key), load, cache.schema)
    values = cache.unionByName(computed)
    known = cache.select(key).withColumn("_old", F.lit(True))
    joined = probe(inputs, values, key).drop("hit").join(known, key, "left").withColumn("hit", F.coalesce("_old", F.lit(False))).drop("_old")
    return joined, computed if keep is None else computed.filter(keep)


def cacheable(responses: DataFrame) -> DataFrame:
    """Only non-empty, complete answers that people asked for are kept for reuse."""
    return responses.filter((F.coalesce(F.col("answer"), F.lit("")) != "") & F.col("answer_complete") & ~F.col("eval_mode"))


# Names of response columns that a cache row does not have.
PER_REQUEST_FIELDS = (
    "query", "cached_at", "degraded", "answers_remaining", "context_hash", "prompt_version", "generator", "usage", "generation_error",
)


def cached_form(responses: DataFrame) -> DataFrame:
    return responses.drop(*PER_REQUEST_FIELDS)


HEAD_FIELDS = ("results", "degraded", "answers_remaining", "cached_at", "sources")
DONE_FIELDS = ("results", "answer", "citations", "rule_references", "citation_stats", "answer_complete")


def split_response(responses: DataFrame, stream_id: str = "stream_id") -> tuple[DataFrame, DataFrame]:
    """A response as its first and last event."""
    pick = lambda names: responses.select(stream_id, *[c for c in names if c in responses.columns])
    return pick(HEAD_FIELDS), pick(DONE_FIELDS)


def merge_response(head: DataFrame, done: DataFrame, stream_id: str = "stream_id") -> DataFrame:
    """Head-only fields from the head, everything else from the last event."""
    return head.select(stream_id, *[c for c in head.columns if c not in done.columns and c != "sources"]).join(done, stream_id)
