"""Incremental sync of a point table with a new set of chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What a sync does with one chunk.
EMBED, PAYLOAD_ONLY, SKIP = "embed", "payload", "skip"


def classify(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Add ``action``: embed when new or its text changed, payload when only the payload
    hash differs (a missing stored hash counts as different), else skip."""
    old = stored.select("point_id", F.col("content_hash").alias("_content"), F.col("payload_hash").alias("_payload"), F.lit(True).alias("_known"))
    action = (
        F.when(F.col("_known").isNull() | ~F.col("_content").eqNullSafe(F.col("content_hash")), EMBED)
        .when(~F.col("_payload").eqNullSafe(F.col("payload_hash")), PAYLOAD_ONLY)
        .otherwise(SKIP)
    )
    return chunks.join(old, "point_id", "left").withColumn("action", action).drop("_content", "_payload", "_known")


def touched(chunks: DataFrame, source_type: str = "source_type") -> Column:
    """Whether a row's source type is one that the chunks bring: a scalar subquery over their few source types, so
    that the store is never shuffled by them. An empty input touches nothing."""
    types = chunks.agg(F.collect_set("source_type")).scalar()
    return F.coalesce(F.array_contains(types, F.col(source_type)), F.lit(False))


def stale_points(chunks: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored ids that the chunks no longer produce, of the source types that the chunks bring."""
    return stored.select("point_id", "source_type").filter(touched(chunks)).join(chunks.select("point_id"), "point_id", "left_anti")


def summary(classified: DataFrame, stale: DataFrame | None = None) -> DataFrame:
    """Counts per source type and in total (source type ``TOTAL``)."""
    rows = classified.select("source_type", "action")
    if stale is not None:
        rows = rows.unionByName(stale.select("source_type", F.lit("pruned").alias("action")))
    n = lambda *names: F.count_if(F.col("action").isin(*names))
    return rows.rollup("source_type").agg(
        n(EMBED, PAYLOAD_ONLY, SKIP).alias("total_seen"), n(EMBED).alias("embedded"), n(SKIP).alias("skipped_unchanged"),
        n(PAYLOAD_ONLY).alias("payload_updated"), n("pruned").alias("pruned"),
    ).withColumn("source_type", F.coalesce("source_type", F.lit("TOTAL")))


def apply(chunks: DataFrame, points: DataFrame, encode: Callable[[DataFrame], DataFrame], prune: bool = True) -> DataFrame:
    """The next snapshot of the point table.

    Chunks are compared with the stored hashes alone; the encoder sees nothing but the rows to embed, and adds
    ``dense`` and ``sparse`` to them. The stored rows with their vectors meet only the verdicts, by ``point_id``."""
    fields = ("source_type", "content_hash", "payload_hash", "payload")
    todo = classify(chunks, points.select("point_id", "content_hash", "payload_hash"))
    made = encode(todo.filter(F.col("action") == EMBED)).select("point_id", *fields, "dense", "sparse")
    verdicts = todo.select("point_id", "action", *[F.col(c).alias(f"_n_{c}") for c in fields])
    stays = F.coalesce(F.col("action") != EMBED, ~touched(chunks) if prune else F.lit(True))
    kept = points.join(verdicts, "point_id", "left").filter(stays)
    told = F.col("action").isNotNull()
    kept = kept.select("point_id", *[F.when(told, F.col(f"_n_{c}")).otherwise(F.col(c)).alias(c) for c in fields], "dense", "sparse")
    return kept.unionByName(made)
