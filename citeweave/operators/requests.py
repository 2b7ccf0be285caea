"""Requests before any answer: refusals and per-request settings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_QUERY_CHARS = 500

# Settings a request may override, with the type each must have.
OVERRIDABLE = {
    "hybrid_dense_weight": "double",
    "hybrid_sparse_weight": "double",
    "hybrid_top_k": "int",
    "hybrid_per_branch_limit": "int",
    "hybrid_score_threshold": "double",
    "rules_top_k": "int",
    "card_ruling_limit": "int",
    "collection_name": "string",
    "gemini_model": "string",
    "generation_temperature": "double",
    "generation_max_tokens": "int",
    "generation_thinking_level": "string",
}
# The overrides that change the answer and not its context.
GENERATION_OVERRIDES = ("gemini_model", "generation_temperature", "generation_max_tokens", "generation_thinking_level")
THINKING_LEVELS = ("minimal", "low", "medium", "high")


def resolve(requests: DataFrame, eval_mode: bool, max_chars: int = MAX_QUERY_CHARS) -> DataFrame:
    """Add ``status`` (200, 403, 422) and ``detail``. ``requests`` has query, overrides
    (map of strings), fresh and may_refresh."""
    keys = F.coalesce(F.map_keys("overrides"), F.array().cast("array<string>"))
    unknown = F.array_sort(F.array_except(keys, F.array(*[F.lit(k) for k in OVERRIDABLE])))
    value = lambda k: F.element_at("overrides", k)
    bad = [F.when(F.array_contains(keys, k) & value(k).isNotNull() & value(k).try_cast(kind).isNull(), F.lit(k)) for k, kind in OVERRIDABLE.items() if kind != "string"]
    bad.append(F.when(F.array_contains(keys, "generation_thinking_level") & ~value("generation_thinking_level").isin(*THINKING_LEVELS), F.lit("generation_thinking_level")))
    invalid = F.array_sort(F.array_compact(F.array(*bad)))
    detail = (
        F.when((F.size(keys) > 0) & F.lit(not eval_mode), F.struct(F.lit(403).alias("s"), F.lit("overrides are only accepted in evaluation mode").alias("d")))
        .when(F.size(unknown) > 0, F.struct(F.lit(422).alias("s"), F.concat(F.lit("unknown override keys: "), F.array_join(unknown, ", ")).alias("d")))
        .when(F.size(invalid) > 0, F.struct(F.lit(422).alias("s"), F.concat(F.lit("invalid override "), F.get(invalid, F.lit(0))).alias("d")))
        .when(F.length("query") > max_chars, F.struct(F.lit(422).alias("s"), F.lit(f"query is longer than {max_chars} characters").alias("d")))
        .when(F.col("fresh") & ~F.col("may_refresh"), F.struct(F.lit(403).alias("s"), F.lit("fresh answers are admin-only").alias("d")))
        .otherwise(F.struct(F.lit(200).alias("s"), F.lit(None).cast("string").alias("d")))
    )
    return requests.withColumn("_v", detail).withColumn("status", F.col("_v.s")).withColumn("detail", F.col("_v.d")).drop("_v")


def settings_rows(requests: DataFrame, request_id: str, defaults: dict[str, object]) -> DataFrame:
    """Effective settings per request in long form: defaults with the overrides applied."""
    base = F.create_map(*[F.lit(str(v)) for pair in sorted(defaults.items()) for v in pair])
    merged = F.map_concat(F.map_filter(base, lambda k, _v: ~F.coalesce(F.map_contains_key(F.col("overrides"), k), F.lit(False))),
                          F.coalesce("overrides", F.create_map().cast("map<string,string>")))
    return requests.select(request_id, F.explode(merged).alias("key", "value"))
