"""Content hashes, payload hashes, deterministic ids and cache keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the namespace of all point ids. Changing it makes every point look new.
POINT_NAMESPACE = "6f6e0e2a-6f0a-4c1a-9f1a-6b0c9f6f6e2a"
UNIT_SEPARATOR = "\x1f"


def content_hash(*parts: Column) -> Column:
    """SHA-256 of the identity fields joined by the unit separator; null counts as ''."""
    filled = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.sha2(F.concat_ws(UNIT_SEPARATOR, *filled), 256)


def payload_hash(fields: dict[str, Column]) -> Column:
    """SHA-256 of the canonical JSON of a payload: keys sorted, nulls written out."""
    ordered = F.struct(*[fields[name].alias(name) for name in sorted(fields)])
    return F.sha2(F.to_json(ordered, {"ignoreNullFields": "false"}), 256)


def uuid5(name: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """RFC 4122 version-5 UUID of a name, in SQL expressions only."""
    space = F.unhex(F.lit(namespace.replace("-", "")))
    digest = F.sha1(F.concat(space, F.encode(name, "utf-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"), F.substring(digest, 9, 4), F.lit("-5"), F.substring(digest, 14, 3),
        F.lit("-"), variant, F.substring(digest, 18, 3), F.lit("-"), F.substring(digest, 21, 12),
    )


def rule_point_id(rule_id: Column) -> Column:
    return uuid5(F.concat(F.lit("rule:"), rule_id))


def card_point_id(oracle_id: Column) -> Column:
    return uuid5(F.concat(F.lit("oracle:"), oracle_id))


def ruling_point_id(oracle_id: Column, ordinal: Column) -> Column:
    return uuid5(F.concat(F.lit("ruling:"), oracle_id, F.lit(":"), ordinal.cast("string")))


def cache_key(normalized_query: Column, prompt_version: Column, data_version: Column, settings: dict[str, Column], generator: Column | None = None) -> Column:
    """Key of a cached answer: everything that shapes its context or its text."""
    fields = {
        "query": normalized_query,
        "prompt_version": prompt_version,
        "data_version": data_version,
        "settings": F.struct(*[settings[k].alias(k) for k in sorted(settings)]) if settings else F.lit(""),
    }
    if generator is not None:
        fields["generator"] = generator
    return payload_hash(fields)


def answer_key(question: Column, context_hash: Column, generator: Column, prompt_version: Column, overrides: Column) -> Column:
    """Key of a generated evaluation answer. The leading tag keeps it apart from judge keys.
    ``overrides`` is a JSON string or any column with a stable string form."""
    return payload_hash({"a_kind": F.lit("answer"), "question": question, "context_hash": context_hash,
                         "generator": generator, "prompt_version": prompt_version, "overrides": overrides})


def judge_key(question: Column, gold: Column, answer: Column, model: Column, prompt_version: Column, should_decline: Column) -> Column:
    return payload_hash({"a_kind": F.lit("judge"), "question": question, "gold": gold, "answer": answer,
                         "model": model, "prompt_version": prompt_version, "should_decline": should_decline})
