"""Parsed records and the embeddable chunks built from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..functions.hashing import card_point_id, content_hash, payload_hash, rule_point_id, ruling_point_id
from ..functions.text import empty_to_null, faces_text, front_value, strip_query
from .outline import breadcrumb, with_ancestors
from .running import ordinal

SNIPPET_CHARS = 200


def parse_cards(raw: DataFrame) -> DataFrame:
    """Card records: rows without an id dropped, face values filled in, hash over the
    identity fields only (links and display fields never change it)."""
    faces = F.col("card_faces")
    rows = raw.filter(F.coalesce(F.col("oracle_id"), F.lit("")) != "").select(
        "oracle_id", "name",
        faces_text(F.col("oracle_text"), faces).alias("oracle_text"),
        F.coalesce("type_line", F.lit("")).alias("type_line"),
        empty_to_null(F.col("mana_cost")).alias("mana_cost"),
        strip_query(F.col("scryfall_uri")).alias("scryfall_uri"),
        *[front_value(F.col(c), faces, c).alias(c) for c in ("power", "toughness", "loyalty")],
        front_value(F.col("image_uris"), faces, "image_uris").getField("normal").alias("image_uri"),
        *[c for c in raw.columns if c == "line_no"],
    )
    return rows.withColumn("content_hash", content_hash(*[F.col(c) for c in ("oracle_id", "name", "oracle_text", "type_line", "mana_cost")]))


def parse_rulings(raw: DataFrame) -> DataFrame:
    return raw.withColumn("content_hash", content_hash(F.col("oracle_id"), F.col("published_at"), F.col("comment")))


def _chunk(df: DataFrame, point_id: Column, source_type: str, text_to_embed: Column, payload: dict[str, Column]) -> DataFrame:
    payload = {"source_type": F.lit(source_type), "content_hash": F.col("content_hash"), **payload}
    fields = [payload.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in schemas.PAYLOAD]
    return df.select(
        point_id.alias("point_id"), F.lit(source_type).alias("source_type"), text_to_embed.alias("text_to_embed"),
        "content_hash", F.struct(*fields).alias("payload"), payload_hash(payload).alias("payload_hash"))


def card_chunks(cards: DataFrame) -> DataFrame:
    """Name, type, cost and text, one per line (null counts as empty)."""
    lines = F.concat_ws("\n", *[F.coalesce(c, F.lit("")) for c in ("name", "type_line", "mana_cost", "oracle_text")])
    return _chunk(cards, card_point_id(F.col("oracle_id")), "oracle", lines, {
        "text": F.coalesce("oracle_text", F.lit("")), "card_name": F.col("name"), "oracle_id": F.col("oracle_id"),
        "scryfall_uri": F.col("scryfall_uri")})


def rule_chunks(rules: DataFrame) -> DataFrame:
    """Rule text behind the breadcrumb of its ancestors."""
    r = with_ancestors(rules)
    top = F.get("ancestors", F.lit(0))
    return _chunk(r, rule_point_id(F.col("rule_id")), "rule", F.concat(breadcrumb(F.col("ancestors")), F.col("text")), {
        "text": F.col("text"), "rule_id": F.col("rule_id"),
        "section_id": F.coalesce(top.id, F.col("rule_id")), "section_title": F.coalesce(top.text, F.col("text"))})


def rulings_with_cards(rulings: DataFrame, cards: DataFrame) -> DataFrame:
    """Every ruling with its ordinal within its card (in file order, counted before the
    card lookup) and the card's columns; null where no card matches."""
    placed = ordinal(rulings, ["oracle_id"], "line_no", "ordinal")
    lookup = cards.select(F.col("oracle_id").alias("_id"), "name", "oracle_text", "scryfall_uri")
    return placed.join(lookup, F.col("oracle_id") == F.col("_id"), "left").drop("_id")


def ruling_chunks(rulings: DataFrame, cards: DataFrame) -> DataFrame:
    """Chunks of the rulings whose card exists: card name and snippet, then the ruling."""
    r = rulings_with_cards(rulings, cards).filter(F.col("name").isNotNull())
    prefix = F.concat(F.col("name"), F.lit(" — "), F.substring(F.coalesce("oracle_text", F.lit("")), 1, SNIPPET_CHARS), F.lit("\nRuling: "))
    return _chunk(r, ruling_point_id(F.col("oracle_id"), F.col("ordinal")), "ruling", F.concat(prefix, F.col("comment")), {
        "text": F.col("comment"), "card_name": F.col("name"), "oracle_id": F.col("oracle_id"),
        "published_at": F.col("published_at"), "scryfall_uri": F.col("scryfall_uri")})


def skipped_rulings(rulings: DataFrame, cards: DataFrame) -> DataFrame:
    """How many rulings name a card that is not in the card table."""
    return rulings.join(cards, "oracle_id", "left_anti").agg(F.count("*").alias("skipped_no_card"))


def all_chunks(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out
