"""Labels, citations and evidence built from one ranked result."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CARD_SOURCES = ("card", "oracle")


def source_label(source: Column, title: Column, rule_id: Column, card_name: Column, published_at: Column) -> Column:
    """The name of a source, the same in a context block and in a citation."""
    name = F.coalesce(F.nullif(card_name, F.lit("")), title)
    dated = F.coalesce(published_at, F.lit("")) != ""
    return (
        F.when(source == "rule", F.concat(F.lit("Rule "), F.coalesce(F.nullif(rule_id, F.lit("")), title)))
        .when((source == "ruling") & dated, F.concat(F.lit("Ruling — "), name, F.lit(" ("), published_at, F.lit(")")))
        .when(source == "ruling", F.concat(F.lit("Ruling — "), name))
        .when(source.isin(*CARD_SOURCES), F.concat(F.lit("Card — "), name))
        .otherwise(title)
    )


def source_kind(source: Column) -> Column:
    return F.when(source.isin(*CARD_SOURCES), "card").when(source == "ruling", "ruling").otherwise("rule")


def citation(number: Column, r: dict[str, Column]) -> Column:
    """The citation record of a numbered result. Only rulings carry a date; rules link to
    their page, cards and rulings to their own address."""
    is_rule = r["source"] == "rule"
    rule_id = F.coalesce(F.nullif(r["rule_id"], F.lit("")), r["title"])
    kind = F.when(r["source"] == "oracle", "card").otherwise(r["source"])
    return F.struct(
        number.alias("number"),
        kind.alias("source_type"),
        source_label(r["source"], r["title"], r["rule_id"], r["card_name"], r["published_at"]).alias("title"),
        F.when(is_rule, rule_id).alias("rule_id"),
        F.when(~is_rule, F.coalesce(F.nullif(r["card_name"], F.lit("")), r["title"])).alias("card_name"),
        F.when(~is_rule, r["oracle_id"]).alias("oracle_id"),
        r["text"].alias("text"),
        F.when(is_rule, F.concat(F.lit("/rules/"), rule_id)).otherwise(r["scryfall_uri"]).alias("url"),
        F.when(kind == "ruling", r["published_at"]).alias("published_at"),
    )


def evidence(position: Column, r: dict[str, Column]) -> Column:
    """An uncited result in the shape of the evidence list (position counts from 0)."""
    kind = source_kind(r["source"])
    rule_id = F.when(kind == "rule", F.coalesce(r["rule_id"], r["title"]))
    return F.struct(
        F.concat(F.lit("r"), position.cast("string")).alias("key"),
        kind.alias("kind"),
        r["title"].alias("title"),
        rule_id.alias("rule_id"),
        F.when(kind != "rule", F.coalesce(r["card_name"], r["title"])).alias("card_name"),
        r["text"].alias("text"),
        F.coalesce(F.concat(F.lit("/rules/"), rule_id), r["scryfall_uri"]).alias("url"),
        r["published_at"].alias("published_at"),
    )


def stat_line(type_line: Column, power: Column, toughness: Column, loyalty: Column) -> Column:
    stats = F.when(power.isNotNull() & toughness.isNotNull(), F.concat(power, F.lit("/"), toughness)).when(
        loyalty.isNotNull(), F.concat(F.lit("Loyalty "), loyalty))
    return F.concat_ws(" · ", F.nullif(type_line, F.lit("")), stats)


def summary_line(stats: Column, text: Column) -> Column:
    first = F.trim(F.substring_index(text, "\n", 1))
    return F.concat_ws(" · ", F.nullif(stats, F.lit("")), F.nullif(first, F.lit("")))
